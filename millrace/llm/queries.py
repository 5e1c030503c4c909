"""Registered queries of this package: thin readers of the operators, and DuckDB texts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm import (
    context_model,
    decontaminate,
    html_extract,
    line_dedup,
    merkle,
    near_dedup,
    piece_codec,
    quality_model,
    repetition,
    secret_scan,
    sharding,
    substring_dedup,
    variants,
)

Query = Callable[[SparkSession, str], DataFrame]


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _joined_sha256(parts: Column, by: str) -> Column:
    return F.sha2(F.array_join(parts, by), 256)


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, folder, "documents"), shingle=4, percent=80)


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeated(docs, window=35, with_text=False)


def op3_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(read(spark, folder, "pages"))


def op4_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.digests(read(spark, folder, "documents"), piece_model())


def op5_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = quality_model.learned(docs, read(spark, folder, "labels"))
    found = quality_model.scored(docs, model)
    return found.select(
        "doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(read(spark, folder, "documents"))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = secret_scan.trained(secret_scan.samples(docs))
    return secret_scan.digests(secret_scan.scan(docs, model))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.scan(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", _joined_sha256(F.col("items"), ",").alias("items_sha256"), "contaminated"
    )


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    done = line_dedup.drop_common_lines(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_repetition(spark: SparkSession, folder: str) -> DataFrame:
    rated = repetition.rate(read(spark, folder, "documents"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the texts with its near words, its more frequent form, and where forms lead."""
    return variants.grouped(variants.counted(read(spark, folder, "documents")))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of every row; a fifth of the rows is folded from a text in lower case."""
    docs = read(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(docs, tampered)
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_context_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every text, learned from nine tenths of them, beside that of its single words."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    held_out = context_model.held_out(F.col("doc_id"))
    found = context_model.scored(docs, ~held_out)
    return found.withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_substring_dedup, op3_html_extract, op4_piece_codec, op5_quality_model, op6_sharding,
        op7_secret_scan, op8_decontaminate, op9_line_dedup, op10_repetition,
        op11_spelling_variants, op12_merkle_manifest, op13_context_model,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


_SPACED = r"'[^\x20\x09-\x0D]+'"

#: The 256 values of the byte-wise crc32, by its rule.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""


def _crc32(text: str) -> str:
    """crc32 of a text that is not empty; ``crc`` must be joined."""
    codes = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


EXPECTED: dict[str, str] = {
    "op1_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {_SPACED}) AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct([list_slice(w, i, i + least(len(w), 4) - 1) FOR i IN range(1, len(w) - least(len(w), 4) + 2)])) AS s
      FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, to_id) AS (SELECT a, b FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.to_id = l.a),
g AS (SELECT doc_id, min(to_id) AS least_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least_id, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(least_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
""",
    "op2_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
x AS (SELECT win FROM v GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM v JOIN x USING (win)),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.pos) AS t, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d) u
         LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.pos = u.pos WHERE gone.pos IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op8_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, least(len(w), 13) AS n, unnest([list_slice(w, i, i + least(len(w), 13) - 1) FOR i IN range(1, len(w) - least(len(w), 13) + 2)]) AS win
      FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM p),
c AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
h AS (SELECT c.doc_id, c.i, c.n, p.item_id FROM (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win FROM c) c
      JOIN p ON c.n = p.n AND c.win = p.win),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM h),
hits AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op9_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_lower("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS d, unnest(regexp_extract_all({_lower("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
h AS (SELECT run, {_crc32("d || run")} AS h FROM r, crc),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, count(*) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
v AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word
      UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word),
b AS (SELECT word, near, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS place FROM p),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
      FROM w LEFT JOIN b ON b.word = w.word AND b.place = 1),
g(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON f.word = g.form)
SELECT f.*, g.root FROM f JOIN g ON g.word = f.word AND g.form IS NULL
""",
    "op12_merkle_manifest": rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf(_lower("text"))} AS lower_leaf,
             coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0, FALSE) AS tampered FROM documents, crc),
l AS (SELECT *, CASE WHEN tampered THEN lower_leaf ELSE leaf END AS changed, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
             count(*) OVER (PARTITION BY source) AS size, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d),
t(tree, level, idx, digest, size) AS (
    SELECT tree, 0, rank, leaf, size FROM l
    UNION ALL SELECT tree, min(level) + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (min(size) + 15) // 16
    FROM t WHERE size > 1 GROUP BY tree, idx // 16),
subroots AS (SELECT tree, digest AS subroot, level AS height, count(*) OVER () AS trees FROM t WHERE size = 1),
u(level, idx, digest, size) AS (
    SELECT 0, tree, subroot, trees FROM subroots
    UNION ALL SELECT min(level) + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (min(size) + 15) // 16
    FROM u WHERE size > 1 GROUP BY idx // 16),
nodes AS (SELECT tree, level, idx, digest, size FROM t UNION ALL SELECT -1, level, idx, digest, size FROM u),
own AS (SELECT l.tree AS of_tree, l.rank, n.tree, n.level, n.level AS step, n.idx FROM l JOIN nodes n ON n.tree = l.tree AND n.size > 1 AND n.idx = l.rank // CAST(16 ** n.level AS BIGINT)
        UNION ALL SELECT l.tree, l.rank, -1, n.level, s.height + n.level, n.idx FROM l JOIN subroots s USING (tree)
        JOIN nodes n ON n.tree = -1 AND n.size > 1 AND n.idx = l.tree // CAST(16 ** n.level AS BIGINT)),
steps AS (SELECT o.of_tree, o.rank, o.step, coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (WHERE n.idx < o.idx), '') AS before,
                 coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (WHERE n.idx > o.idx), '') AS behind
          FROM own o JOIN nodes n ON n.tree = o.tree AND n.level = o.level AND n.idx // 16 = o.idx // 16 GROUP BY ALL),
proofs AS (SELECT of_tree, rank, sha256(string_agg(before || behind, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY ALL),
fold(tree, rank, step, digest) AS (
    SELECT tree, rank, 0, changed FROM l
    UNION ALL SELECT f.tree, f.rank, f.step + 1, sha256(s.before || f.digest || s.behind) FROM fold f JOIN steps s ON s.of_tree = f.tree AND s.rank = f.rank AND s.step = f.step),
done AS (SELECT tree, rank, arg_max(digest, step) AS folded_root FROM fold GROUP BY ALL)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.digest AS verified
FROM l JOIN subroots s USING (tree) JOIN done USING (tree, rank) LEFT JOIN proofs p ON p.of_tree = l.tree AND p.rank = l.rank
JOIN u r ON r.size = 1
""",
}
