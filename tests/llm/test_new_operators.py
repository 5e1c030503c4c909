"""Spelling variants, Merkle manifest and context model against plain Python, on hard rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import context_model, merkle, variants

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, word string, n long, key long, tree long, score double"
LONG = " ".join(f"Wörd{i % 977}" for i in range(30_000))
TEXTS = ["Spelling spelling SPELLING speling spellings", "", None, " \t\n ", "one", "straße Strasse strase", LONG, "a" * 3_000]


def rows():
    made = [(i, f"s{i % 3}" if i % 7 else None, "en" if i % 2 else None, i, TEXTS[i % len(TEXTS)]) for i in range(60)]
    made += [(5, "s2", "en", 1, "Twice"), (5, "s2", "en", 1, "Twice"), (5, "s2", "en", 2, "other"), (None, "s0", None, None, None)]
    made += [(1000 + i, "hot", "en", i, f"Hot {i}") for i in range(300)] + [(900, "alone", "en", 1, "x")]
    return [(*r, "clash", 1, 2, 3, 0.5) for r in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# Spelling variants


def near_by_force(n):
    near = {w: set() for w in n}
    shared = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            shared[i, rest].add(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for some in shared.values():
        for w in some:
            near[w] |= some - {w}
    return near


def grouped_by_force(n, ratio=2):
    near, form = near_by_force(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w] or "", n.get(form[w], 0), root(w)) for w in n)


def found(df):
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(tuple(x or ("" if c == "form" else 0) for c, x in zip(columns, r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("per_half, per_task", [(20_000, 40_000), (7, 60)])
@pytest.mark.parametrize("letters", ["ab", "abcdefghij", "aéÿz"])
def test_variants_equal_brute_force(spark, per_half, per_task, letters):
    rng = random.Random(len(letters))
    n = {"".join(rng.choices(letters, k=rng.randint(5, 9))): 2 ** rng.randint(0, 12) for _ in range(500)}
    df = spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(3)
    assert found(variants.grouped(df, words_per_half=per_half, rows_per_task=per_task)) == grouped_by_force(n)


def test_long_chain_and_ties(spark):
    n = {"a" * (5 + i): 3 * 2**i for i in range(40)} | {"bbbbb": 4, "bbbbc": 9, "bbbbd": 9, "ccccc": 3}
    df = spark.createDataFrame(sorted(n.items()), "word string, n long")
    done = found(variants.grouped(df))
    assert done == grouped_by_force(n)
    assert ("bbbbb", 4, 2, "bbbbc", 9, "bbbbc") in done and ("ccccc", 3, 0, "", 0, "ccccc") in done


def test_ratio_that_allows_circles_is_refused(spark):
    with pytest.raises(ValueError, match="ratio"):
        variants.grouped(spark.createDataFrame([("abcde", 3)], "word string, n long"), ratio=1)


def test_counted_words(docs, none):
    want = collections.Counter()
    for r in rows():
        run = ""
        for c in lower(r[4] or "") + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
                want[word] += len(word) >= 5
                run = ""
    want = {w: c for w, c in want.items() if c >= 3 and len(w) >= 5}
    assert {r.word: r.n for r in variants.counted(docs).collect()} == want
    assert variants.grouped(variants.counted(none)).collect() == []
    assert variants.counted(none).collect() == []


def test_index_finds_each_word_once():
    words = sorted({"".join(random.Random(i).choices("abc", k=5 + i % 3)) for i in range(200)})
    index = variants.Index(words)
    n, near = {w: 1 for w in words}, near_by_force({w: 1 for w in words})
    queries = np.arange(len(words))
    lengths = np.array([len(w) for w in words])
    got = collections.defaultdict(list)
    for right in (True, False):
        for q, w in zip(*index.one_error(queries, lengths // 2 if right else lengths - lengths // 2, right)):
            got[words[q], right].append(words[w])
    for w in n:
        assert len(got[w, True]) == len(set(got[w, True]))
        assert set(got[w, True]) | set(got[w, False]) == near[w]


# Merkle manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r, text=None):
    values = [r[0], r[1], r[2], r[3], r[4] if text is None else text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(leaves, fanout):
    steps, level, own = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(own):
            run = range(at // fanout * fanout, min(at // fanout * fanout + fanout, len(level)))
            steps[i].append(("".join(level[j] for j in run if j < at), "".join(level[j] for j in run if j > at)))
        level = [digest("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        own = [at // fanout for at in own]
    return level[0], steps


def manifest_by_force(table, fanout, tampered):
    by = collections.defaultdict(list)
    for r in table:
        by[r[1]].append(r)
    subtrees = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subtrees.append((mine, *tree_of([leaf_of(r) for r in mine], fanout)))
    root, up = tree_of([s for _, s, _ in subtrees], fanout)
    out = []
    for (mine, sub, steps), further in zip(subtrees, up):
        for r, own in zip(mine, steps):
            way = own + further
            acc = leaf_of(r, lower(r[4])) if r[4] is not None and tampered(r) else leaf_of(r)
            for left, right in way:
                acc = digest(left + acc + right)
            out.append((r[0], leaf_of(r), sub, root, "".join(a + b for a, b in way), acc))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout", [16, 2])
def test_manifest_equals_brute_force(docs, fanout):
    got = merkle.manifest(docs, F.col("doc_id") % 3 == 0, fanout=fanout)
    want = manifest_by_force(rows(), fanout, lambda r: r[0] is not None and r[0] % 3 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == want


@pytest.mark.parametrize("some", [["alone"], ["alone", "hot"], ["s0"]])
def test_manifest_of_few_sources(docs, some):
    got = merkle.manifest(docs.where(F.col("source").isin(some)))
    table = [r for r in rows() if r[1] in some]
    assert sorted(map(tuple, got.collect()), key=str) == manifest_by_force(table, 16, lambda r: False)


def test_manifest_of_no_rows(none):
    assert merkle.manifest(none).collect() == []


def test_manifest_joins_trees_with_a_shuffle_beyond_the_limit(docs, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_TREES", 0)
    got = merkle.manifest(docs)
    assert sorted(map(tuple, got.collect()), key=str) == manifest_by_force(rows(), 16, lambda r: False)


# Context model


def stream_of(text):
    return b"".join(w + b" " for w in lower_words(text)) + b"\n"


def lower_words(text):
    return (text or "").encode().lower().split()


def scores_by_force(table, learns, order):
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    tokens = collections.Counter()
    for r in table:
        if learns(r):
            tokens.update([*lower_words(r[4]), b"\n"])
            data = b"\n" * order + stream_of(r[4])
            for i in range(order, len(data)):
                for j in range(order + 1):
                    counts[j][data[i - j : i]][data[i]] += 1
    total, kinds = sum(tokens.values()), len(tokens)
    known = {}

    def log_p(context, byte):
        if (context, byte) not in known:
            gone, escape = set(), 0.0
            for j in range(order, -1, -1):
                seen = {b: c for b, c in counts[j][context[order - j :]].items() if b not in gone}
                room = 0.5 if len(gone) + len(seen) < 256 else 0
                whole = sum(seen.values())
                if byte in seen:
                    known[context, byte] = escape + math.log10((seen[byte] - room) / whole)
                    break
                escape += math.log10(room * len(seen) / whole) if room and seen else 0
                gone |= set(seen)
            else:
                known[context, byte] = escape - math.log10(256 - len(gone))
        return known[context, byte]

    out = []
    for r in table:
        mine = [*lower_words(r[4]), b"\n"]
        data = b"\n" * order + stream_of(r[4])
        score = sum(log_p(data[i - order : i], data[i]) for i in range(order, len(data)))
        base = sum(math.log10((tokens[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in mine)
        out.append((r[0], len(mine), sum(tokens[t] > 0 for t in mine), total, base, score))
    return sorted(out, key=str)


def close(got, want):
    got = sorted(map(tuple, got.collect()), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize("order", [5, 2])
@pytest.mark.parametrize("broadcast_keys", [context_model.BROADCAST_KEYS, 100, 0])
def test_scores_equal_brute_force(docs, order, broadcast_keys):
    learns = ~context_model.held_out(F.col("doc_id"))
    want = scores_by_force(rows(), lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 != 0, order)
    close(context_model.scored(docs, learns, order=order, broadcast_keys=broadcast_keys), want)


def test_long_texts_are_read_in_slices(monkeypatch):
    texts = [LONG.encode(), b"", b"a b", LONG.encode()[:1000]]
    read = context_model.Reader(5)
    whole = [np.concatenate(p) for p in zip(*read(texts))]
    monkeypatch.setattr(context_model, "_SLICE", 50)
    monkeypatch.setattr(context_model, "_KEYS_AT_ONCE", 100)
    parts = [np.concatenate(p) for p in zip(*read(texts))]
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts)) and len(list(read(texts))) > 1000


def test_windows():
    data = bytes(range(250, 256)) * 3
    for size in range(1, 8):
        assert windows_by_force(data, size) == context_model.windows(data, size).tolist()


def windows_by_force(data, size):
    return [int.from_bytes(data[i : i + size], "big") for i in range(len(data) - size + 1)]


def test_counts_are_merged(monkeypatch):
    monkeypatch.setattr(context_model, "_KEYS_COUNTED", 50)
    keys = np.random.default_rng(0).integers(0, 200, 5_000).astype(np.uint64)
    counted = context_model.Counted()
    for at in range(0, len(keys), 37):
        counted.add(keys[at : at + 37])
    assert dict(zip(*map(np.ndarray.tolist, counted.taken()))) == collections.Counter(keys.tolist())


def test_nothing_learned_and_no_rows(docs, none):
    close(context_model.scored(docs, F.lit(None).cast("boolean")), scores_by_force(rows(), lambda r: False, 5))
    assert context_model.scored(none, F.lit(True)).collect() == []


def test_result_names_are_not_kept_twice(docs):
    with pytest.raises(ValueError, match="name of a result"):
        context_model.scored(docs, F.lit(True), keep=("doc_id", "score"))


def test_chances_sum_to_one():
    rng = np.random.default_rng(3)
    seen = [rng.integers(0, 50, (40, 256)) * (rng.random((40, 256)) < share) for share in (0.01, 0.1, 0.5)]
    seen[2][:5] = 1  # no byte left to escape to
    seen[0][5:9] = 0
    assert np.allclose((10 ** context_model.chances(seen)).sum(axis=1), 1)


def test_held_out_model_beats_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = context_model.held_out(F.col("doc_id"))
    got = context_model.scored(docs, ~out).where(out).agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]
