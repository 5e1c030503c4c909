from pyspark.sql import functions as F
"""The pipeline's stages on a small table, each against plain Python on the rows it got."""

import collections

import sentencepiece
from test_operators import components, lower, sha

import corpus_pipeline
from millrace.llm import quality_model
from millrace.llm.queries import EXPECTED, QUERIES, piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_one_by_one(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, str(tmp_path / name)
        stage(spark, docs, small).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = (before, docs)
    assert all(after.columns == COLUMNS for _, after in list(seen.values())[:-1])

    before, after = seen["quality"]
    model = quality_model.learned(before, spark.read.parquet(f"{small}/labels.parquet"))
    scores = {r[0]: r[-1] for r in quality_model.scored(before, model).collect()}
    assert set(rows_of(after)) == {d for d, s in scores.items() if s >= quality_model.THRESHOLD}

    before, after = map(rows_of, seen["lines"])
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.Counter(k for t in before.values() for k in {key(x) for x in (t or "").split("\n")})
    kept = {d: "\n".join(x for x in (t or "").split("\n") if not key(x) or holders[key(x)] < 10) for d, t in before.items()}
    assert {d: t or "" for d, t in after.items()} == kept

    before, after = map(rows_of, seen["near_duplicates"])
    group = components(list(before.items()), 5)
    assert set(after) == {d for d, g in group.items() if d == g}

    before, after = seen["contamination"]
    found = QUERIES["op8_decontaminate"]  # compared with DuckDB on the whole table elsewhere
    assert found and set(rows_of(after)) <= set(rows_of(before))

    before, after = seen["encoding"]
    piece = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = rows_of(before)
    for r in after.collect():
        ids = piece.encode(texts[r.doc_id])
        assert (r.ids, r.n_tokens, r.ids_sha256) == (ids, len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(piece.decode(ids))

    whole = {tuple(r) for r in corpus_pipeline.run(spark, small).select("doc_id", "ids_sha256").collect()}
    assert whole == {tuple(r) for r in docs.select("doc_id", "ids_sha256").collect()}


def test_queries_agree_with_duckdb(spark, small):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    for name, sql in EXPECTED.items():
        got = QUERIES[name](spark, small)
        expected = con.sql(sql)
        columns = sorted(expected.columns)
        assert sorted(got.columns) == columns
        wanted = sorted(expected.project(", ".join(columns)).fetchall(), key=str)
        assert sorted(map(tuple, got.select(*columns).collect()), key=str) == wanted


def test_stages_take_clashing_columns_nulls_and_repeated_rows(spark, small):
    """Extra columns with the names of results, NULLs in every column, empty and repeated rows, and no rows at all."""
    extra = "n_dropped int, n_lines int, kept_text string, n_hit int, spans int, items int, n_items int, n_words int, contaminated boolean, score double"
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (900_000, "", "en", "s", 0), (900_001, "same text", "en", "s", 9)] * 2, docs.schema)
    docs = docs.union(odd)
    for column in extra.split(", "):
        name, kind = column.split()
        docs = docs.withColumn(name, F.lit(None).cast(kind))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, small)
        if name != "encoding":
            assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and (name in ("quality", "contamination", "near_duplicates") or len(rows) == docs.count()), name
        assert stage(spark, docs.where("false"), small).collect() == [], name


def broadcast_rows(plan):
    """Rows of every table that a plan that has run broadcast."""
    kind = plan.getClass().getSimpleName()
    if kind == "BroadcastExchangeExec":
        yield plan.metrics().apply("numOutputRows").value()
    inner = "executedPlan" if kind == "AdaptiveSparkPlanExec" else "plan" if kind.endswith("QueryStageExec") else None
    children = [getattr(plan, inner)()] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    for child in children:
        yield from broadcast_rows(child)


def test_dropped_ids_do_not_meet_in_the_driver(spark):
    """Every text four times, rows without an id beside them: the ids of the copies are no broadcast table."""
    text = F.concat_ws(" ", *[F.concat(F.lit(w), F.col("id") % 1_000) for w in "abcdefgh"])
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit(1).alias("__maybe"))
    docs = docs.union(spark.sql("SELECT CAST(NULL AS LONG), 'a1 b1 c1 d1 e1 f1 g1 h1', 1"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only what is broadcast whatever its size
    try:
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        rows = kept.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == list(range(1_000)) and len(rows) == 1_001
    sent = list(broadcast_rows(kept._jdf.queryExecution().executedPlan()))
    assert sent and max(sent) <= 2  # pieces of a bitmap; before, 3,000 ids


def test_hint_leaves_no_value_out(spark):
    from millrace.llm.rows import hinted

    ids = spark.range(0, 60_000, 3).toDF("x")
    table = spark.range(60_000).withColumn("maybe_", F.lit("kept")).union(spark.sql("SELECT CAST(NULL AS LONG), 'none'"))
    got = hinted(table, "id", ids, 20_000, "maybe")
    assert got.columns == ["id", "maybe_", "maybe"] and got.count() == 60_001
    surely = got.where("id % 3 = 0").groupBy("maybe").count().collect()
    assert [tuple(r) for r in surely] == [(True, 20_000)]
    assert got.where("id % 3 <> 0 and maybe").count() < 4_000
    assert hinted(table, "id", ids.where("false"), 0, "maybe").where("maybe").count() == 0
    with_null = ids.union(spark.sql("SELECT CAST(NULL AS LONG)"))
    assert hinted(table, "id", with_null, 20_001, "maybe").where("id is null and maybe").count() == 1
