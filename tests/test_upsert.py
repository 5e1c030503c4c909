import re

import pytest
from pyspark.sql import functions as F

from millrace.operators.upsert import clashing_keys, upsert

SCHEMA = "k string, a int, b string, born string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def merge(target, source, **options):
    return upsert(target, source, ["k"], ["born"], **options)


def test_update_insert_and_untouched(spark):
    target = frame(spark, [("x", 1, "old", "t"), ("y", 2, "old", "t")])
    source = frame(spark, [("x", None, "new", "s"), ("z", 3, "new", "s")])
    assert rows(merge(target, source)) == [("x", None, "new", "t"), ("y", 2, "old", "t"), ("z", 3, "new", "s")]


def test_second_run_changes_nothing(spark):
    target = frame(spark, [("x", 1, "old", "t"), ("y", 2, "old", "t")])
    source = frame(spark, [("x", 5, "new", "s"), ("z", 3, "new", "s")])
    once = merge(target, source)
    assert rows(merge(once, source)) == rows(once)


def test_null_keys_come_in_again_on_every_run(spark):
    source = frame(spark, [(None, 1, "n", "s"), (None, 2, "n", "s"), ("x", 1, "v", "s")])
    once = merge(frame(spark, []), source)
    assert once.count() == 3
    twice = merge(once, source)
    assert twice.count() == 5
    assert twice.where("k IS NULL").count() == 4


def test_two_part_key_with_one_null_part(spark):
    schema = "d string, k string, v int"
    target = frame(spark, [("1", "a", 1), (None, "a", 2)], schema)
    source = frame(spark, [("1", "a", 9), (None, "a", 8)], schema)
    assert rows(upsert(target, source, ["d", "k"])) == [("1", "a", 9), (None, "a", 2), (None, "a", 8)]


def test_second_source_row_for_a_matched_key_fails(spark):
    target = frame(spark, [("x", 1, "old", "t")])
    source = frame(spark, [("x", 1, "one", "s"), ("x", 2, "two", "s")])
    with pytest.raises(Exception, match="more than one source row for key"):
        merge(target, source).collect()
    assert [r.k for r in clashing_keys(source, ["k"])] == ["x"]


def test_second_source_row_without_a_match_is_inserted(spark):
    source = frame(spark, [("x", 1, "one", "s"), ("x", 2, "two", "s")])
    assert merge(frame(spark, []), source).count() == 2
    with pytest.raises(Exception, match="more than one source row for key"):
        merge(frame(spark, []), source, strict=True).collect()


def test_every_target_row_of_a_key_is_updated(spark):
    target = frame(spark, [("x", 1, "one", "t1"), ("x", 2, "two", "t2")])
    source = frame(spark, [("x", 9, "new", "s")])
    assert rows(merge(target, source)) == [("x", 9, "new", "t1"), ("x", 9, "new", "t2")]


def test_source_without_a_column_leaves_it(spark):
    target = frame(spark, [("x", 1, "old", "t")])
    source = frame(spark, [("x", 7), ("y", 8)], "k string, a int")
    assert rows(merge(target, source)) == [("x", 7, "old", "t"), ("y", 8, None, None)]


def many(spark, n, null_share):
    key = F.when(F.col("id") % 100 < null_share, None).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    return spark.range(n).select(key.alias("k"), F.col("id").cast("int").alias("a"), F.lit("b").alias("b"), F.lit("c").alias("born"))


def test_one_shuffle_and_sort_per_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merge(many(spark, 1000, 0), many(spark, 1000, 0))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    assert len(re.findall(r"\bSort \[", plan)) == 2


def test_a_third_of_all_keys_null_spreads_over_the_partitions(spark):
    source = many(spark, 12000, 34)
    merged = merge(many(spark, 6000, 0), source).withColumn("p", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in merged.where("k IS NULL").groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 34 * 120
    assert max(sizes) < 0.4 * sum(sizes)


def test_the_source_is_read_once(spark, tmp_path):
    many(spark, 400, 30).write.parquet(str(tmp_path / "feed"))
    merged = merge(many(spark, 100, 0), spark.read.schema(SCHEMA).parquet(str(tmp_path / "feed")))
    text = merged._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", text)) == 1
    assert merged.where("k IS NULL").count() == 120


def test_marked_rows_without_a_key_meet_no_key(spark):
    """Rows whose key holds a NULL are placed by another value, which may be a key that is there."""
    keys = [(str(i), i, "old", "t") for i in range(30_000)]
    source = [(None, i, "n", "s") for i in range(20)] + [("7", 1, "new", "s")]
    done = merge(frame(spark, keys), frame(spark, source), strict=True)
    assert done.count() == 30_020 and done.where("k IS NULL").count() == 20
    assert [tuple(r) for r in done.where("b = 'new'").collect()] == [("7", 1, "new", "t")]
