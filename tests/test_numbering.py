import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.numbering import global_row_number


@pytest.mark.parametrize("n,parts", [(0, 1), (1, 3), (2000, 7)])
def test_numbers_follow_the_order(spark, n, parts):
    picks = random.Random(n)
    # a third of the rows share one first key
    rows = [("hot" if picks.random() < 0.33 else f"d{picks.randrange(400):03}", f"x{i:05}") for i in range(n)]
    picks.shuffle(rows)
    df = spark.createDataFrame(rows, "d string, x string").repartition(parts)
    got = global_row_number(df, [F.col("d").asc_nulls_last(), F.col("x").asc()], "n").collect()
    assert {(r.d, r.x): r.n for r in got} == {row: i for i, row in enumerate(sorted(rows), 1)}


def test_null_order_is_the_callers(spark):
    df = spark.createDataFrame([(None, "a"), ("p", "b"), (None, "c")], "d string, x string")
    first = global_row_number(df, [F.col("d").asc_nulls_first(), F.col("x").asc()], "n")
    assert {r.x: r.n for r in first.collect()} == {"a": 1, "c": 2, "b": 3}
    last = global_row_number(df, [F.col("d").asc_nulls_last(), F.col("x").asc()], "n")
    assert {r.x: r.n for r in last.collect()} == {"b": 1, "a": 2, "c": 3}
