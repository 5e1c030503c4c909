from uuid import uuid4

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators.upsert import upsert_curated
from millrace.sources import file_index
from millrace.sources.tables import Warehouse

ITEMS = "sales.order_items"


def items(spark, ids, quantity=1, lines=2):
    df = ids if hasattr(ids, "columns") else spark.createDataFrame([(i,) for i in ids], "id long")
    made = df.select(F.format_string("ORD-%06d", "id").alias("order_id"), F.explode(F.sequence(F.lit(1), F.lit(lines))).alias("n"))
    fields = schemas.curated_schema(ITEMS).names
    known = {"order_id": F.col("order_id"), "line_number": F.col("n")}
    return schemas.conform(made.select(*[known.get(f, F.lit(quantity)).alias(f) for f in fields]), ITEMS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def wh(spark):
    w = Warehouse(spark, prefix=f"p{uuid4().hex[:8]}_", rows_per_part={ITEMS: 50, "inventory.warehouse_stock": 5})
    w.create_schemas()
    return w


def files(wh):
    return {r.f for r in wh.table(ITEMS).select(F.input_file_name().alias("f")).distinct().collect()}


def test_ten_keys_rewrite_ten_of_many_parts(spark, wh):
    wh.rows_per_part[ITEMS] = 20
    wh.replace(ITEMS, items(spark, spark.range(0, 4_000)))
    before = {r.part for r in wh.parts(ITEMS).collect()}
    assert len(before) >= 360
    feed = items(spark, range(5, 4_000, 400), quantity=7)
    want, old = rows(upsert_curated(wh.table(ITEMS), feed, ITEMS)), files(wh)
    assert rows(wh.merge_into(ITEMS, feed)) == want
    after = {r.part for r in wh.parts(ITEMS).collect()}
    assert 1 <= len(before - after) <= 11 and len(after - before) <= 11  # a Bloom filter may err
    assert len(old) == len(before) and len(old - files(wh)) == len(before - after)  # all other files keep their names


def test_new_keys_rewrite_nothing(spark, wh):
    wh.replace(ITEMS, items(spark, range(0, 400, 2)))
    before = {r.part for r in wh.parts(ITEMS).collect()}
    wh.merge_into(ITEMS, items(spark, range(1_000, 1_010)))
    assert before <= {r.part for r in wh.parts(ITEMS).collect()}
    assert wh.table(ITEMS).count() == 420


def test_merges_equal_the_plain_table(spark, wh):
    plain = Warehouse(spark, prefix=wh.prefix + "plain_")
    plain.create_schemas()
    feeds = [range(0, 100), range(50, 150), range(500, 505), [], range(0, 505, 7)]
    for n, ids in enumerate(feeds):
        feed = items(spark, ids, quantity=n)
        assert rows(wh.merge_into(ITEMS, feed, "s", n)) == rows(plain.merge_into(ITEMS, feed, "s", n))
        assert wh.applied(ITEMS) == {"s": n}
        assert wh.merge_into(ITEMS, items(spark, [1], 99), "s", n).where("quantity = 99").isEmpty()  # known already
    assert rows(spark.table(wh.prefix + ITEMS)) == rows(plain.table(ITEMS))
    assert wh.table(ITEMS).schema == schemas.curated_schema(ITEMS)


def test_null_keys_are_inserted_each_time(spark, wh):
    stock = "inventory.warehouse_stock"
    fields = schemas.curated_schema(stock)
    row = lambda w, s: tuple({"warehouse_id": w, "sku_id": s}.get(f.name) for f in fields)
    feed = spark.createDataFrame([row("W1", "S1"), row(None, "S1"), row("W1", None)], fields)
    wh.merge_into(stock, feed)
    assert wh.merge_into(stock, feed).count() == 5


def test_old_parts_go_with_the_last_state_that_names_them(spark, wh):
    for n in range(6):
        wh.merge_into(ITEMS, items(spark, [1, 2], n))
    fs, home = wh._files(f"{wh.root}/sales.db/order_items/data")
    assert len(wh._states(ITEMS)) == wh.keep_states
    assert len(fs.listStatus(home)) <= wh.keep_states + 2
    assert {r.quantity for r in wh.table(ITEMS).collect()} == {5}


def test_two_source_rows_for_a_stored_key_are_refused(spark, wh):
    wh.merge_into(ITEMS, items(spark, range(10)))
    with pytest.raises(Exception, match="more than one source row"):
        wh.merge_into(ITEMS, items(spark, [3]).union(items(spark, [3], 2)))
    assert {r.quantity for r in wh.table(ITEMS).collect()} == {1}


def test_a_source_is_asked_once(spark, wh):
    """A feed that differs each time it is read gives one consistent merge."""
    wh.merge_into(ITEMS, items(spark, range(20)))
    drawn = items(spark, range(20)).withColumn("quantity", (F.rand() * 1e6).cast("int"))
    done = wh.merge_into(ITEMS, drawn)
    assert rows(done) == rows(wh.table(ITEMS)) and done.count() == 40


def test_bloom_filter_misses_no_key():
    rng = np.random.default_rng(1)
    held, other = rng.integers(-(2**62), 2**62, 5_000), rng.integers(-(2**62), 2**62, 5_000)
    bloom = file_index.bloom_of(held)
    assert file_index.may_hold(bloom, held).all() and file_index.may_hold(bloom, other).mean() < 0.03
    assert not file_index.may_hold(file_index.bloom_of(held[:0]), other).any()


def test_parts_of_one_first_key_have_ranges_of_their_own(spark, wh):
    """Many keys share a first column; a feed is compared with the parts that its whole keys can be in."""
    stock, fields = "inventory.warehouse_stock", schemas.curated_schema("inventory.warehouse_stock")
    held = spark.createDataFrame([("W1", f"S{i:04d}", i, 0, None) for i in range(40)], fields)
    wh.replace(stock, held)
    ranges = sorted((r.low, r.high, r.rows) for r in wh.parts(stock).collect())
    assert sum(n for _, _, n in ranges) == 40 and len(ranges) >= 4
    assert all(high < low for (_, high, _), (low, _, _) in zip(ranges, ranges[1:]))
    assert 1 <= len(file_index.hit_parts(held.where("sku_id = 'S0007'"), wh.parts(stock), schemas.KEYS[stock])) <= 2
