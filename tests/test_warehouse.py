import datetime as dt
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators import checks, inventory, prices
from millrace.operators.upsert import upsert_curated
from millrace.plans import refresh
from millrace.sources.feeds import FEEDS, feed
from millrace.sources.tables import Warehouse


@pytest.fixture
def wh(spark):
    w = Warehouse(spark, prefix=f"t{uuid4().hex[:8]}_")
    w.create_schemas()
    return w


def test_merge_twice_gives_the_same_table(spark, small, wh):
    skus = inventory.skus(feed(spark, small, "raw_erp_products"))
    first = sorted(map(str, wh.merge_into("inventory.skus", skus).collect()))
    assert sorted(map(str, wh.merge_into("inventory.skus", skus).collect())) == first
    assert wh.table("inventory.skus").schema == schemas.curated_schema("inventory.skus")


def test_kept_id_survives_a_renumbering(spark, wh):
    raw = schemas.raw_schema("partner_contracts")
    row = lambda n, day: (f"P{n}", f"p{n}.example", "ASIA - X", "RETAIL", "GOLD", day, "ACTIVE")
    build = lambda rows: inventory.distributors(spark.createDataFrame(rows, raw))
    wh.merge_into("inventory.distributors", build([row(1, "2024-05-01")]))
    out = wh.merge_into("inventory.distributors", build([row(1, "2024-05-01"), row(2, "2024-01-01")]))
    # the second run numbers p2 first, but p1 keeps its id: both end up as 001
    assert {r.website_domain: r.distributor_id for r in out.collect()} == {"p1.example": "DIST-001", "p2.example": "DIST-001"}
    assert "WARN" in checks.key_health(out, "inventory.distributors", ["distributor_id"]).first().check_result


def test_a_failed_write_leaves_the_table(spark, wh):
    before = spark.createDataFrame([("a",)], "x string")
    wh.replace("raw.notes", before)
    with pytest.raises(Exception):
        wh.replace("raw.notes", before.selectExpr("raise_error('broken') AS x"))
    assert wh.table("raw.notes").collect() == before.collect()


def test_a_reader_of_the_table_can_replace_it(spark, wh):
    wh.replace("raw.notes", spark.createDataFrame([("a",)], "x string"))
    wh.replace("raw.notes", wh.table("raw.notes").selectExpr("concat(x, x) AS x"))
    assert [r.x for r in wh.table("raw.notes").collect()] == ["aa"]


def test_contract_default_and_types(spark, wh):
    assert wh.create_curated(prices.TABLE).count() == 0
    rows = spark.createDataFrame([("S1", "9.999")], "sku_id string, listed_price string")
    out = wh.full_refresh(prices.TABLE, rows, dt.datetime(2025, 1, 2, 3)).first()
    assert str(out.listed_price) == "10.00" and out.enriched_at == dt.datetime(2025, 1, 2, 3) and out.brand is None
    assert out.__fields__ == schemas.curated_schema(prices.TABLE).names


def test_use_a_schema(spark, wh):
    wh.replace("raw.notes", spark.createDataFrame([("a",)], "x string"))
    wh.use("raw")
    try:
        assert spark.table("notes").count() == 1
    finally:
        spark.sql("USE default")


def test_second_refresh_of_everything_changes_nothing(spark, small, wh):
    """Feeds from the raw schema through every domain, twice."""
    for name in FEEDS:
        wh.replace("raw." + name.removeprefix("raw_"), feed(spark, small, name))
    as_of, run_at = dt.date(2001, 11, 4), dt.datetime(2025, 4, 1)
    first_checks = refresh.refresh_all(wh, wh.raw, as_of, run_at).collect()
    names = [*schemas.KEYS, prices.TABLE]
    first = {n: sorted(map(str, wh.table(n).collect())) for n in names}
    assert all(first.values())
    assert refresh.refresh_all(wh, wh.raw, as_of, run_at).collect() == first_checks
    assert {n: sorted(map(str, wh.table(n).collect())) for n in names} == first
    assert len(first_checks) == 13


def test_only_the_newest_states_stay(spark, wh):
    for i in range(6):
        out = wh.replace("raw.notes", spark.range(i + 1))
    assert out.count() == 6 and len(wh._states("raw.notes")) == wh.keep_states
    assert wh._location("raw.notes") == wh._states("raw.notes")[-1]


def test_a_target_in_buckets_is_merged_without_a_shuffle(spark):
    w = Warehouse(spark, prefix=f"b{uuid4().hex[:8]}_", buckets={"inventory.warehouse_stock": 4})
    w.create_schemas()
    rows = spark.range(1000).selectExpr("concat('WH-', id % 3) AS warehouse_id", "concat('SKU-', id) AS sku_id", "CAST(id AS int) AS quantity_on_hand")
    w.merge_into("inventory.warehouse_stock", rows)
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    try:
        merged = upsert_curated(w.table("inventory.warehouse_stock"), rows.where("id < 9"), "inventory.warehouse_stock")
        text = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 1  # the feed's
    out = w.merge_into("inventory.warehouse_stock", rows.where("id < 9").withColumn("quantity_on_hand", F.lit(-1)))
    assert out.count() == 1000 and out.where("quantity_on_hand = -1").count() == 9
