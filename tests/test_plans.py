"""What the physical plans must and must not hold."""

import random
import re
from collections import defaultdict
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from millrace.plans import registered
from millrace import schemas
from millrace.operators import corpus, crm, inventory, sales

PLAIN = [n for n in registered.QUERIES if not n.startswith(("stream_", "warehouse_", "full_refresh"))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_product_joins(spark, small, name):
    text = plan(registered.QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_stock_limits_rows_before_the_shuffle(spark, small):
    text = plan(registered.QUERIES["warehouse_stock"](spark, small))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange hashpartitioning") == 1


def test_stock_sorts_and_shuffles_short_keys(spark, small):
    text = plan(registered.QUERIES["warehouse_stock"](spark, small))
    above = text[: text.index("Exchange hashpartitioning")]
    assert "WH-" in above and text.count("WH-") == above.count("WH-")  # keys are built of what is left
    sorts = [line for line in text.splitlines() if re.search(r"\bSort \[", line)]
    assert sorts and all(re.search(r"Sort \[_w\d+#", line) for line in sorts)  # the hash decides


def test_stock_by_key_with_nulls_and_repeated_rows(spark):
    picks, schema = random.Random(5), schemas.raw_schema("erp_warehouse_inventory")
    rows = [(picks.choice([None, "01", "02"]), picks.choice([None, "7", "8", "007"]), picks.choice([None, "3", "x", "12"]),
             picks.choice(["5", None]), picks.choice(["2024-01-02T00:00:00", "no", None]),
             picks.choice(["2024-01-02 03:00:00", "2024-01-01 00:00:00", "no", None])) for _ in range(120)]
    best = {}
    for place, item, count, level, day, at in rows * 2:
        day = (day or "")[:10] if day and day != "no" else ""
        rank = (at if at and at != "no" else "", day, int(count) if count and count != "x" else -1, int(level or -1))
        best[place, item] = max(best.get((place, item), rank), rank)
    expected = {(place and f"WH-{place}", item and f"SKU-{item.zfill(5)}", None if n < 0 else n, None if r < 0 else r, day or None)
                for (place, item), (_, day, n, r) in best.items()}
    got = inventory.warehouse_stock(spark.createDataFrame(rows * 2, schema)).collect()
    assert {(*r[:4], r[4] and str(r[4])) for r in got} == expected and len(got) == len(best)


def test_only_needed_columns_are_read(spark, small):
    df = registered.QUERIES["daily_sales_summary"](spark, small)
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in text


def test_filters_reach_the_scan(spark, tmp_path):
    schema = schemas.raw_schema("sap_purchase_orders")
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "po"))
    raw = spark.read.schema(schema).parquet(str(tmp_path / "po"))
    from millrace.operators import supply

    text = plan(supply.purchase_orders(raw))
    assert "EqualTo(po_line,10)" in text and "Exchange" not in text


def test_projections_do_not_shuffle(spark, small):
    for name in ("skus", "customers"):
        assert "Exchange hashpartitioning" not in plan(registered.QUERIES[name](spark, small))


def test_header_map_side_hashes(spark, small):
    text = plan(registered.QUERIES["sales_orders"](spark, small))
    assert "HashAggregate(keys=[order_number" in text and text.count("REPARTITION_BY_COL") == 1


def test_orders_with_one_hot_order(spark):
    """A third of all lines belong to one order; several headers and unknown states are in play."""
    picks = random.Random(3)
    states = ["ENTERED", "PROCESSING", "SHIPPED", "CLOSED", "BACK ORDERED", "on_hold", None]
    rows = []
    for i in range(3000):
        order = "hot" if picks.random() < 0.34 else str(picks.randrange(400))
        rows.append((order, str(i), "7", f"ACCT-{picks.randrange(2)}", f"2024-01-0{picks.randrange(1, 3)}T00:00:00Z", "WEB",
                     picks.choice(states[-3:] if order.endswith("7") else states), "", str(picks.randrange(9)), "1.50", "0"))
    df = spark.createDataFrame(rows, schemas.raw_schema("erp_sales_orders")).repartition(6)
    mapped = {"ENTERED": "PENDING", "PROCESSING": "PROCESSING", "SHIPPED": "SHIPPED", "CLOSED": "DELIVERED"}
    title = {"BACK ORDERED": "Back Ordered", "on_hold": "On_Hold", "ENTERED": "Entered", "PROCESSING": "Processing",
             "SHIPPED": "Shipped", "CLOSED": "Closed", None: None}
    lowest, groups = {}, defaultdict(list)
    for r in rows:
        if r[6] is not None:
            lowest[r[0]] = min(lowest.get(r[0], r[6]), r[6])
        groups[(r[0], r[3], r[4])].append(r)
    expected = set()
    for (order, account, day), lines in groups.items():
        low = lowest.get(order)
        own = [title[x[6]] for x in lines if title[x[6]]]
        status = mapped.get(low) or (max(own) if own else None)
        expected.add(("ORD-" + order, account.replace("ACCT", "CUST"), day[:10], sum(D("1.50") * int(x[8]) for x in lines), status))
    got = sales.orders(df).select("order_id", "customer_id", F.col("order_date").cast("string"), "total_amount", "status")
    assert {tuple(r) for r in got.collect()} == expected


def test_a_customer_with_a_third_of_all_cases_is_split(spark):
    cases = spark.range(60000).select(
        F.lpad(F.col("id").cast("string"), 8, "0").alias("sf_case_id"),
        F.concat(F.lit("001Dn00000A"), F.when(F.col("id") % 3 == 0, F.lit("7")).otherwise(F.col("id").cast("string"))).alias("sf_account_id"),
        F.lit("1").alias("product_sku"), F.lit("Defect").alias("case_type"), F.lit("Low").alias("case_priority"),
        F.lit("Open").alias("case_status"), F.lit("2024-01-01 00:00:00").alias("created_date"), F.lit(None).cast("string").alias("closed_date"),
    ).repartition(8)
    customers = spark.range(0, 60000, 7).select(F.concat(F.lit("CUST-200"), F.col("id").cast("string")).alias("customer_id"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "20",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = crm.support_tickets(cases, customers)
        rows = out.collect()
        text = plan(out)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(rows) == 60000
    hot = sum(r.customer_id == "CUST-2007" for r in rows)
    assert hot == 20001  # every third case, and the seventh, which is not among them
    assert "skew=true" in text


def test_unknown_rollup():
    with pytest.raises(ValueError):
        sales.orders(None, rollup="best")


def test_search_moves_no_page(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    phrases = spark.createDataFrame([("a.example", "b")], "domain string, phrase string")
    assert "Exchange" not in plan(corpus._phrase_hits(pages, phrases))
    df = registered.QUERIES["site_context"](spark, small)
    df.collect()
    assert plan(df).split("== Initial Plan ==")[0].count("Scan parquet") == 1  # what was found is written once
