import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from millrace.operators import checks


def result(df):
    rows = df.collect()
    assert len(rows) == 1 and df.columns == ["check_name", "check_result", "observed"]
    return rows[0].check_result


def test_presence(spark):
    skus = spark.createDataFrame([("a", "INACTIVE")], "sku_id string, status string")
    assert result(checks.skus_present(skus)).startswith("FAIL")
    assert result(checks.stock_present(skus)) == "PASS"
    assert result(checks.stock_present(skus.limit(0))).startswith("FAIL")


def test_orphans(spark):
    items = spark.createDataFrame([("1",), ("2",), (None,)], "order_id string")
    orders = spark.createDataFrame([("1",)], "order_id string")
    assert result(checks.items_have_headers(items, orders)) == "WARN: 2 orphaned order items found"


def test_revenue(spark):
    summary = spark.createDataFrame([(dt.date(2024, 1, 10), D("499999.99")), (dt.date(2024, 1, 1), D("900000.00"))],
                                    "sale_date date, gross_revenue decimal(18,2)")
    assert result(checks.revenue_believable(summary, dt.date(2024, 1, 12))) == "PASS"
    assert result(checks.revenue_believable(summary, dt.date(2024, 1, 9))) == "PASS"
    assert result(checks.revenue_believable(summary, dt.date(2024, 1, 8))).startswith("WARN")  # the seventh day counts
    assert result(checks.revenue_believable(summary, dt.date(2025, 1, 1))).startswith("WARN")  # nothing to look at


def test_customers(spark):
    raw = spark.createDataFrame([(False, "customer x"), (True, "Customer"), (None, "Customer"), (False, "Prospect")],
                                "is_deleted boolean, account_type string")
    assert result(checks.no_deleted_customers(spark.range(1), raw)) == "PASS"
    assert result(checks.no_deleted_customers(spark.range(2), raw)).startswith("WARN")
    tickets = spark.createDataFrame([("c1",), (None,), ("c9",)], "customer_id string")
    known = spark.createDataFrame([("c1",)], "customer_id string")
    assert result(checks.tickets_have_customers(tickets, known)) == "WARN: 1 tickets with unknown customer"


def test_finance(spark):
    accounts = spark.createDataFrame([("r", "REVENUE"), ("e", "EXPENSE"), ("c", "CONTRA")], "account_id string, account_type string")
    pnl = spark.createDataFrame([("1", "r", D(5)), ("1", "e", D(4)), ("1", "c", D(-9)), ("2", "r", D(1))],
                                "period string, account_id string, amount decimal(18,2)")
    assert result(checks.pnl_margin_positive(pnl, accounts)) == "PASS"
    worse = pnl.union(spark.createDataFrame([("2", "e", D(1)), ("2", "x", D(1))], pnl.schema))
    assert result(checks.pnl_margin_positive(worse, accounts)).startswith("WARN")
    assert result(checks.pnl_accounts_known(worse, accounts)) == "FAIL: 1 P&L entries with unknown GL account"


def test_purchases(spark):
    po = spark.createDataFrame([("s1", 1, D(1)), (None, -1, D(1)), ("s2", None, D(-1))], "supplier_id string, quantity int, unit_cost decimal(10,2)")
    suppliers = spark.createDataFrame([("s1",)], "supplier_id string")
    assert result(checks.purchase_suppliers_known(po, suppliers)) == "FAIL: 2 POs with unknown supplier"
    assert result(checks.purchase_amounts_positive(po)) == "FAIL: 2 POs with negative values"


def test_prices(spark):
    schema = "sku_id string, listed_price decimal(10,2), msrp decimal(10,2)"
    rows = [("a", D(1), D(1)), ("b", D(2), D(1)), ("c", D(3), D(1)), ("d", D(4), D(1)), ("e", None, D(1))]
    prices = spark.createDataFrame(rows, schema)
    assert result(checks.price_fill_rate(prices)) == "PASS"
    assert result(checks.price_fill_rate(prices.where("sku_id > 'a'"))).startswith("WARN")
    assert result(checks.price_fill_rate(prices.limit(0))) == "PASS"
    odd = prices.union(spark.createDataFrame([("f", D(-1), None), ("g", D("10.01"), D(1)), ("h", D(99), None)], schema))
    assert result(checks.price_range(odd)) == "FAIL: 2 rows with suspicious prices"
    assert result(checks.price_range(prices)) == "PASS"
    on = spark.createDataFrame([("ACTIVE",)] * 5 + [("OFF",)], "status string")
    assert result(checks.price_row_count(prices, on, on.limit(1))) == "PASS: 5 rows as expected"
    assert result(checks.price_row_count(prices, on, on)) == "WARN: Expected 25 but got 5"


def test_contract_and_keys(spark):
    df = spark.createDataFrame([("abc", "x"), ("ab", None), (None, "xyz")], "a string, b string")
    assert result(checks.length_contract(df, {"a": 2, "b": 2})) == "FAIL: 2 values longer than their column"
    assert result(checks.length_contract(df, {"a": 3, "b": 3})) == "PASS"
    keys = spark.createDataFrame([("1", "a"), ("1", "a"), (None, "a"), (None, "a"), ("2", "b")], "k string, l string")
    assert result(checks.key_health(keys, "t", ["k", "l"])) == "WARN: 2 rows with a NULL key, 1 keys held by several rows"
    raw = spark.createDataFrame([("00001",), ("1",), ("000012",), ("000013",)], "n string")
    got = result(checks.key_collisions("x", raw, "n", F.lpad("n", 5, "0")))
    assert got == "WARN: 1 short keys stand for several source keys"  # all four come out as 00001
