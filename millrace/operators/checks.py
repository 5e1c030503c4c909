"""Data-quality checks. Each returns one row: check_name, check_result (PASS / WARN: .. / FAIL: ..), observed.

Fixed values: the names of the checks, their words PASS, WARN and FAIL, and the sentences behind them, which callers read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace import schemas
from millrace.operators.crm import live_customers

# Highest believable daily revenue per item and its look-back, fill rate, price bound.
MAX_DAILY_REVENUE, REVENUE_DAYS = 500000, 7
MIN_FILL_RATE, MAX_PRICE_FACTOR = "0.8", 10


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _row(name: str, one: DataFrame, passed: Column, otherwise: Column | str, observed: Column, good: Column | str = "PASS") -> DataFrame:
    bad = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    ok = F.lit(good) if isinstance(good, str) else good
    return one.select(
        F.lit(name).alias("check_name"),
        F.when(passed, ok).otherwise(bad).alias("check_result"),
        observed.cast("string").alias("observed"),
    )


def _count(df: DataFrame, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.where(where)).agg(F.count("*").alias("n"))


def _counts(named: Mapping[str, DataFrame]) -> DataFrame:
    """Several row counts side by side in one row."""
    tagged = [_count(df).select(F.lit(k).alias("k"), "n") for k, df in named.items()]
    both = reduce(DataFrame.unionByName, tagged)
    return both.agg(*[F.sum(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in named])


def _none_found(name: str, found: DataFrame, level: str, what: str) -> DataFrame:
    n = F.col("n")
    return _row(name, _count(found), n == 0, _text(f"{level}: ", n, f" {what}"), n)


def _unmatched(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    return many.select(key).join(one.select(key), key, "left_anti")


def skus_present(skus: DataFrame) -> DataFrame:
    n = F.col("n")
    one = _count(skus, F.col("status") == "ACTIVE")
    return _row("validate_skus", one, n > 0, "FAIL: SKUS table is empty after transform", n)


def stock_present(stock: DataFrame) -> DataFrame:
    n = F.col("n")
    return _row("validate_stock", _count(stock), n > 0, "FAIL: WAREHOUSE_STOCK has no records", n)


def items_have_headers(items: DataFrame, orders: DataFrame) -> DataFrame:
    return _none_found("validate_orders", _unmatched(items, orders, "order_id"), "WARN", "orphaned order items found")


def revenue_believable(summary: DataFrame, as_of: dt.date) -> DataFrame:
    """Highest revenue of one item and day in the week up to ``as_of``; without rows there is nothing to trust."""
    recent = summary.where(F.col("sale_date") >= F.lit(as_of - dt.timedelta(days=REVENUE_DAYS)))
    top = F.col("top")
    one = recent.agg(F.max("gross_revenue").alias("top"))
    return _row("validate_revenue", one, top < MAX_DAILY_REVENUE, "WARN: Unusually high daily revenue detected", top)


def no_deleted_customers(customers: DataFrame, raw_accounts: DataFrame) -> DataFrame:
    one = _counts({"curated": customers, "source": live_customers(raw_accounts)})
    same = F.col("curated") == F.col("source")
    return _row("validate_no_deleted_customers", one, same, "WARN: Customer count mismatch vs source", F.col("curated"))


def tickets_have_customers(tickets: DataFrame, customers: DataFrame) -> DataFrame:
    named = tickets.where(F.col("customer_id").isNotNull())
    unknown = _unmatched(named, customers, "customer_id")
    return _none_found("validate_ticket_customer_fk", unknown, "WARN", "tickets with unknown customer")


def pnl_margin_positive(pnl: DataFrame, accounts: DataFrame) -> DataFrame:
    """Lowest revenue minus expense over the periods; contra accounts count as neither."""
    kind, amount = F.col("account_type"), F.col("amount")
    signed = F.when(kind == "REVENUE", amount).when(kind == "EXPENSE", -amount).otherwise(F.lit(0))
    per_period = (
        pnl.join(accounts.select("account_id", "account_type"), "account_id")
        .groupBy("period")
        .agg(F.sum(signed).cast("decimal(18,2)").alias("margin"))
    )
    low = F.col("low")
    one = per_period.agg(F.min("margin").alias("low"))
    return _row("validate_pnl_balance", one, low > 0, "WARN: Some periods show negative gross margin", low)


def pnl_accounts_known(pnl: DataFrame, accounts: DataFrame) -> DataFrame:
    unknown = _unmatched(pnl, accounts, "account_id")
    return _none_found("validate_gl_coverage", unknown, "FAIL", "P&L entries with unknown GL account")


def purchase_suppliers_known(purchases: DataFrame, suppliers: DataFrame) -> DataFrame:
    unknown = _unmatched(purchases, suppliers, "supplier_id")
    return _none_found("validate_supplier_fk", unknown, "FAIL", "POs with unknown supplier")


def purchase_amounts_positive(purchases: DataFrame) -> DataFrame:
    negative = purchases.where((F.col("quantity") < 0) | (F.col("unit_cost") < 0))
    return _none_found("validate_po_amounts", negative, "FAIL", "POs with negative values")


def price_row_count(prices: DataFrame, skus: DataFrame, distributors: DataFrame) -> DataFrame:
    """One price row per active product and active distributor, checked by counting, not by pairing."""
    active = F.col("status") == "ACTIVE"
    one = _counts({"got": prices, "s": skus.where(active), "d": distributors.where(active)})
    one = one.select("got", (F.col("s") * F.col("d")).alias("expected"))
    got, expected = F.col("got"), F.col("expected")
    bad = _text("WARN: Expected ", expected, " but got ", got)
    return _row("validate_row_count", one, got == expected, bad, got, _text("PASS: ", expected, " rows as expected"))


def price_fill_rate(prices: DataFrame) -> DataFrame:
    one = prices.agg(F.count("*").alias("n"), F.count("listed_price").alias("priced"))
    enough = F.col("priced") >= F.lit(MIN_FILL_RATE).cast("decimal(2,1)") * F.col("n")
    return _row("validate_no_nulls", one, enough, "WARN: More than 20% of prices are NULL", F.col("priced"))


def price_range(prices: DataFrame) -> DataFrame:
    price = F.col("listed_price")
    odd = prices.where((price < 0) | (price > F.col("msrp") * MAX_PRICE_FACTOR))
    return _none_found("validate_price_range", odd, "FAIL", "rows with suspicious prices")


def length_contract(df: DataFrame, limits: Mapping[str, int] = schemas.PRICE_TEXT_LENGTHS) -> DataFrame:
    """Text values longer than their column allows, over all columns in one pass."""
    too_long = [F.coalesce((F.length(c) > n).cast("int"), F.lit(0)) for c, n in limits.items()]
    one = df.agg(F.coalesce(F.sum(reduce(Column.__add__, too_long)), F.lit(0)).alias("n"))
    n = F.col("n")
    return _row("length_contract", one, n == 0, _text("FAIL: ", n, " values longer than their column"), n)


def key_health(df: DataFrame, table: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Keys that are NULL or held by more than one row: what a merge would re-insert or refuse."""
    keys = list(keys or schemas.KEYS[table])
    any_null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    per_key = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    one = per_key.agg(
        F.coalesce(F.sum(F.when(any_null, F.col("rows"))), F.lit(0)).alias("nulls"),
        F.count(F.when(~any_null & (F.col("rows") > 1), F.lit(1))).alias("clashes"),
    )
    nulls, clashes = F.col("nulls"), F.col("clashes")
    bad = _text("WARN: ", nulls, " rows with a NULL key, ", clashes, " keys held by several rows")
    return _row(f"key_health {table}", one, (nulls == 0) & (clashes == 0), bad, nulls + clashes)


def key_collisions(name: str, raw: DataFrame, raw_key: str, short_key: Column) -> DataFrame:
    """Short keys that stand for several source keys, because numbers are cut to a fixed width."""
    keyed = raw.select(short_key.alias("short"), F.col(raw_key).alias("full"))
    per_key = keyed.groupBy("short").agg(F.min("full").alias("low"), F.max("full").alias("high"))
    found = per_key.where(F.col("low") != F.col("high"))
    return _none_found(f"key_collisions {name}", found, "WARN", "short keys stand for several source keys")
