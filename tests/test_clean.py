from decimal import Decimal as D

import datetime as dt
import pytest
from pyspark.sql import functions as F

from millrace.functions import clean, codes


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, s string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_to_int(spark):
    got = values(spark, clean.to_int, ["12", " 7 ", "12.5", "-12.5", "12.49", "n/a", "", None, "3000000000", "1e2", "-0"])
    assert got == [12, 7, 13, -13, 12, None, None, None, None, 100, 0]


def test_to_decimal(spark):
    got = values(spark, lambda c: clean.to_decimal(c, 10, 2), ["12.345", "1,299.00", "$5", "None", "5", "123456789.00", None])
    assert got == [D("12.35"), None, None, None, D("5.00"), None, None]


def test_to_number_drops_the_fraction(spark):
    assert values(spark, clean.to_number, ["69999.5", "x"]) == [D(70000), None]


def test_to_date_wants_a_full_date(spark):
    got = values(spark, clean.to_date, ["2024-02-29", "2023-02-29", "2024", "2024-1-5", "2024-01-5 ", "TBD", "", None, "2024-01-05\n"])
    assert got == [dt.date(2024, 2, 29)] + [None] * 8


def test_day_of(spark):
    assert values(spark, clean.day_of, ["2024-01-05T09:30:00Z", "2024-01"]) == [dt.date(2024, 1, 5), None]


def test_to_timestamp(spark):
    got = values(spark, clean.to_timestamp, ["2024-01-05 08:00:00", "2024-13-01 00:00:00", "soon", None])
    assert got == [dt.datetime(2024, 1, 5, 8), None, None, None]


def test_title_case_breaks_at_punctuation(spark):
    got = values(spark, clean.title_case, ["BACK ORDERED", "on_hold x", "re-sent/LATE", "o.k.", "", None, "ÉTÉ fini"])
    assert got == ["Back Ordered", "On_Hold X", "Re-Sent/Late", "O.K.", "", None, "Été Fini"]


def test_keys_are_padded_and_cut_only_when_asked(spark):
    assert values(spark, clean.sku_key, ["7", "123456", None]) == ["SKU-00007", "SKU-123456", None]
    assert values(spark, lambda c: clean.sku_key(c, cut_keys=True), ["123456"]) == ["SKU-12345"]
    ids = ["500Dn000000000042", "500Dn000000012345", "none", None]
    assert values(spark, lambda c: clean.number_key("TKT-", c, 4), ids) == ["TKT-0042", "TKT-12345", "TKT-none", None]
    assert values(spark, lambda c: clean.number_key("TKT-", c, 4, cut_keys=True), ids[:2]) == ["TKT-0042", "TKT-2345"]
    assert values(spark, clean.order_customer_key, ["ACCT-5"]) == ["CUST-5"]
    assert values(spark, clean.crm_customer_key, ["001Dn00000A0042"]) == ["CUST-2000042"]


def test_month_period(spark):
    assert values(spark, clean.month_period, ["APR-2025", "DEC-1999", "XXX-2025", None]) == ["2025-04", "1999-12", None, None]


@pytest.mark.parametrize(
    "name,short",
    [("Acme Co., Inc.", "Acme"), ("Acme, Inc.", "Acme"), ("Acme Corp.", "Acme"), ("Acme Corporation", "Acme"), ("Inc. Acme", "Inc. Acme")],
)
def test_legal_suffix(spark, name, short):
    assert values(spark, lambda c: clean.strip_suffix(c, codes.LEGAL_SUFFIX), [name]) == [short]


def test_channel_suffix(spark):
    got = values(spark, lambda c: clean.strip_suffix(c, codes.CHANNEL_SUFFIX), ["Sales - Direct", "Sales-Marketplace", "Direct"])
    assert got == ["Sales", "Sales", "Direct"]


def test_brand(spark):
    got = values(spark, clean.brand_of, ["The VITAMIX Corp.", "Whirlpool Corporation", "Acme Tools", "Sony and Bose", None])
    assert got == ["Vitamix", "KitchenAid", "Acme", "Sony", None]


def test_map_code_default(spark):
    got = values(spark, lambda c: clean.map_code(c, codes.COUNTRY, c), ["JP", "DE", None])
    assert got == ["Japan", "DE", None]
    assert values(spark, lambda c: clean.map_code(c, codes.PAYMENT_TERMS, codes.DEFAULT_TERMS), [None, "Z060"]) == ["NET-30", "NET-60"]


def test_pounds(spark):
    df = spark.createDataFrame([("10", "KG"), ("10", "LBS"), ("10", None), ("", "KG")], "w string, u string")
    got = [r[0] for r in df.select(clean.pounds(F.col("w"), F.col("u"))).collect()]
    assert got == [D("22.0462000"), D("10.0000000"), D("10.0000000"), None]
