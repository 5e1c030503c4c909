"""Suppliers and purchase orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import clean, codes


def _supplier_key(cut_keys: bool) -> Column:
    return clean.number_key(codes.SUPPLIER, F.col("vendor_number"), 3, cut_keys)


def suppliers(raw: DataFrame, cut_keys: bool = False) -> DataFrame:
    flag = F.col("deletion_flag")
    return raw.where((flag != "X") | flag.isNull() | (flag == "")).select(
        _supplier_key(cut_keys).alias("supplier_id"),
        F.col("vendor_name_1").alias("supplier_name"),
        clean.map_code(F.col("country_key"), codes.COUNTRY, F.col("country_key")).alias("country"),
        clean.to_int(F.col("avg_lead_time_days")).alias("lead_time_days"),
        clean.map_code(F.col("payment_terms_key"), codes.PAYMENT_TERMS, codes.DEFAULT_TERMS).alias("payment_terms"),
        clean.map_code(flag, {"X": "INACTIVE"}, "ACTIVE").alias("status"),
    )


def purchase_orders(raw: DataFrame, cut_keys: bool = False) -> DataFrame:
    """The first line of every purchase order."""
    return raw.where(F.col("po_line") == "10").select(
        clean.number_key(codes.PURCHASE, F.col("po_number"), 4, cut_keys).alias("po_id"),
        _supplier_key(cut_keys).alias("supplier_id"),
        clean.sku_key(F.col("material_number"), cut_keys).alias("sku_id"),
        clean.to_int(F.col("po_qty")).alias("quantity"),
        clean.to_decimal(F.col("net_price"), 10, 2).alias("unit_cost"),
        clean.to_date(F.col("doc_date")).alias("order_date"),
        clean.to_date(F.col("delivery_date")).alias("expected_date"),
        clean.map_code(F.col("po_status"), codes.PURCHASE_STATUS, F.col("po_status")).alias("status"),
    )
