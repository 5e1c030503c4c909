"""Products, categories, distributors and stock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import clean, codes
from millrace.operators.numbering import global_row_number


def _active_goods(raw: DataFrame) -> DataFrame:
    return raw.where((F.col("item_type") == "FINISHED_GOOD") & (F.col("item_status") == "ACTIVE"))


def skus(raw: DataFrame) -> DataFrame:
    subtype = F.col("item_subtype")
    status = clean.map_code(F.col("item_status"), {"ACTIVE": "ACTIVE", "INACTIVE": "INACTIVE"}, "UNKNOWN")
    return _active_goods(raw).select(
        clean.sku_key(F.col("item_number")).alias("sku_id"),
        F.col("item_description").alias("product_name"),
        clean.brand_of(F.col("manufacturer")).alias("brand"),
        F.col("upc_code").alias("upc"),
        clean.to_decimal(F.col("list_price"), 10, 2).alias("msrp"),
        clean.map_code(subtype, codes.SUBTYPE_CATEGORY, codes.OTHER_CATEGORY).alias("category"),
        clean.map_code(subtype, codes.SUBTYPE_NAME, subtype).alias("subcategory"),
        clean.pounds(F.col("weight"), F.col("weight_uom")).alias("weight_lbs"),
        status.alias("status"),
        clean.to_timestamp(F.col("created_date")).alias("created_at"),
    )


def product_categories(raw: DataFrame) -> DataFrame:
    """Two-level taxonomy of the subtypes in use, numbered with the parents first."""
    subtype = F.col("item_subtype")
    used = _active_goods(raw).select("item_subtype").distinct()
    classified = used.select(
        "item_subtype",
        clean.map_code(subtype, codes.SUBTYPE_CATEGORY, codes.OTHER_CATEGORY).alias("parent"),
        clean.map_code(subtype, codes.SUBTYPE_DEPARTMENT, codes.OTHER_DEPARTMENT).alias("department"),
    )
    # One row in, its parent row and its own row out: the feed is read once for both levels.
    levels = F.array(
        F.struct(
            F.col("parent").alias("category_name"),
            F.lit(None).cast("string").alias("parent_category"),
            "department",
        ),
        F.struct(
            clean.map_code(subtype, codes.SUBTYPE_NAME, subtype).alias("category_name"),
            F.col("parent").alias("parent_category"),
            "department",
        ),
    )
    both = classified.select(F.inline(levels)).distinct()
    order = [F.col("parent_category").asc_nulls_first(), F.col("category_name").asc_nulls_last(), F.col("department").asc()]
    numbered = global_row_number(both, order, "n")
    return numbered.select(
        clean.padded_key(codes.CATEGORY, F.col("n").cast("string"), 3).alias("category_id"),
        "category_name",
        "parent_category",
        "department",
    )


def distributors(raw: DataFrame) -> DataFrame:
    """Active partner contracts, numbered by their effective date text, then by domain."""
    active = raw.where(F.col("contract_status") == "ACTIVE")
    order = [F.col("effective_date").asc_nulls_last(), F.col("partner_domain").asc_nulls_last()]
    numbered = global_row_number(active, order, "n")
    return numbered.select(
        clean.padded_key(codes.DISTRIBUTOR, F.col("n").cast("string"), 3).alias("distributor_id"),
        clean.strip_suffix(F.col("partner_name"), codes.LEGAL_SUFFIX).alias("distributor_name"),
        F.col("partner_domain").alias("website_domain"),
        F.split_part(F.col("partner_region"), F.lit(" - "), F.lit(1)).alias("region"),
        F.col("channel_type").alias("channel"),
        F.col("tier_level").alias("partnership_tier"),
        clean.to_date(F.col("effective_date")).alias("contract_start"),
        clean.map_code(F.col("contract_status"), {"ACTIVE": "ACTIVE"}, "INACTIVE").alias("status"),
    )


def newest_snapshot(stock: DataFrame, keys: Sequence[str], ties: Sequence[Column] = ()) -> DataFrame:
    """The newest row per key by ``snapshot_ts``. An unreadable time never wins; equal times go by content, then by ``ties``.

    The hash in front of the keys changes no group. A sort compares eight bytes of its first column in place and fetches
    both rows where these agree: hardly ever for a hash, nearly always for a warehouse.
    """
    order = [F.col(c).desc_nulls_last() for c in ("snapshot_ts", "last_counted", "quantity_on_hand", "reorder_point")] + [*ties]
    newest = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)
    return stock.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def warehouse_stock(raw: DataFrame) -> DataFrame:
    """Keys are built of the newest rows only, so that the sorts and the shuffle see the short raw ones."""
    keys = ["facility_code", "item_number"]
    newest = newest_snapshot(raw.select(*keys, *_stock_values(), snapshot_time()), keys)
    return newest.select(*_stock_keys(), "quantity_on_hand", "reorder_point", "last_counted")


def snapshot_time() -> Column:
    return clean.to_timestamp(F.col("snapshot_ts")).alias("snapshot_ts")


def _stock_keys() -> list[Column]:
    return [
        clean.prefixed(codes.WAREHOUSE, F.col("facility_code")).alias("warehouse_id"),
        clean.sku_key(F.col("item_number")).alias("sku_id"),
    ]


def _stock_values() -> list[Column]:
    return [
        clean.to_int(F.col("on_hand_qty")).alias("quantity_on_hand"),
        clean.to_int(F.col("reorder_level")).alias("reorder_point"),
        clean.day_of(F.col("last_cycle_count")).alias("last_counted"),
    ]


def stock_columns(raw: DataFrame, *more: Column | str) -> DataFrame:
    return raw.select(*_stock_keys(), *_stock_values(), *more)
