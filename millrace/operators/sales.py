"""Order headers, order lines and daily sales from the order and till feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.functions import clean, codes

ORDER_STAGE = list(codes.ORDER_STATUS)


def orders(raw: DataFrame, rollup: str = "alphabetical") -> DataFrame:
    """One header per order from the line feed.

    ``alphabetical`` maps the smallest line status of the order; one CLOSED line makes the order DELIVERED.
    ``severity`` lets the least advanced line decide. A status outside the map shows as the line's own, in
    title case. Lines are first summed per status with fixed-width buffers, so the map side hashes them
    without a sort and a huge order reaches the shuffle as a handful of rows.
    """
    if rollup not in ("alphabetical", "severity"):
        raise ValueError(f"unknown rollup {rollup!r}")
    lines = raw.select(
        "order_number",
        "customer_account",
        F.left("order_entered_date", F.lit(10)).alias("entered"),
        "sales_channel",
        "line_status",
        clean.day_of(F.col("actual_ship_date")).alias("ship_date"),
        (clean.to_decimal(F.col("unit_selling_price"), 12, 2) * clean.to_int(F.col("ordered_qty"))).alias("amount"),
    )
    per_status = lines.groupBy("order_number", "customer_account", "entered", "sales_channel", "line_status").agg(
        F.sum("amount").alias("amount"), F.max("ship_date").alias("ship_date")
    )
    header = ["order_number", "customer_id", "order_date", "channel"]
    # One layout serves both steps below: the look across the order and the grouping into headers.
    per_status = (
        per_status.select(
            "order_number",
            clean.order_customer_key(F.col("customer_account")).alias("customer_id"),
            clean.to_date(F.col("entered")).alias("order_date"),
            F.col("sales_channel").alias("channel"),
            "line_status",
            "amount",
            "ship_date",
        )
        .repartition("order_number")
        .sortWithinPartitions(*header)
    )
    status = F.col("line_status")
    whole_order = Window.partitionBy("order_number")
    if rollup == "alphabetical":
        mark, shown = status, status
    else:
        stages = {s: str(i) for i, s in enumerate(ORDER_STAGE, 1)}
        mark = clean.map_code(status, stages, "0")
        shown = F.when(~status.isin(ORDER_STAGE) | status.isNull(), status)
    by_mark = codes.ORDER_STATUS if rollup == "alphabetical" else {stages[s]: v for s, v in codes.ORDER_STATUS.items()}
    headers = (
        per_status.withColumn("lowest", F.min(mark).over(whole_order))
        .withColumn("status", clean.map_code(F.col("lowest"), by_mark, clean.title_case(shown)))
        .groupBy(*header)
        .agg(
            F.sum("amount").cast("decimal(18,2)").alias("total_amount"),
            F.max("status").alias("status"),
            F.max("ship_date").alias("ship_date"),
        )
    )
    return headers.select(
        clean.prefixed(codes.ORDER, F.col("order_number")).alias("order_id"),
        *header[1:],
        "total_amount",
        "status",
        "ship_date",
    )


def order_items(raw: DataFrame) -> DataFrame:
    return raw.select(
        clean.prefixed(codes.ORDER, F.col("order_number")).alias("order_id"),
        clean.to_int(F.col("order_line")).alias("line_number"),
        clean.sku_key(F.col("item_number")).alias("sku_id"),
        clean.to_int(F.col("ordered_qty")).alias("quantity"),
        clean.to_decimal(F.col("unit_selling_price"), 10, 2).alias("unit_price"),
        clean.to_decimal(F.col("line_discount_pct"), 5, 2).alias("discount_pct"),
    )


def daily_sales_summary(raw: DataFrame) -> DataFrame:
    """Units, revenue and returns per day and raw item. A line without a return flag counts as neither."""
    sold, returned = F.col("return_flag") == "N", F.col("return_flag") == "Y"
    units = clean.to_int(F.col("qty_sold"))
    amount = clean.to_decimal(F.col("sale_amount"), 12, 2)
    zero = F.lit(0)
    per_day = raw.groupBy(clean.day_of(F.col("transaction_ts")).alias("sale_date"), "item_number").agg(
        F.sum(F.when(sold, units).otherwise(zero)).alias("units_sold"),
        F.sum(F.when(sold, amount).otherwise(zero.cast("decimal(12,2)"))).alias("gross_revenue"),
        F.sum(F.when(returned, units).otherwise(zero)).alias("returns"),
    )
    return per_day.select(
        "sale_date",
        clean.sku_key(F.col("item_number")).alias("sku_id"),
        F.col("units_sold").cast("bigint").alias("units_sold"),
        F.col("gross_revenue").cast("decimal(18,2)").alias("gross_revenue"),
        F.col("returns").cast("bigint").alias("returns"),
    )
