"""Running numbers over a whole table without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.session import cut_lineage

_PART, _SLOT = "__part", "__slot"
_ROWS_PER_PART = 33  # monotonically_increasing_id keeps the row's place in its lower 33 bits


def global_row_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add 1..n in the given order.

    Rows are range-partitioned and sorted in parallel, then written once: the offsets counted from the
    written rows must fit the rows that get numbered. Only one count per partition meets in one place.
    Name every column that settles ties in ``order``, which also lets a hot first key spread.
    """
    return written_row_number(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def written_row_number(df: DataFrame, name: str) -> DataFrame:
    """Add 1..n in the order in which the rows lie, partition after partition; they are written once and stay as written."""
    return numbered(cut_lineage(placed(df)), name)


def placed(df: DataFrame) -> DataFrame:
    """The rows with their partition and their place in it: to be written once, before ``numbered`` counts them."""
    return df.withColumn(_PART, F.spark_partition_id()).withColumn(_SLOT, F.monotonically_increasing_id())


def numbered(written: DataFrame, name: str) -> DataFrame:
    """The written rows of ``placed`` with 1..n in the order in which they lay, however they are read."""
    sizes = written.groupBy(_PART).agg(F.count("*").alias("__rows"))
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_PART, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    slot = F.col(_SLOT) - F.shiftleft(F.col(_PART).cast("bigint"), _ROWS_PER_PART)
    return (
        written.join(F.broadcast(offsets), _PART)  # one row per partition
        .withColumn(name, (F.col("__before") + slot + 1).cast("bigint"))
        .drop(_PART, _SLOT, "__before")
    )
