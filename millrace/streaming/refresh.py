"""Orders and stock kept fresh from files that arrive over time, in the one curated table that batch runs also merge into.

Each micro-batch merges into the published state of the table, whatever stream or batch run wrote it, and the new state
says which batch of which stream it holds (``Warehouse.replace``). A batch that is run again after a failure is known to
be there and changes nothing. A new checkpoint is a new stream: it starts from the published state and loses no row. What
the curated table cannot say, the parts of an order's total and the time of a snapshot, stands in a table beside it;
kept in parts (``Warehouse.rows_per_part``), a batch rewrites only the files that its keys can be in. One writer at a time
may merge into a table.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace import schemas
from millrace.functions import clean, codes
from millrace.operators import inventory
from millrace.session import cut_lineage
from millrace.sources.tables import Warehouse

ORDERS, TOTALS, FILES = "sales.orders", "sales.order_totals", "sales.order_files"
STOCK, STOCK_TIMES = "inventory.warehouse_stock", "inventory.warehouse_stock_times"
#: Rows of a part for all tables that streams keep: see ``Warehouse.rows_per_part``.
PARTS = {t: 250_000 for t in (ORDERS, TOTALS, FILES, STOCK, STOCK_TIMES)}
_FILE, _CAME = "__file", "__came"


def _run(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, str, int], None]) -> None:
    """Process all input that is there, then stop. ``merge`` gets each batch, the id of the stream and of the batch.

    The id is made with the checkpoint and stays with it, so a fresh checkpoint in the same place has another one.
    """
    known, stream_id = threading.Event(), []

    def write(batch: DataFrame, batch_id: int) -> None:
        known.wait()
        merge(batch, stream_id[0], batch_id)

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stream_id.append(str(query.id))
    known.set()
    query.awaitTermination()


def read_feed(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A raw feed as a stream of parquet files."""
    reader = spark.readStream.schema(schemas.raw_schema(name))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _header() -> dict:
    return {
        "customer_id": clean.order_customer_key(F.col("customer_account")),
        "order_date": clean.day_of(F.col("order_entered_date")),
        "channel": F.col("sales_channel"),
    }


def order_totals(lines: DataFrame) -> DataFrame:
    """What a set of lines says about each order, in a form that can be added up: one row for each order."""
    status = F.col("line_status")
    amount = clean.to_decimal(F.col("unit_selling_price"), 12, 2) * clean.to_int(F.col("ordered_qty"))
    header = _header()
    found = lines.groupBy("order_number").agg(
        F.count("*").alias("lines"),
        F.sum(amount).alias("total_amount"),
        F.min(status).alias("lowest"),
        F.max(clean.title_case(status)).alias("own_status"),
        F.max(clean.day_of(F.col("actual_ship_date"))).alias("ship_date"),
        *[F.min(v).alias(f"{k}_low") for k, v in header.items()],
        *[F.max(v).alias(f"{k}_high") for k, v in header.items()],
        *[F.count(v).alias(f"{k}_known") for k, v in header.items()],
    )
    fields = schemas.stored_schema(TOTALS).fields
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def added_totals(one: DataFrame, other: DataFrame) -> DataFrame:
    """The totals of two sets of lines together."""
    both = one.unionByName(other)
    how = {"lines": F.sum, "total_amount": F.sum, "lowest": F.min, "own_status": F.max, "ship_date": F.max}
    how |= {f"{k}_{end}": f for k in _header() for end, f in (("low", F.min), ("high", F.max), ("known", F.sum))}
    added = both.groupBy("order_number").agg(*[f(c).cast(both.schema[c].dataType).alias(c) for c, f in how.items()])
    return added.select(*one.columns)


def orders_of(totals: DataFrame) -> DataFrame:
    """The header row of each order. One whose lines disagree on the header has no single row to merge, and fails."""
    differs = F.lit(False)
    for k in _header():
        known = F.col(f"{k}_known")
        differs = differs | ((known > 0) & ((F.col(f"{k}_low") != F.col(f"{k}_high")) | (known != F.col("lines"))))
    refuse = F.raise_error(F.concat(F.lit("lines disagree on the header of order "), F.col("order_number")))
    order_id = clean.prefixed(codes.ORDER, F.col("order_number"))
    return totals.select(
        F.when(differs, refuse.cast("string")).otherwise(order_id).alias("order_id"),
        *[F.col(f"{k}_low").alias(k) for k in _header()],
        F.col("total_amount").cast("decimal(18,2)").alias("total_amount"),
        clean.map_code(F.col("lowest"), codes.ORDER_STATUS, F.col("own_status")).alias("status"),
        "ship_date",
    )


def _with_file(lines: DataFrame) -> DataFrame:
    """The lines with the file each came from; NULL where the stream is not made of files."""
    try:
        return lines.select("*", F.col("_metadata.file_path").alias(_FILE))
    except AnalysisException:
        return lines.withColumn(_FILE, F.lit(None).cast("string"))


def stream_orders(lines: DataFrame, wh: Warehouse, checkpoint: str) -> DataFrame:
    """Merge the orders touched by each batch into ``sales.orders``; returns the table after all input.

    Totals of all lines that streams have read stand in a table of their own, and a batch adds its lines to those of the
    orders it touches. A new checkpoint goes on from there: with only new files its totals are whole, and lines of files
    that another stream has counted are passed over. A file counts as read once the totals hold the batch that brought it.
    Lines that a batch run merged into ``sales.orders`` are in no total. An order number that is NULL is an order of its own.
    """

    def merge(batch: DataFrame, stream: str, batch_id: int) -> None:
        came = batch.where(f"{_FILE} is not null").select(F.col(_FILE).alias("file")).distinct()
        told = [F.lit(x) for pair in wh.applied(TOTALS).items() for x in pair]
        told = F.create_map(*told) if told else F.lit(None).cast("map<string,bigint>")
        counted = wh.rows_of(FILES, came).where(told[F.col("stream")] >= F.col("batch"))
        counted = cut_lineage(counted.where(~((F.col("stream") == stream) & (F.col("batch") == batch_id))).select("file"))
        # Names of files of one batch; a shuffle by file would leave all lines of a file to one task.
        new = batch.join(F.broadcast(counted), F.col(_FILE) == F.col("file"), "left_anti").drop(_FILE)
        files = came.join(counted, "file", "left_anti").withColumns({"stream": F.lit(stream), "batch": F.lit(batch_id).cast("bigint")})
        wh.update(FILES, files, _newest_file, stream, batch_id)
        with wh.staged(order_totals(new)) as totals:
            orders_of(totals).write.format("noop").mode("overwrite").save()  # lines that disagree fail before anything is added
            wh.update(TOTALS, totals, added_totals, stream, batch_id, written=True)
            wh.merge_into(ORDERS, orders_of(wh.rows_of(TOTALS, totals, written=True)), stream, batch_id)

    for name in (ORDERS, TOTALS, FILES):
        wh.create_curated(name)
    _run(_with_file(lines), checkpoint, merge)
    return wh.table(ORDERS)


def _newest_file(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("file"), "file", "left_anti").unionByName(new)


def stream_stock(snapshots: DataFrame, wh: Warehouse, checkpoint: str) -> DataFrame:
    """Keep the newest stock row in ``inventory.warehouse_stock``; a late file with an older snapshot changes nothing.

    The time of the newest snapshot is no column of that table, so a table beside it holds it with the row. It
    is written first; a batch that failed between the two writes repeats the second alone. Only keys whose newest row
    changed are written; a batch that changes none writes nothing. Rows whose key has a NULL
    match nothing in the stock table: each batch that brings some inserts the newest of them once more, as a merge does.
    """
    keys = schemas.KEYS[STOCK]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()

    def merge(batch: DataFrame, stream: str, batch_id: int) -> None:
        with wh.staged(inventory.newest_snapshot(inventory.stock_columns(batch, inventory.snapshot_time()), keys)) as taken:
            if wh.applied(STOCK_TIMES).get(stream, -1) >= batch_id:
                published(taken, wh.rows_of(STOCK_TIMES, taken, written=True), stream, batch_id)
                return
            old, hit = wh.stored(STOCK_TIMES, taken)
            both = old.withColumn(_CAME, F.lit(False)).unionByName(taken.withColumn(_CAME, F.lit(True)))
            with wh.staged(inventory.newest_snapshot(both, keys, [F.col(_CAME).asc()])) as newest:
                changed = newest.where(_CAME).drop(_CAME)  # of equal rows the stored one is kept
                if not changed.isEmpty():
                    wh.put(STOCK_TIMES, newest.drop(_CAME), hit, stream, batch_id)
                published(taken, changed, stream, batch_id)

    def published(taken: DataFrame, changed: DataFrame, stream: str, batch_id: int) -> None:
        again = wh.rows_of(STOCK_TIMES, taken.where(~known), written=True)
        with wh.staged(changed.where(known).unionByName(again).drop("snapshot_ts")) as merged:
            if not merged.isEmpty():
                wh.merge_into(STOCK, merged, stream, batch_id, written=True)

    for name in (STOCK, STOCK_TIMES):
        wh.create_curated(name)
    _run(snapshots, checkpoint, merge)
    return wh.table(STOCK)
