"""Sharding by sampled splitters: shards of near equal bytes that are runs of one global order.

Rows are ordered by the hash of their text, then of their id, so equal texts lie side by side and a group of copies
of any size can still be divided. A size-weighted sample gives the splitters of many small ranges; ranges that turn
out overfull are sampled again and divided. Each range is counted exactly, so the place of every row in the global
order, in rows and bytes, is known, and the shard is the part of the total in which a row starts.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millrace.session import cut_lineage

#: Rows that one range should hold, sample rows drawn for each range, and rounds of dividing overfull ranges.
ROWS_PER_RANGE, SAMPLE_PER_RANGE, ROUNDS = 250_000, 24, 8
_KEY = ["k1", "k2", "k3"]


def _sample(rows: DataFrame, n: int) -> list[tuple[int, int, int]]:
    """``n`` keys, each row drawn with a chance that grows with its size: the n smallest of -ln(u) / size.

    ``u`` comes from the row's key, so a repeated task draws the same rows.
    """
    u = (F.pmod(F.xxhash64(F.lit(11), *_KEY), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = rows.select(*_KEY, (-F.log(u) / F.col("size")).alias("p")).orderBy("p", *_KEY).limit(n)
    return sorted((r.k1, r.k2, r.k3) for r in drawn.collect())


def _quantiles(keys: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int, int]]:
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if len(keys) >= parts else list(keys)


def _in_ranges(rows: DataFrame, splitters: list[tuple[int, int, int]]) -> DataFrame:
    """``rows`` with the number of the range that holds each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _KEY))
            places = pa.array([bisect_right(splitters, key) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, places], [*batch.schema.names, "part"])

    return rows.mapInArrow(run, rows.withColumn("part", F.lit(0)).schema)


def shard(
    docs: DataFrame,
    n_shards: int = 8,
    doc_id: str = "doc_id",
    text: str = "text",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes and one more; NULL has none), text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: the shards' sizes differ by less than the largest row. Slots count from 0 in each shard
    without a gap. NULL texts count as empty; NULL ids and repeated rows are rows like any other, told apart by a
    number given when the keys are first written. An empty table gives no rows. Columns other than the two named
    are left out. No range is sorted by more than one task, and none holds more than about twice ``rows_per_range``.
    """
    t, d = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    size = F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(t, F.lit("")).cast("binary"))
    rows = docs.select(
        d.alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
        F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(5), d).alias("k2"), F.monotonically_increasing_id().alias("k3"),
    )
    rows = cut_lineage(rows)  # fixes k3, and later passes read only these few columns
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(4 * n_shards, math.ceil(n / rows_per_range))
    splitters = _quantiles(_sample(rows, parts * SAMPLE_PER_RANGE), parts)
    counts: dict[int, tuple[int, int]] = {}
    for _ in range(ROUNDS):
        placed = _in_ranges(rows, splitters)
        counted = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
        counts = {r.part: (r.n, r.b) for r in counted}
        over = [p for p, (m, b) in counts.items() if m > 1 and (m > 2 * rows_per_range or b > 2 * total / parts)]
        more: set[tuple[int, int, int]] = set()
        if over:
            cut = 2 * math.ceil(max(max(counts[p][0] / rows_per_range, counts[p][1] * parts / total) for p in over))
            drawn = _sample(placed.where(F.col("part").isin(over)), len(over) * cut * SAMPLE_PER_RANGE)
            by_part: dict[int, list[tuple[int, int, int]]] = {}
            for key in drawn:
                by_part.setdefault(bisect_right(splitters, key), []).append(key)
            more = {key for keys in by_part.values() for key in _quantiles(keys, cut)} - set(splitters)
        if not more:
            break
        splitters = sorted({*splitters, *more})
    before_rows, before_bytes, starts = 0, 0, []
    for part in range(len(splitters) + 1):
        starts.append((part, before_rows, before_bytes))
        before_rows += counts.get(part, (0, 0))[0]
        before_bytes += counts.get(part, (0, 0))[1]
    spark = docs.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, rows_before long, bytes_before long"))
    order = Window.partitionBy("part").orderBy(*_KEY)
    ranked = _in_ranges(rows, splitters).withColumns(
        {"i": F.row_number().over(order), "b": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))}
    )
    at_row = F.col("rows_before") + F.col("i") - 1
    at_byte = F.col("bytes_before") + F.col("b") - F.col("size")
    placed = ranked.join(offsets, "part").select(
        "doc_id", "size", "text_crc32", at_byte.cast("long").alias("byte"), at_row.cast("long").alias("row")
    )
    placed = placed.withColumn("shard", F.expr(f"cast(byte * {n_shards}L div {max(total, 1)}L AS int)"))
    placed = cut_lineage(placed)
    firsts = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    first = F.element_at(F.array(*[F.lit(firsts.get(s, 0)).cast("long") for s in range(n_shards)]), F.col("shard") + 1)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
