"""Which files of a table can hold a key: the key range and a Bloom filter of each file.

A part is one file in a folder of its own, ``_part=<name>``, sorted by the key and never changed. The index has one row
for each part: its rows, its least and greatest whole key as text, and a Bloom filter of its keys. A merge asks the index
for the parts that its feed can hit, rewrites these and names all others again.

Keys travel as lists of hashes, a list for each part and Arrow batch, so that a task holds eight bytes for a key.
"""

from __future__ import annotations

import math
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks carry the code

PART = "_part"
INDEX = "part string, rows bigint, low string, high string, bloom binary"
_INDEX_ARROW = pa.schema([("part", pa.string()), ("rows", pa.int64()), ("low", pa.string()), ("high", pa.string()), ("bloom", pa.binary())])
#: Bits of a Bloom filter for each key and hash functions: about one false hit in a hundred.
_BITS, _HASHES = 10, 7


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def key_text(keys: Sequence[str]) -> Column:
    """The whole key as one text, by which parts are sorted and their ranges told: few parts share a first key column only."""
    return F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys])


def no_null(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each hash, one row for each hash function."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[None, :] + np.arange(_HASHES, dtype=np.uint64)[:, None] * step[None, :]) % np.uint64(bits)).astype(np.int64)


def bloom_of(hashes: np.ndarray) -> bytes:
    bits = max(64, 8 * math.ceil(_BITS * len(hashes) / 8))
    held = np.zeros(bits, bool)
    held[_places(hashes, bits).reshape(-1)] = True
    return np.packbits(held).tobytes()


def may_hold(bloom: bytes, hashes: np.ndarray) -> np.ndarray:
    held = np.unpackbits(np.frombuffer(bloom, np.uint8)).astype(bool)
    return held[_places(hashes, len(held))].all(axis=0)


def write_parts(rows: DataFrame, folder: str, keys: Sequence[str], parts: int, name: str) -> None:
    """Add ``rows`` to the folder as ``parts`` parts at most, in ranges of the key; equal keys stay together."""
    order = [key_text(keys), *[F.col(k) for k in keys]]
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    labelled = sorted_.withColumn(PART, F.concat(F.lit(f"{name}-"), F.spark_partition_id().cast("string")))
    labelled.write.mode("append").partitionBy(PART).parquet(folder)


def read_parts(spark: SparkSession, folder: str, schema, parts: Sequence[str]) -> DataFrame:
    """The rows of some parts with their part in ``_part``; no other file is listed or opened."""
    if not parts:
        return spark.createDataFrame([], schema).withColumn(PART, F.lit(None).cast("string"))
    reader = spark.read.schema(StructType([*schema.fields, StructField(PART, StringType())]))
    return reader.option("basePath", folder).parquet(*[f"{folder}/{PART}={p}" for p in parts])


def _parts_in(names: pa.Array) -> Iterator[tuple[str, pa.Array]]:
    """Each part in a column of part names, with the mask of its rows."""
    for part in pc.unique(names).to_pylist():
        yield part, pc.equal(names, part)


def index_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The index rows of the parts of ``rows``; only keys leave the tasks, as ranges and lists of hashes. A part is one group."""
    known = no_null(keys)
    narrow = rows.select(PART, F.when(known, key_text(keys)).alias("k"), F.when(known, key_hash(keys)).alias("h"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, mask in _parts_in(batch.column(PART)):
                own = batch.filter(mask)
                ends = pc.min_max(own.column("k")).as_py()
                row = [part], [own.num_rows], [ends["min"]], [ends["max"]], [pc.drop_null(own.column("h")).to_numpy().tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _INDEX_ARROW)], schema=_INDEX_ARROW)

    def made(group: pa.Table) -> pa.Table:
        hashes = np.frombuffer(b"".join(group.column("bloom").to_pylist()), np.int64)
        row = {
            "part": [group.column("part")[0].as_py()], "rows": [pc.sum(group.column("rows")).as_py()],
            "low": [pc.min(group.column("low")).as_py()], "high": [pc.max(group.column("high")).as_py()], "bloom": [bloom_of(hashes)],
        }
        return pa.table(row, schema=_INDEX_ARROW)

    return narrow.mapInArrow(packed, INDEX).groupBy("part").applyInArrow(made, INDEX)


def hit_parts(feed: DataFrame, index: DataFrame, keys: Sequence[str]) -> list[str]:
    """Names of the parts that may hold a key of ``feed``.

    Ranges of all parts go to every task: one row of some hundred bytes for each file. Keys that fall into a range
    meet the Bloom filter of that part, one group for each part, list by list until one hits. Names only come to the driver.
    """
    ranges = index.where("low is not null").select("part", "low", "high").toArrow()
    held = feed.sparkSession.sparkContext.broadcast([ranges.column(c).to_pylist() for c in ("part", "low", "high")])
    asked = feed.where(no_null(keys)).select(key_text(keys).alias("k"), key_hash(keys).alias("h"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lows, highs = held.value
        for batch in batches:
            batch = batch.sort_by("k")
            texts, hashes = batch.column("k").to_pylist(), batch.column("h").to_numpy()
            found = [(p, hashes[bisect_left(texts, low) : bisect_right(texts, high)]) for p, low, high in zip(parts, lows, highs)]
            found = [(p, some.tobytes()) for p, some in found if len(some)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["part", "h"])

    def tested(lists: pa.Table, filters: pa.Table) -> pa.Table:
        bloom = filters.column("bloom")[0].as_py()
        hit = any(may_hold(bloom, np.frombuffer(some.as_py(), np.int64)).any() for some in lists.column("h"))
        return pa.table({"part": filters.column("part").slice(0, 1 if hit else 0).combine_chunks()}, schema=pa.schema([("part", pa.string())]))

    pairs = asked.mapInArrow(inside, "part string, h binary")
    blooms = index.select(F.col("part"), "bloom")
    found = pairs.groupBy("part").cogroup(blooms.groupBy("part")).applyInArrow(tested, "part string")
    names = [r.part for r in found.collect()]
    held.destroy()
    return names
