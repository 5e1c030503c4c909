"""Shared helpers: words, hashes, row-by-row readers in Arrow batches, and tables kept in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words hashed by one task are kept until there are this many; then the table starts anew. It bounds memory only.
WORD_CACHE = 200_000

#: Rows read at once, so that what a task holds beside Arrow's batch stays small.
ROWS_AT_ONCE = 512

#: The white space that parts words.
SPACES = " \t\n\x0b\x0c\r"

#: Bits of one piece of a bitmap, as Spark's bitmap functions have it, and bits for each value in a bitmap of hashes.
PIECE_BITS, BITS_EACH = 32_768, 16

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def odd_numbers(seed: int, n: int, bits: int = 64) -> np.ndarray:
    """``n`` fixed odd multipliers drawn from ``seed``."""
    values = np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return values if bits == 64 else ((values >> np.uint64(64 - bits)) | np.uint64(1)).astype(np.uint32)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh_names(taken: Sequence[str], names: Sequence[str]) -> list[str]:
    """The ``names``, each with underscores behind it where ``taken`` has it (Spark compares names without case)."""
    held = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def per_text(
    df: DataFrame,
    make: Callable[[], Callable[[bytes], tuple]],
    fields: T.StructType,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    given: Sequence[str] = (),
) -> DataFrame:
    """The columns ``keep`` and what a reader returns for each text (UTF-8; NULL reads as empty).

    ``make`` is called once per task and returns the reader, which gets the text and the values of the columns
    ``given``. No shuffle; rows keep their partition.
    """
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    also = [F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(given)]
    narrow = df.select(*kept, *also, F.col(f"`{text}`").cast("binary").alias("text"))
    out = T.StructType(
        narrow.schema.fields[: len(keep)] + [T.StructField(f"v{i}", f.dataType) for i, f in enumerate(fields)]
    )
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = make()
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            texts = batch.column(batch.num_columns - 1)
            values = [batch.column(len(keep) + i).to_pylist() for i in range(len(given))]
            made = [read(x.as_py() or b"", *more) for x, *more in zip(texts, *values)]
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
            for i, kind in enumerate(arrow.types[len(keep) :]):
                columns.append(pa.array([row[i] for row in made], kind))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker lives on

    result = narrow.mapInArrow(run, out)
    names = [*keep, *fields.names]
    return result.toDF(*names)


def release(df: DataFrame) -> None:
    """Remove the files of a table that ``cut_lineage`` wrote, once nothing that is still to run reads it."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sweep(df: DataFrame) -> None:
    """Let Spark remove the shuffle files of tables that nothing refers to any more.

    Its cleaner acts on what the driver's collector has found, which on a large heap may be half an hour later; a job of
    many rounds would keep the shuffles of all of them on the executors' disks until then.
    """
    df.sparkSession.sparkContext._jvm.System.gc()


def hinted(df: DataFrame, key: str, ids: DataFrame, n: int, name: str) -> DataFrame:
    """``df`` with a column ``name``: false where ``key`` is surely none of the ``n`` values of the one column of ``ids``.

    One in sixteen of the others is true all the same, so an exact join has to follow. What meets in the driver and goes to
    every task is a bitmap of hashes, two bytes for each value in pieces of 4 KB, where a broadcast of the values takes
    some hundred. Rows stay where they are; a NULL key is hashed like any other.
    """
    pieces = max(1, -(-n * BITS_EACH // PIECE_BITS))
    place, bits = fresh_names([*df.columns, name], ["__place", "__bits"])
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(pieces * PIECE_BITS))
    at = ids.select(bit(F.col(f"`{ids.columns[0]}`")).alias("at"))
    table = at.groupBy(F.shiftright("at", 15).alias(place)).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(PIECE_BITS - 1))).alias(bits))
    here = bit(F.col(f"`{key}`"))
    byte = F.substring(F.col(bits), (F.shiftright(here, 3).bitwiseAND(F.lit(PIECE_BITS // 8 - 1)) + 1).cast("int"), F.lit(1))
    found = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), here.bitwiseAND(F.lit(7)).cast("int")) == 1
    met = df.withColumn(place, F.shiftright(here, 15)).join(F.broadcast(table), place, "left")
    return met.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(found, F.lit(False)).alias(name))


def row_key(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of the given columns: the identity of a row where ids may be NULL or repeat.

    Rows that agree in all given columns share the key, and with it their result.
    """
    return [F.xxhash64(*columns), F.xxhash64(F.lit(977), *columns)]
