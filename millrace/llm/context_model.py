"""LM scoring by prediction by partial matching over bytes.

The model reads a text as its lower-cased words, each with one space behind it, closed by a line feed. Spark counts every
run of ``order`` bytes and the byte after it in the rows to learn from; shorter contexts are sums of these counts.
Together they are the levels of a trie of contexts. A byte is looked for in its longest context; if that has not seen it,
an escape leads to the next shorter one, where bytes already ruled out no longer count, and at last to all bytes left
alike. The escape takes half a count from each byte that a context has seen, and nothing where no byte is left to escape to.

The logarithm of each (context, byte) that occurs anywhere is worked out once. The most frequent keys, at most
``BROADCAST_KEYS``, go to every task, which scores whole texts with them; of the other keys a text holds it gives
(row, key, times), and these few meet their values in a join. No text moves.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.rows import ROWS_AT_ONCE, mixed
from millrace.session import cut_lineage

ORDER, SMOOTHING = 5, 0.1
#: Keys with a value that go to every task, and rows of a table of short contexts that may be broadcast.
BROADCAST_KEYS, BROADCAST_CONTEXTS = 1_000_000, 70_000
#: Keys that a task reads at once and different ones that it counts, contexts worked out at once, and bytes of a text
#: read at once. They bound memory only.
_KEYS_AT_ONCE, _KEYS_COUNTED, _CONTEXTS_AT_ONCE, _SLICE = 500_000, 2_000_000, 256, 500_000

_END = b"\n"  # closes a text; no word holds it
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_WORD = np.uint64(1 << 63)  # keys of words have this bit, keys of contexts are below
_FIELDS = T.StructType().add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")


def held_out(doc_id: Column, parts: int = 10, part: int = 0) -> Column:
    """Whether a document is kept from learning: by the remainder of the crc32 of its id. One without an id is."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(True))


def windows(stream: bytes, size: int) -> np.ndarray:
    """Each run of ``size`` bytes as one number, put together from runs of one, two and four."""
    one = np.frombuffer(stream, np.uint8).astype(np.uint64)
    n = len(one) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, width = np.zeros(n, np.uint64), 0, 1
    runs = [one]
    while width * 2 <= size:
        runs.append((runs[-1][:-width] << np.uint64(8 * width)) | runs[-1][width:])
        width *= 2
    for run in reversed(runs):
        if done + width <= size:
            out = (out << np.uint64(8 * width)) | run[done : done + n]
            done += width
        width //= 2
    return out


class Reader:
    """Keys of the tokens of texts, and of their bytes with the ``order`` bytes before each, a bounded number at a time."""

    def __init__(self, order: int) -> None:
        if not 1 <= order <= 6:
            raise ValueError("order must be 1 to 6: a context and its byte are one 64-bit key")
        self.order = order

    def _pieces(self, text: bytes) -> Iterator[tuple[list[bytes], bytes]]:
        """Tokens and bytes of a text, the bytes with the context before them, slice by slice."""
        before, at = _END * self.order, 0
        while at <= len(text):
            end = at + _SLICE
            cut = _SPACE.search(text, end) if end < len(text) else None
            end = cut.start() if cut else len(text)
            words = text[at:end].lower().split()
            stream = before + b" ".join([*words, b""]) + (b"" if cut else _END)
            yield (words if cut else [*words, _END]), stream
            before, at = stream[-self.order :], end if cut else len(text) + 1

    def __call__(self, texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(owner, key) of the tokens and (owner, key) of the contexts; an owner is the number of a text."""
        held: list[tuple[int, list[bytes], bytes]] = []
        size = 0
        for at, text in enumerate(texts):
            for tokens, stream in self._pieces(text):
                held.append((at, tokens, stream))
                size += len(stream)
                if size >= _KEYS_AT_ONCE:
                    yield self._keys(held)
                    held, size = [], 0
        if held:
            yield self._keys(held)

    def _keys(self, held: list[tuple[int, list[bytes], bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        owner = np.array([at for at, _, _ in held])
        sizes = np.array([len(tokens) for _, tokens, _ in held])
        hashes = map(xxhash.xxh3_64_intdigest, chain.from_iterable(tokens for _, tokens, _ in held))
        tokens = np.fromiter(hashes, np.uint64, int(sizes.sum())) | _WORD
        lengths = np.array([len(stream) for _, _, stream in held])
        contexts = windows(b"".join(stream for _, _, stream in held), self.order + 1)
        inside = np.ones(len(contexts), bool)
        inside[(np.cumsum(lengths)[:-1, None] - np.arange(1, self.order + 1)[None, :]).reshape(-1)] = False
        return np.repeat(owner, sizes), tokens, np.repeat(owner, lengths - self.order), contexts[inside]


class Counted:
    """Different keys and how often each came, merged when they are many."""

    def __init__(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size >= 2 * _KEYS_COUNTED:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.empty(0, np.uint64), *self.keys])
        counts = np.concatenate([np.empty(0, np.int64), *self.counts])
        self.keys.clear()
        self.counts.clear()
        if len(keys):
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[start], np.add.reduceat(counts, start)
        self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return keys, counts

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        found = self.merged()
        self.__init__()
        return found


def _counted(order: int):
    """Arrow batches of (text, learns) to rows (key, c, m): how often a key stands in rows to learn from, and in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, counted = Reader(order), {True: Counted(), False: Counted()}

        def made(least: int) -> Iterator[pa.RecordBatch]:
            for learns, found in counted.items():
                if found.size >= least:
                    keys, m = found.taken()
                    for at in range(0, len(keys), 20_000):
                        k, n = pa.array(keys[at : at + 20_000].view(np.int64)), pa.array(m[at : at + 20_000], pa.int64())
                        c = n if learns else pa.array(np.zeros(len(n), np.int64))
                        yield pa.RecordBatch.from_arrays([k, c, n], ["key", "c", "m"])

        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            learns = batch.column(1).to_numpy(zero_copy_only=False)
            for which, found in counted.items():
                texts = batch.column(0).filter(pa.array(learns == which))
                for _, tokens, _, contexts in read(t.as_py() or b"" for t in texts):
                    found.add(tokens)
                    found.add(contexts)
            yield from made(_KEYS_COUNTED)
        yield from made(1)
        pa.default_memory_pool().release_unused()

    return run


def counts(docs: DataFrame, learns: Column, order: int = ORDER, text: str = "text") -> DataFrame:
    """(key, c, m) of all tokens and contexts of ``docs``: occurrences in rows to learn from, and in all rows. Keys of words are negative."""
    narrow = docs.select(F.col(f"`{text}`").cast("binary").alias("t"), F.coalesce(learns, F.lit(False)).alias("learns"))
    found = narrow.mapInArrow(_counted(order), "key long, c long, m long")
    return found.groupBy("key").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))


def _nodes(grams: DataFrame, name: str, *also: str) -> DataFrame:
    """(ctx, name): per context the bytes after it with their counts, at most 256 of them."""
    found = F.struct(F.col("g").bitwiseAND(255).alias("b"), "c", *also)
    return grams.groupBy(F.shiftright("g", 8).alias("ctx")).agg(F.collect_list(found).alias(name))


def log_probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value, m): log10 of the probability of the byte after its context, for each key of ``grams`` (key, c, m).

    The contexts of each length are joined by their last bytes. Those of at most two bytes, which many contexts share,
    are broadcast while there are at most ``BROADCAST_CONTEXTS`` of them, which is always so (65,536 and fewer).
    """
    grams = grams.select(F.col("key").alias("g"), "c", "m")
    asked = _nodes(grams, f"n{order}", "m")
    level = grams.where("c > 0")
    for j in range(order - 1, -1, -1):
        level = level.groupBy(F.col("g").bitwiseAND((1 << 8 * (j + 1)) - 1).alias("g")).agg(F.sum("c").alias("c"))
        level = cut_lineage(level)
        nodes = _nodes(level, f"n{j}").withColumnRenamed("ctx", "short")
        if j <= 2 and 256**j <= BROADCAST_CONTEXTS:
            nodes = F.broadcast(nodes)
        asked = asked.join(nodes, F.col("ctx").bitwiseAND((1 << 8 * j) - 1) == F.col("short"), "left").drop("short")
    return asked.select("ctx", *(f"n{j}" for j in range(order, -1, -1))).mapInArrow(_worked_out, "key long, value double, m long")


def chances(seen: Sequence[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each byte in each context: ``seen`` has their counts, the longest contexts first."""
    rows = len(seen[0])
    out, escape = np.zeros((rows, 256)), np.zeros(rows)
    gone = np.zeros((rows, 256), bool)
    for count in seen:
        count = np.where(gone, 0.0, count)
        here = count > 0
        total, kinds = count.sum(axis=1), here.sum(axis=1)
        left = 256 - gone.sum(axis=1) - kinds
        room = np.where(left > 0, kinds, 0)  # half a count of each byte is left to the escape
        share = (count - np.where(left > 0, 0.5, 0)[:, None]) / np.maximum(total, 1)[:, None]
        out = np.where(here, escape[:, None] + np.log10(np.where(here, share, 1)), out)
        escape = escape + np.where(room > 0, np.log10(np.maximum(room, 1) / 2 / np.maximum(total, 1)), 0)
        gone |= here
    left = np.maximum(256 - gone.sum(axis=1), 1)
    return np.where(gone, out, (escape - np.log10(left))[:, None])


def _worked_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, _CONTEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, _CONTEXTS_AT_ONCE)):
        rows = batch.num_rows
        seen, asked = [], None
        for i in range(1, batch.num_columns):
            column = batch.column(i)
            row = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
            flat = column.flatten()
            byte, c = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            table = np.zeros((rows, 256))
            table[row, byte] = c
            seen.append(table)
            asked = (row, byte, flat.field(2)) if asked is None else asked
        row, byte, m = asked
        key = (batch.column(0).to_numpy()[row] << 8) | byte
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(chances(seen)[row, byte]), m], ["key", "value", "m"])


class Values:
    """The values of some 64-bit keys: keys in the order of their hashes, and where each hash starts."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys = keys.view(np.uint64)
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        place = (mixed(keys) >> self.shift).astype(np.int64)
        order = np.argsort(place)
        sizes = np.bincount(place, minlength=1 << bits)
        self.depth = int(sizes.max())
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)  # a few million keys at most
        self.keys, self.values = keys[order], values[order]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, 0 where it has none, and whether it has one."""
        place = (mixed(keys) >> self.shift).astype(np.int64)
        at, end = self.starts[place], self.starts[place + 1]
        out, found, todo = np.zeros(len(keys)), np.zeros(len(keys), bool), np.arange(len(keys))
        for _ in range(self.depth):
            more = at < end
            at, end, todo = at[more], end[more], todo[more]
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            found[todo[hit]] = True
            at, end, todo = at[~hit] + 1, end[~hit], todo[~hit]
        return out, found


def scored(
    docs: DataFrame,
    learns: Column,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    order: int = ORDER,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """``keep`` and, per row: n_tokens, n_known, train_tokens, base_score and score, the log10 probability of the text.

    Learns from the rows where ``learns`` is true, scores all. Tokens are the lower-cased (A-Z) words and one end;
    base_score is that of single tokens with 0.1 added to each count. NULL and empty texts are an end only. Rows that
    repeat count as often as they stand there, and get the same scores. An empty table gives no rows; where nothing is
    learned every byte is as likely as any other, and base_score is that of a vocabulary of unknown words. A long text
    is read slice by slice. Columns not in ``keep`` are left out; one in it that has the name of a result is refused.
    Words count as one where 63 bits of their hashes agree.
    """
    if {c.lower() for c in keep} & {*_FIELDS.names, "train_tokens"}:
        raise ValueError("a column to keep has the name of a result")
    known = cut_lineage(counts(docs, learns, order, text))
    words = known.where("key < 0")
    size = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    whole = size.n + SMOOTHING * (size.v + 1)
    grams = log_probabilities(known.where("key >= 0"), order)
    values = cut_lineage(words.select("key", F.col("c").cast("double").alias("value"), "m").union(grams))
    least = _least_count(values, broadcast_keys)
    table = values.where(F.col("m") >= least).select("key", "value").toArrow()  # at most broadcast_keys rows
    shared = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("key", "value")))
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    narrow = docs.select(*kept, F.col(f"`{text}`").cast("binary").alias("t"))
    fields = [*narrow.schema.fields[: len(keep)], T.StructField("row", T.LongType()), *_FIELDS.fields]
    out = T.StructType([*fields, T.StructField("key", T.LongType()), T.StructField("times", T.LongType())])
    found = narrow.mapInArrow(_scores(order, shared, whole, len(keep), to_arrow_schema(out)), out)
    if least > 1:
        found = cut_lineage(found)  # rows must keep their numbers
        met = found.where("key is not null").select("row", "key", "times").join(values.where(F.col("m") < least), "key")
        met = met.groupBy("row").agg(
            F.sum(F.when((F.col("key") < 0) & (F.col("value") > 0), F.col("times"))).alias("known"),
            F.sum(F.when(F.col("key") < 0, F.log10((F.col("value") + SMOOTHING) / whole) * F.col("times"))).alias("base"),
            F.sum(F.when(F.col("key") >= 0, F.col("value") * F.col("times"))).alias("more"),
        )
        found = found.where("key is null").drop("key", "times").join(met, "row", "left")
        for name, part in (("n_known", "known"), ("base_score", "base"), ("score", "more")):
            found = found.withColumn(name, F.col(name) + F.coalesce(part, F.lit(0)))
    return found.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_tokens", "n_known",
        F.lit(size.n).cast("long").alias("train_tokens"), "base_score", "score",
    )


def _least_count(values: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` keys occur that often; 64 rows at most come to the driver."""
    level = F.floor(F.log2("m")).cast("int")
    sizes = values.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    total, least = 0, 1 << max((r.level for r in sizes), default=0) + 1
    for r in sorted(sizes, reverse=True):
        total += r.n
        if total > most:
            return least
        least = 1 << r.level
    return 1


def _scores(order: int, shared, whole: float, width: int, arrow: pa.Schema):
    """Arrow batches of kept columns and text to their sums over the shared keys, and rows (row, key, times) of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, values = Reader(order), Values(*shared.value)
        first = TaskContext.get().partitionId() << 33

        def added(owner: np.ndarray, keys: np.ndarray, words: bool, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Adds to the columns n_tokens, n_known and base_score, or score, of ``sums``."""
            value, found = values(keys)
            rows = len(sums)
            if words:
                sums[:, 0] += np.bincount(owner, minlength=rows)
                sums[:, 1] += np.bincount(owner, value > 0, rows)
                value = np.where(found, np.log10((value + SMOOTHING) / whole), 0.0)
            sums[:, 2 if words else 3] += np.bincount(owner, value, rows)
            if not found.all():
                keys, owner = keys[~found], owner[~found]
                at = np.lexsort([keys, owner])
                keys, owner = keys[at], owner[at]
                start = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
                times = np.diff(np.append(start, len(keys)))
                made = {"row": pa.array(first + owner[start]), "key": pa.array(keys[start].view(np.int64)), "times": pa.array(times, pa.int64())}
                columns = [made[f.name] if f.name in made else pa.nulls(len(start), f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            sums = np.zeros((batch.num_rows, 4))
            for token_owner, tokens, owner, contexts in read(t.as_py() or b"" for t in batch.column(width)):
                yield from added(token_owner, tokens, True, sums)
                yield from added(owner, contexts, False, sums)
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(width)]
            columns.append(pa.array(first + np.arange(batch.num_rows)))
            columns += [pa.array(sums[:, i]).cast(arrow.field(width + 1 + i).type) for i in range(4)]
            columns += [pa.nulls(batch.num_rows, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            first += batch.num_rows
        pa.default_memory_pool().release_unused()

    return run
