"""Substring dedup: every run of 35 words that also starts anywhere else loses its words.

Each text gives the Rabin-Karp hash of every window of words. The hashes are counted in two steps, as an aggregation
with a map-side part. The texts that a task reads together are counted there: of a window that occurs twice or more
among them, one hash goes on, and its places are known to be repeated. What goes on meets in buckets chosen by a second,
independent hash, so a window of any number of copies takes one value from each such lot, and a bucket is bounded by the
different windows in it and the number of lots. Back to a text goes one bit for each of its windows in the bucket.
Flagged windows that touch or overlap merge into maximal intervals of words to remove.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.rows import WordHashes, fresh, mixed, odd_numbers, per_text, row_key

WINDOW = 35
#: Windows that one bucket should hold, the fewest buckets, and words that a task hashes at once.
WINDOWS_PER_BUCKET, MIN_BUCKETS, WORDS_AT_ONCE = 6_000_000, 16, 400_000
#: Bytes of text for each word, for the number of buckets only.
_BYTES_PER_WORD = 6

_BASES = [int(b) for b in odd_numbers(71, 2)]


class WindowHashes:
    """Rolling hashes of all windows of some words; sums and powers are taken modulo 2**64."""

    def __init__(self, window: int, buckets: int) -> None:
        self.window, self.buckets, self.words = window, buckets, WordHashes()
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in _BASES]

    def _powers(self, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.powers[k]
        if len(up) < n:
            inverse = pow(_BASES[k], -1, 1 << 64)
            up, down = (np.full(n, b, np.uint64) for b in (_BASES[k], inverse))
            up[0] = down[0] = 1
            self.powers[k] = up, down = np.cumprod(up), np.cumprod(down)
        return up[:n], down[:n]

    def _rolled(self, codes: np.ndarray, k: int) -> np.ndarray:
        n, size = len(codes), self.window
        up, down = self._powers(k, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * up, out=sums[1:])
        return mixed((sums[size:] - sums[:-size]) * down[: n - size + 1])

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and bucket of the window at each place of ``codes``, the hashes of its words."""
        codes = mixed(codes)
        buckets = (self._rolled(codes, 1) >> np.uint64(20)) % np.uint64(self.buckets)
        return self._rolled(codes, 0), buckets.astype(np.int32)


def _repeats(values: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows, by hash and bucket, occur twice or more, and which one stands for all that are equal to it."""
    order = np.argsort(values, kind="stable")
    ranked, place = values[order], buckets[order]
    same = (ranked[1:] == ranked[:-1]) & (place[1:] == place[:-1])
    after, before = np.append(same, False), np.append(False, same)
    known, first = np.zeros(len(values), bool), np.zeros(len(values), bool)
    known[order[after | before]] = True
    first[order[after & ~before]] = True
    return known, first


def _window_rows(window: int, buckets: int):
    """Arrow batches of (a, b, text) to rows (target, bucket, a, b, hashes, known), one for each text and bucket it has windows in.

    ``known`` has a bit for each of the text's windows there that is repeated among the texts read with it, and is NULL
    if none is. ``hashes`` are those of the other windows, then those that stand for all known places of a window.
    ``target`` is the bucket; rows without hashes have nothing to be counted and go to any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WindowHashes(window, buckets)

        def made(keys: list[tuple[int, int]], parts: list[np.ndarray]) -> pa.RecordBatch:
            codes = np.concatenate(parts)
            sizes = np.array([len(p) for p in parts])
            values, place = hashes.of(codes)
            owner = np.repeat(np.arange(len(parts)), sizes)
            ends = np.cumsum(sizes)
            inside = np.arange(len(values)) + window <= ends[owner[: len(values)]]
            values, group = values[inside], owner[: len(values)][inside] * np.int64(buckets) + place[inside]
            known, first = _repeats(values, group % buckets)
            order = np.argsort(group, kind="stable")
            values, group, known, first = values[order], group[order], known[order], first[order]
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
            some = np.add.reduceat(known, starts, dtype=np.int64) > 0
            masks: list[bytes | None] = [None] * len(starts)
            ends = np.append(starts[1:], len(values))
            for i in np.flatnonzero(some).tolist():
                masks[i] = np.packbits(known[starts[i] : ends[i]]).tobytes()
            sent = np.concatenate([np.flatnonzero(~known), np.flatnonzero(first)])  # those that stand for others come last
            sent = sent[np.argsort(row[sent], kind="stable")]
            sizes = np.bincount(row[sent], minlength=len(starts))
            offsets = (np.append(0, np.cumsum(sizes)) * 8).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values[sent])])
            key = np.array(keys, np.int64)[group[starts] // buckets]
            bucket = group[starts] % buckets
            target = np.where(sizes > 0, bucket, (key[:, 0] + bucket) % buckets).astype(np.int32)
            columns = [pa.array(target), pa.array(bucket.astype(np.int32)), pa.array(key[:, 0]), pa.array(key[:, 1])]
            columns += [blobs, pa.array(masks, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["target", "bucket", "a", "b", "hashes", "known"])

        keys: list[tuple[int, int]] = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (text.as_py() or b"").split()
                if len(words) < window:
                    continue
                keys.append((a, b))
                parts.append(hashes.words.of(words))
                held += len(words)
                if held >= WORDS_AT_ONCE:
                    yield made(keys, parts)
                    keys, parts, held = [], [], 0
        if parts:
            yield made(keys, parts)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket (or a few) to rows (a, b, bucket, mask): which of a text's windows there occur twice or more."""
    held = list(batches)
    if not held or not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held).combine_chunks()
    del held
    hashes = table.column("hashes").cast(pa.large_binary()).combine_chunks()
    offsets = np.frombuffer(hashes.buffers()[1], np.int64)[hashes.offset : hashes.offset + len(hashes) + 1] // 8
    data = hashes.buffers()[2]
    values = np.frombuffer(data, np.uint64, count=offsets[-1]) if data is not None else np.zeros(0, np.uint64)
    values, starts, ends = values[offsets[0] :], offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    bucket, known = table.column("bucket").to_numpy(), table.column("known")
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    many, _ = _repeats(values, np.repeat(bucket, ends - starts))
    sums = np.append(0, np.cumsum(many))
    hit = np.flatnonzero((sums[ends] > sums[starts]) | known.is_valid().to_numpy())
    for at in range(0, len(hit), 20_000):
        some = hit[at : at + 20_000]
        masks = []
        for i, mask in zip(some.tolist(), known.take(pa.array(some)).to_pylist()):
            flags = many[starts[i] : ends[i]]
            if mask is not None:
                bits = np.unpackbits(np.frombuffer(mask, np.uint8)).astype(bool)
                rest = np.flatnonzero(~bits)[: len(flags)]  # behind the text's last window there are unset bits
                bits[rest] = flags[: len(rest)]
                flags = bits
            masks.append(np.packbits(flags).tobytes())
        columns = [pa.array(a[some]), pa.array(b[some]), pa.array(bucket[some]), pa.array(masks, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "bucket", "mask"])


def _flagged(hashes: WindowHashes, words: list[bytes], masks: list[tuple[int, bytes]], window: int) -> np.ndarray:
    """Which words stand in a flagged window."""
    n = len(words)
    gone = np.zeros(n, bool)
    if masks and n >= window:
        _, place = hashes.of(hashes.words.of(words))
        edge = np.zeros(n + 1, np.int64)
        for bucket, mask in masks:
            starts = np.flatnonzero(place == bucket)
            flagged = starts[np.unpackbits(np.frombuffer(mask, np.uint8), count=len(starts)).astype(bool)]
            edge[flagged] += 1
            edge[flagged + window] -= 1
        gone = np.cumsum(edge[:n]) > 0
    return gone


def remove_repeated(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    windows_per_bucket: int = WINDOWS_PER_BUCKET,
    with_text: bool = True,
) -> DataFrame:
    """``keep`` and, per row: n_words, n_removed, kept_sha256, and with ``with_text`` the spans removed (start and end
    word of each maximal interval, flat) and the kept words joined by one space.

    Windows are judged on the input. NULL and empty texts have no words, and texts shorter than a window keep all. A
    repeated row is a copy like any other, so all its windows go; rows are told apart by hashes of id and text, and
    NULL ids are ids like any other. An empty table gives no rows. Two windows count as equal when their two hashes
    agree, 64 bits and a bucket number that grows with the data.
    """
    t = F.col(f"`{text}`")
    key_a, key_b = row_key(F.col(f"`{doc_id}`"), t)
    total = docs.agg(F.sum(F.octet_length(t))).first()[0] or 0
    buckets = max(MIN_BUCKETS, math.ceil(total / _BYTES_PER_WORD / windows_per_bucket))
    keyed = docs.select(key_a.alias("a"), key_b.alias("b"), t.cast("binary").alias("t"))
    columns = "target int, bucket int, a long, b long, hashes binary, known binary"
    rows = keyed.mapInArrow(_window_rows(window, buckets), columns)
    masks = rows.repartitionById(buckets, F.col("target")).mapInArrow(_repeated, "a long, b long, bucket int, mask binary")
    masks = masks.groupBy("a", "b").agg(F.collect_set(F.struct("bucket", "mask")).alias("masks"))  # windows of one text
    a, b, m = fresh(docs, "__a"), fresh(docs, "__b"), fresh(docs, "__masks")
    joined = docs.withColumns({a: key_a, b: key_b}).join(masks.toDF(a, b, m), [a, b], "left")
    fields = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if with_text:
        fields = fields.add("spans", T.ArrayType(T.LongType())).add("kept_text", "string")
    return per_text(joined, _reader(window, buckets, with_text), fields, keep, text, given=(m,))


def _reader(window: int, buckets: int, with_text: bool):
    def make():
        hashes = WindowHashes(window, buckets)

        def read(text: bytes, masks: list[dict] | None) -> tuple:
            words = text.split()
            gone = _flagged(hashes, words, [(m["bucket"], m["mask"]) for m in masks or []], window)
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if masks else words
            joined = b" ".join(kept)
            made = len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()
            if with_text:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                made += edges.tolist(), joined.decode("utf-8", "replace")
            return made

        return read

    return make
