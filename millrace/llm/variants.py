"""Spelling variants: words one code point apart, found with search schemes on a bidirectional FM-index.

Two words that differ by one inserted, deleted or replaced code point agree exactly in the first or in the second half of
either of them. So words meet by halves: each is dealt to the halves by which a word of about its length can ask for it,
and a task indexes the words dealt to it, a delimiter before and behind each. A query matches its half exactly,
delimiter included, then goes on across the other half with one error; all open queries of a task take each step
together, as arrays of suffix-rank intervals. A half of more words than one index should hold is spread over several
indexes, and its queries go to each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.session import cut_lineage

MIN_LENGTH, MIN_COUNT, RATIO, DELETE = 5, 3, 2, 97
#: Words of one half in an index, rows that a task should get, and large halves that go to every task (beyond: a shuffle).
WORDS_PER_HALF, ROWS_PER_TASK, BROADCAST_HALVES = 20_000, 40_000, 100_000

_QUERIES_AT_ONCE = 8_192
_RUN = "([A-Za-zÀ-ÿ]+)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counted(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, delete: int = DELETE,
) -> DataFrame:
    """(word, n): the letter runs of all texts, A-Z as a-z, with at least ``min_count`` occurrences.

    A hash of id and run decides which runs, one in ``delete``, lose a code point first. NULL texts have no runs; a NULL
    id is hashed as an empty one; rows that repeat count as often as they stand there. Occurrences are counted on the map
    side first, so a word of every text reaches the shuffle as one row per task.
    """
    runs = F.regexp_extract_all(F.translate(F.col(f"`{text}`"), _UPPER, _UPPER.lower()), F.lit(_RUN), F.lit(1))
    each = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    each = each.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = each.select(F.when(F.col("h") % delete == 0, less).otherwise(F.col("run")).alias("word"))
    words = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return words.where(F.col("n") >= min_count)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Start places of the sorted suffixes; each round sorts by twice as many symbols."""
    n = len(codes)
    bits = int(codes.max() + 2).bit_length()
    width = 62 // bits
    padded = np.concatenate([codes.astype(np.int64) + 1, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = (key << bits) | padded[i : i + n]
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        width *= 2


class Ranks:
    """The Burrows-Wheeler transform of one direction: how many symbols up to ``c`` stand in its first ``i`` places."""

    def __init__(self, codes: np.ndarray, symbols: int) -> None:
        self.places = suffix_array(codes)
        self.last = codes[self.places - 1]
        words = len(codes) // 64 + 1
        self.bits = np.zeros((symbols + 1, words), np.uint64)
        for c in range(symbols):
            packed = np.packbits(self.last <= c, bitorder="little")
            self.bits[c + 1].view(np.uint8)[: len(packed)] = packed
        self.sums = np.zeros((symbols + 1, words), np.int32)
        np.cumsum(np.bitwise_count(self.bits[:, :-1]), axis=1, out=self.sums[:, 1:], dtype=np.int32)

    def below(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Symbols smaller than ``c`` before place ``i``."""
        word = i >> 6
        part = self.bits[c, word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.sums[c, word] + np.bitwise_count(part)


class Index:
    """Bidirectional FM-index of sorted distinct words, a delimiter (symbol 0) before, between and behind them."""

    def __init__(self, words: list[str]) -> None:
        text = "\0" + "\0".join(words) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        alphabet, codes = np.unique(points, return_inverse=True)
        codes = codes.reshape(-1)
        self.symbols, self.n = len(alphabet), len(codes)
        self.forward, self.backward = Ranks(codes, self.symbols), Ranks(codes[::-1], self.symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=self.symbols))])[:-1]
        ends = np.flatnonzero(codes == 0)
        self.word_at = np.searchsorted(ends, self.forward.places[: len(ends)])  # suffixes that start with a delimiter
        lengths = np.diff(ends) - 1
        self.lengths = lengths
        self.codes = np.zeros((len(words), int(lengths.max()) + 1), np.int16)
        inside = np.arange(self.codes.shape[1])[None, :] < lengths[:, None]
        self.codes[inside] = codes[codes > 0]

    def _extend(self, side: Ranks, a, b, size, c):
        """One symbol more on the side of ``side``: ``a`` is the interval there, ``b`` the one of the other direction."""
        low, high = side.below(c, a), side.below(c, a + size)
        start = side.below(c + 1, a) - low
        return self.first[c] + start, b + high - low, side.below(c + 1, a + size) - high - start

    def _branches(self, side: Ranks, a, b, size):
        """All ways to go on from some intervals by a letter: (place among them, symbol, a, b, size)."""
        few = size <= self.symbols
        at = np.flatnonzero(few)
        i = np.repeat(at, size[at])
        row = np.repeat(a[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(len(i))
        key = np.unique(i * self.symbols + side.last[row])
        many = np.flatnonzero(~few)
        key = np.concatenate([key, (many[:, None] * self.symbols + np.arange(self.symbols)[None, :]).reshape(-1)])
        key = key[key % self.symbols > 0]
        i, c = key // self.symbols, key % self.symbols
        a, b, size = self._extend(side, a[i], b[i], size[i], c)
        left = size > 0
        return i[left], c[left], a[left], b[left], size[left]

    def one_error(self, words: np.ndarray, halves: np.ndarray, rightward: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of the words one error away, the error being behind the half of that many symbols.

        Queries are numbers of words. Rightward, the first half is exact and the search goes to the right on the
        backward index; else the second half is, and it goes to the left on the forward one. An error in a run of equal
        letters is placed at its end only, so no word is found twice.
        """
        side = self.backward if rightward else self.forward
        wide = np.arange(self.codes.shape[1] + 2)[None, :]
        length = self.lengths[words][:, None]
        source = wide - 1 if rightward else length - wide
        inside = (wide >= 1) & (wide <= length)
        seq = np.where(inside, np.take_along_axis(self.codes[words], np.clip(source, 0, self.codes.shape[1] - 1), 1), 0)
        last = self.lengths[words] + 1
        q = np.arange(len(words))
        a, b, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.n)
        for t in range(int(halves.max()) + 1):  # the delimiter and the half
            on = halves >= t
            a[on], b[on], size[on] = self._extend(side, a[on], b[on], size[on], seq[on, t])
        on = size > 0
        q, a, b, size, pos = q[on], a[on], b[on], size[on], halves[on] + 1
        wrong: list[tuple] = []
        while len(q):
            here, inner = seq[q, pos], pos < last[q]
            gone = inner & (here != seq[q, np.minimum(pos + 1, last[q])])
            wrong.append((q[gone], a[gone], b[gone], size[gone], pos[gone] + 1))
            i, c, a, b, size = self._branches(side, a, b, size)
            same = c == here[i]
            other = ~same & inner[i]
            wrong.append((q[i[other]], a[other], b[other], size[other], pos[i[other]] + 1))
            wrong.append((q[i[~same]], a[~same], b[~same], size[~same], pos[i[~same]]))
            q, a, b, size, pos = q[i[same]], a[same], b[same], size[same], pos[i[same]] + 1
        q, a, b, size, pos = (np.concatenate(x) for x in zip(*wrong)) if wrong else (np.empty(0, np.int64),) * 5
        found = []
        while len(q):
            a, b, size = self._extend(side, a, b, size, seq[q, pos])
            left = size > 0
            q, a, b, size, pos = q[left], a[left], b[left], size[left], pos[left] + 1
            done = pos > last[q]
            found.append((q[done], self.word_at[(b if rightward else a)[done]]))
            q, a, b, size, pos = q[~done], a[~done], b[~done], size[~done], pos[~done]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([w for _, w in found])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task (first, part, parts, asks, word, n, code) to (word, n_near, best_n, best) of its queries."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    words = sorted(set(table.column("word").to_pylist()))
    number = {w: i for i, w in enumerate(words)}
    own = np.array([number[w] for w in table.column("word").to_pylist()])
    n, code = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    n[own], code[own] = table.column("n").to_numpy(), table.column("code").to_numpy()
    first, part, parts, asks = (table.column(c).to_numpy() for c in ("first", "part", "parts", "asks"))
    index = Index(words)
    for rightward in (True, False):
        rows = np.flatnonzero(asks & (first == rightward))
        for at in range(0, len(rows), _QUERIES_AT_ONCE):
            some = rows[at : at + _QUERIES_AT_ONCE]
            mine = own[some]
            length = index.lengths[mine]
            q, w = index.one_error(mine, length // 2 if rightward else length - length // 2, rightward)
            keep = code[w] % parts[some[q]] == part[some[q]]  # of several indexes of a half, one holds the word
            if not rightward:  # found by the first half already
                head = np.arange(index.codes.shape[1])[None, :] >= (length // 2)[q][:, None]
                keep &= ~((index.codes[w] == index.codes[mine[q]]) | head).all(axis=1)
            q, w = q[keep], w[keep]
            order = np.lexsort([w, -n[w], q])
            q, w = q[order], w[order]
            start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
            columns = [
                pa.array([words[i] for i in mine[q[start]]], pa.string()), pa.array(np.diff(np.append(start, len(q))), pa.int64()),
                pa.array(n[w[start]]), pa.array([words[i] for i in w[start]], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])
    pa.default_memory_pool().release_unused()


def near_words(words: DataFrame, words_per_half: int = WORDS_PER_HALF, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(word, n_near, best_n, best) for the words (word, n) that have a near word: how many, and the most frequent of them."""
    half, more = F.expr("length(word) div 2"), F.expr("length(word) div 2 + if(length(word) % 2 = 0, -1, 1)")
    rest, less = F.expr("length(word) - length(word) div 2"), F.expr("length(word) - length(word) div 2 + if(length(word) % 2 = 0, 1, -1)")

    def place(first: bool, size, asks: bool):
        text = F.substring(F.col("word"), F.lit(1), size) if first else F.substring(F.col("word"), F.length("word") - size + 1, size)
        return F.struct(F.lit(first).alias("first"), text.alias("half"), F.lit(asks).alias("asks"))

    places = F.array(place(True, half, True), place(True, more, False), place(False, rest, True), place(False, less, False))
    placed = words.select("word", "n", F.crc32(F.col("word").cast("binary")).alias("code"), F.explode(places).alias("p"))
    placed = placed.select("word", "n", "code", "p.*")
    large = placed.groupBy("first", "half").agg(F.count("*").alias("rows")).where(F.col("rows") > words_per_half)
    large = cut_lineage(large.select("first", "half", F.ceil(F.col("rows") / words_per_half).cast("long").alias("parts")))
    large = F.broadcast(large) if large.count() <= BROADCAST_HALVES else large
    dealt = placed.join(large, ["first", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    each = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.col("code") % F.col("parts")))
    dealt = dealt.withColumn("part", F.explode(each))
    tasks = max(1, -(-4 * words.count() // rows_per_task))
    dealt = dealt.repartition(tasks, "first", "half", "part").select("first", "part", "parts", "asks", "word", "n", "code")
    found = dealt.mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b"))
    return found.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def grouped(words: DataFrame, ratio: int = RATIO, words_per_half: int = WORDS_PER_HALF, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per row of ``words`` (word, n), each word once and without U+0000: word, n, n_near, form, form_n and root.

    Near words differ by exactly one code point. The form is the most frequent near word (of several the first in
    code-point order) if it is at least ``ratio`` times as frequent, else NULL; the root is what forms lead to, the word
    itself where it has none. ``ratio`` must be over 1, so that forms cannot lead in a circle. An empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = cut_lineage(words.select("word", "n"))
    found = words.join(near_words(words, words_per_half, rows_per_task), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"),
    )
    found = cut_lineage(found)
    roots = cut_lineage(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each round doubles the way; counts double along forms, so there are few
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went"))
        step = cut_lineage(step)
        if step.where("went").isEmpty():
            break
        roots = step.select("word", "root")
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
