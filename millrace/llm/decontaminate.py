"""Benchmark decontamination: Wu-Manber search for all benchmark windows at once, over words.

A pattern is a run of ``window`` benchmark words (a shorter item is one pattern). The search looks at the block of
the last two words under the pattern end. A shift table says how far the end may move when the block stands earlier
in some pattern or in none, so most places of a document are skipped. A block that ends a pattern opens its bucket,
and every pattern in it is compared word by word.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from itertools import repeat

from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.rows import fresh_names, per_text, row_key
from millrace.session import cut_lineage

WINDOW = 13
#: A document is contaminated when this share of its words, in percent, stands inside benchmark windows.
SHARE_PERCENT = 5
#: Benchmark text that one search table holds, in bytes; more text makes more tables, searched one after the other.
TABLE_BYTES = 2_000_000
#: Hit texts of a benchmark of several blocks that go to every task; beyond that they are joined with a shuffle.
BROADCAST_HITS = 100_000

# Bytes that belong to words are digits, letters and everything outside ASCII; A-Z count as a-z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WindowSearch:
    """Search tables for the windows of some items: ``(item_id, text)`` pairs."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[object] = []
        self.codes: list[list[int]] = []
        for item, text in items:
            words = words_of(text)
            if words:
                self.items.append(item)
                self.codes.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
        self.base = len(self.vocabulary) + 1
        by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, codes in enumerate(self.codes):
            n = min(window, len(codes))
            by_length[n] += [(k, i) for i in range(len(codes) - n + 1)]
        self.groups = [self._tables(n, starts) for n, starts in sorted(by_length.items())]

    def _tables(self, length: int, patterns: list[tuple[int, int]]):
        block = min(2, length)
        shift: dict[int, int] = {}
        bucket: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, start in patterns:
            codes = self.codes[k]
            for end in range(block - 1, length):
                at = start + end
                code = codes[at] if block == 1 else codes[at - 1] * self.base + codes[at]
                shift[code] = min(shift.get(code, length), length - 1 - end)
            bucket[code].append((k, start))
        return length, block, shift, dict(bucket), length - block + 1

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (start, end) of words inside occurrences, merged and in order, and the places of the items found."""
        codes = list(map(self.vocabulary.get, words, repeat(0)))
        n, base, all_codes = len(codes), self.base, self.codes
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        for length, block, shift, bucket, default in self.groups:
            at = length - 1
            while at < n:
                code = codes[at] if block == 1 else codes[at - 1] * base + codes[at]
                step = shift.get(code, default)
                if step:
                    at += step
                    continue
                start, here = at - length + 1, None
                for k, pattern in bucket[code]:
                    if here is None:
                        here = codes[start : at + 1]
                    if all_codes[k][pattern : pattern + length] == here:
                        found.add(k)
                        hits.append((start, at + 1))
                at += 1
        return merged(hits), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


_FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _reader(block, window: int) -> Callable[[], Callable[[bytes], tuple]]:
    """Reader over a broadcast block of (item, text)."""

    def make():
        search = WindowSearch(block.value, window)
        names = [str(i) for i in search.items]

        def read(text: bytes) -> tuple:
            words = words_of(text)
            spans, found = search.find(words)
            return len(words), [x for span in spans for x in span], sorted({names[k] for k in found})

        return read

    return make


def _block_rows(benchmark: DataFrame, item: str, text: str, table_bytes: int) -> tuple[int, DataFrame]:
    """How many blocks of bounded size the benchmark takes, and its items with their block; items without text take none."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").cast("binary").alias("t"))
    rows = rows.where("t is not null")
    total = rows.agg(F.sum(F.length("t") + 64)).first()[0] or 0
    n = max(1, math.ceil(total / table_bytes))
    return n, rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n)))


def _shared_block(rows: DataFrame, k: int):
    """One block in the driver, then in every task."""
    items = [(r["i"] if r["i"] is not None else "", bytes(r["t"])) for r in rows.where(F.col("block") == k).collect()]
    return rows.sparkSession.sparkContext.broadcast(items)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share_percent: int = SHARE_PERCENT,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """``keep`` and, per row: n_words, spans (start and end of each run of hit words, flat), items (ids as text, sorted),
    n_hit, n_items, contaminated; a result whose name is in ``keep`` gets underscores behind it.

    The benchmark is read in blocks of at most about ``table_bytes``; one block at a time is in the driver and in the
    tasks. With one block documents pass through it without a shuffle; with more, what each block finds is written by a
    hash of the text and meets the rows at the end, so copies of a text share it. NULL or empty texts have no words and
    are not contaminated; an item with a NULL id is named by an empty string; repeated items and rows count each for
    itself, and items that share an id count once. An empty benchmark finds nothing, an empty table gives no rows. A text
    is searched whole, by one task, in time that follows its length.
    """
    n, rows = _block_rows(benchmark, item, item_text, table_bytes)
    spare = fresh_names(keep, ["__words", "__spans", "__items"])
    if n == 1:
        found = per_text(docs, _reader(_shared_block(rows, 0), window), _FIELDS, keep, text).toDF(*keep, *spare)
    else:
        found = _over_blocks(docs, cut_lineage(rows), n, keep, text, window, spare)
    spans, words, items = F.col(spare[1]), F.col(spare[0]), F.col(spare[2])
    hit = F.aggregate(
        F.sequence(F.lit(1), F.size(spans), F.lit(2)), F.lit(0).cast("long"),
        lambda total, i: total + F.element_at(spans, i + 1) - F.element_at(spans, i),
    )
    hit = F.when(F.size(spans) > 0, hit).otherwise(F.lit(0).cast("long"))
    made = [words, spans, items, hit, F.size(items).cast("long"), (hit > 0) & (hit * 100 >= words * share_percent)]
    names = fresh_names(keep, ["n_words", "spans", "items", "n_hit", "n_items", "contaminated"])
    return found.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(name) for c, name in zip(made, names)])


def _over_blocks(docs, rows, n, keep, text, window, spare) -> DataFrame:
    """The rows with what any of several blocks finds; each block is given back before the next one comes."""
    a, b = row_key(F.col(f"`{text}`"))
    texts = docs.select(a.alias("a"), b.alias("b"), F.col(f"`{text}`").alias("t"))
    hits = None
    for k in range(n):
        block = _shared_block(rows, k)
        found = per_text(texts, _reader(block, window), _FIELDS, ("a", "b"), "t").where(F.size("items") > 0)
        found = cut_lineage(found.select("a", "b", "spans", "items").dropDuplicates(["a", "b"]))
        block.destroy()
        hits = found if hits is None else hits.union(found)
    hits = hits.groupBy("a", "b").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))  # a row per block
    hits = cut_lineage(hits.select("a", "b", "s", F.array_sort(F.array_distinct("i")).alias("i")))
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    key = fresh_names(docs.columns, ["__a", "__b"])
    found = fresh_names([*docs.columns, *key], ["__s", "__i"])
    met = docs.withColumns(dict(zip(key, (a, b)))).join(hits.toDF(*key, *found), key, "left")
    none = F.array().cast("array<bigint>")
    met = met.withColumns({found[0]: F.coalesce(found[0], none), found[1]: F.coalesce(found[1], F.array().cast("array<string>"))})
    fields = T.StructType().add("n", "long").add("s", T.ArrayType(T.LongType()))
    done = per_text(met, lambda: _joined_spans, fields, (*keep, found[1]), text, given=(found[0],))
    return done.toDF(*keep, spare[2], spare[0], spare[1])


def _joined_spans(text: bytes, flat: list[int]) -> tuple:
    spans = merged(list(zip(flat[::2], flat[1::2]))) if flat else []
    return len(words_of(text)), [x for span in spans for x in span]
