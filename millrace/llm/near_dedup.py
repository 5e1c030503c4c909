"""MinHash near-dedup with an LSH forest.

Every distinct set of word shingles has 32 signatures of eight minima each. A signature is a key, and the sets are sorted
by it in 32 orders. Neighbours in an order that share the first four minima, its region, are candidates, those with the
longest common prefix first: a sparse region is compared whole at depth four, a crowded one only with what lies next to
it, which is as deep as the region asks for. One pass over the texts gives each set a hash of its region in each order;
only sets that share a region with another are read again and sorted. First every set meets the one next to it. Confirmed
on the full sets, these pairs give components; then, in regions that hold sets of several components, these meet within a
wide reach. A parity sketch gives a lower bound for the shingles in which two sets differ, so that pairs that cannot be
alike drop out before their sets are fetched. Rows at the ends of a task are compared with those of the tasks beside it.
Sets with partners beyond the wide reach meet in an exact prefix-filter join on their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.rows import WordHashes, hinted, mixed, odd_numbers, per_text, release, sweep
from millrace.session import cut_lineage

SHINGLE, PERCENT = 5, 80
TREES, DEPTH, MIN_DEPTH = 32, 8, 4
#: Neighbours on each side with which a set is compared in each order, and bits of the parity sketch.
NEIGHBOURS, PARITY_BITS = 256, 512
#: Rows of an order in one task, and ids whose hashes go to every task as a bitmap to find their texts again (beyond: a
#: shuffle of all texts).
ROWS_PER_TASK, BROADCAST_IDS = 1_000_000, 1_000_000
#: Labels that are broadcast, each some 70 bytes of the driver while the table of them is made (beyond: a shuffle).
BROADCAST_LABELS = 100_000
#: Rows that a task of an order holds at least, as a multiple of the reach, where the table is large enough.
LEAST_REACHES = 16
#: Exact join: sets that must hold a shingle for it to be counted as common, counts of common shingles that go to every
#: task (the order of the others is by hash: it decides the work, not the result), and rows of a shingle in one part.
COMMON, BROADCAST_COMMON, ROWS_PER_PART = 8, 500_000, 1_000

_AT_ONCE = 4096


class Shingles:
    """The set of word shingles of a text, as sorted 64-bit hashes; A-Z count as a-z."""

    def __init__(self, size: int) -> None:
        self.size, self.words = size, WordHashes()
        self.factors = odd_numbers(17, size)

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        codes = mixed(self.words.of(words))
        k = min(self.size, len(words))
        total = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            total += mixed(codes[i : i + len(total)] + self.factors[i]) * self.factors[i]
        return np.unique(mixed(total))


def digest_of(found: np.ndarray) -> tuple[int, int]:
    low = mixed(found ^ np.uint64(0x5851F42D4C957F2D))
    return int(found.sum().view(np.int64)), int(mixed(low).sum().view(np.int64))


class Minima:
    """The first ``depth`` minima of a set of shingles in each order, as an array (order, depth)."""

    def __init__(self, depth: int) -> None:
        self.depth, self.offset = depth, odd_numbers(23, 1)[0]
        used = (np.arange(TREES)[:, None] * DEPTH + np.arange(depth)[None, :]).reshape(-1)
        self.masks = odd_numbers(29, TREES * DEPTH, 32)[used][None, :]
        self.factors = odd_numbers(31, TREES * DEPTH, 32)[used][None, :]

    def of(self, found: np.ndarray) -> np.ndarray:
        small = (mixed(found + self.offset) >> np.uint64(32)).astype(np.uint32)[:, None]
        least = np.full(TREES * self.depth, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(small), _AT_ONCE):
            values = (small[at : at + _AT_ONCE] ^ self.masks) * self.factors
            np.minimum(least, values.min(axis=0), out=least)
        return least.reshape(TREES, self.depth)


class Signer:
    """Number of shingles, a 128-bit digest of the set, and a hash of its region in each order."""

    def __init__(self, size: int) -> None:
        self.shingles, self.minima = Shingles(size), Minima(MIN_DEPTH)

    def __call__(self, text: bytes) -> tuple:
        found = self.shingles.of(text)
        if not len(found):
            return 0, None, None, None
        region = np.arange(TREES, dtype=np.uint64)
        for column in self.minima.of(found).T:
            region = mixed(region + column + odd_numbers(37, 1)[0])
        return len(found), *digest_of(found), region.view(np.int64).tolist()


class Reader:
    """The set of a text, its parity sketch, and its minima in all orders, most significant byte first."""

    def __init__(self, size: int) -> None:
        self.shingles, self.minima = Shingles(size), Minima(DEPTH)

    def __call__(self, text: bytes) -> tuple:
        found = self.shingles.of(text)
        if not len(found):
            return 0, None, None, None
        parity = np.bincount((found % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
        sketch = np.packbits(parity.astype(bool)).tobytes()
        return len(found), found.view(np.int64).tolist(), sketch, self.minima.of(found).astype(">u4").tobytes()


_SIGNED = T.StructType().add("n", "long").add("d1", "long").add("d2", "long").add("regions", T.ArrayType(T.LongType()))
_READ = T.StructType().add("n", "long").add("set", T.ArrayType(T.LongType())).add("parity", "binary").add("sig", "binary")


_PLACED = "a long, b long, far long, part int, pos long, tree int, key binary, id long, n long, group long, parity binary"
_ROW = ["tree", "key", "id", "n", "group", "parity"]


def _orders(members: DataFrame, full: DataFrame, rows: int, reach: int) -> DataFrame:
    """The ``members`` (tree, id, group) sorted by their keys, an order being sorted through its tasks."""
    width = 4 * DEPTH
    each = members.join(full.select("id", "n", "parity", "sig"), "id")
    each = each.withColumn("key", F.substring("sig", F.col("tree") * width + 1, F.lit(width)))
    tasks = max(int(full.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))
    tasks = max(1, min(tasks, rows // (LEAST_REACHES * (reach + 1))))
    return each.select(*_ROW).repartitionByRange(tasks, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")


def _neighbours(reach: int, percent: int, ends: bool):
    """Pairs (a, b) of sets at most ``reach`` apart in an order, of one region and two groups.

    Only pairs that size and parity sketch let be alike. Sets with a partner further away come as (far, id), unless the
    reach is one, far being the hash of the region. With ``ends``, the first and last rows of the task come too,
    with their place; without, each value of ``part`` is an order of its own.
    """
    wide = reach + 1
    schema = pa.schema([
        ("a", pa.int64()), ("b", pa.int64()), ("far", pa.int64()), ("part", pa.int32()),
        ("pos", pa.int64()), ("tree", pa.int32()), ("key", pa.binary()), ("id", pa.int64()), ("n", pa.int64()),
        ("group", pa.int64()), ("parity", pa.binary()),
    ])

    def placed(rows: int, **columns) -> pa.RecordBatch:
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def end(rows: pa.Table, first: int) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            part, pos = np.full(rows.num_rows, TaskContext.get().partitionId(), np.int32), np.arange(first, first + rows.num_rows)
            yield placed(rows.num_rows, part=part, pos=pos, **{c: rows.column(c).combine_chunks() for c in _ROW})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        done = 0
        for batch in (b for b in batches if b.num_rows):
            here = pa.Table.from_batches([batch])
            if ends:
                yield from end(here.slice(0, max(0, wide - done)), done)
            known = 0 if held is None else held.num_rows
            done += here.num_rows
            here = here if held is None else pa.concat_tables([held, here])
            ids, n, group, tree = (here.column(c).to_numpy() for c in ("id", "n", "group", "tree"))
            keys = np.frombuffer(b"".join(here.column("key").to_pylist()), ">u4").reshape(-1, DEPTH)
            of = [tree] if ends else [tree, here.column("part").to_numpy()]
            _, region = np.unique(np.column_stack([*of, keys[:, :MIN_DEPTH]]), axis=0, return_inverse=True)
            region = region.reshape(-1)
            parity = np.frombuffer(b"".join(here.column("parity").to_pylist()), np.uint64).reshape(len(ids), -1)
            found = []
            for d in range(1, min(reach, len(ids) - 1) + 1):
                at = np.flatnonzero(region[:-d] == region[d:])
                if not len(at):
                    break  # regions are runs: none is longer
                at = at[(at + d >= known) & (group[at] != group[at + d])]  # not two rows that were held
                at = at[100 * np.minimum(n[at], n[at + d]) >= percent * np.maximum(n[at], n[at + d])]
                differ = np.bitwise_count(parity[at] ^ parity[at + d]).sum(axis=1, dtype=np.int64)  # or more
                at = at[differ * (100 + percent) <= (n[at] + n[at + d]) * (100 - percent)]
                if len(at):
                    found.append(np.stack([np.minimum(ids[at], ids[at + d]), np.maximum(ids[at], ids[at + d])], axis=1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield placed(len(pairs), a=pairs[:, 0], b=pairs[:, 1])
            at = np.flatnonzero(region[:-wide] == region[wide:])
            at = at[at + wide >= known]
            if reach > 1 and len(at):
                at = np.concatenate([at, at + wide])
                words = np.column_stack([tree[at], keys[at, :MIN_DEPTH]]).astype(np.uint64)
                far = np.zeros(len(at), np.uint64)
                for column in words.T:
                    far = mixed(far + column + odd_numbers(37, 1)[0])
                both = np.unique(np.column_stack([far.view(np.int64), ids[at]]), axis=0)
                yield placed(len(both), far=both[:, 0], id=both[:, 1])
            held = here.slice(max(0, here.num_rows - wide))
        if ends and held is not None:
            yield from end(held, done - held.num_rows)

    return run


def _across(found: DataFrame, reach: int, percent: int) -> DataFrame:
    """What ``_neighbours`` finds across the borders of tasks: the rows around each border are an order of their own.

    Only the number of the rows of each task comes to the driver.
    """
    wide = reach + 1
    ends = found.where("part is not null").dropDuplicates(["part", "pos"])  # a short task is both its ends
    counts = sorted(ends.groupBy("part").agg(F.max("pos").alias("pos")).collect())
    starts = np.cumsum([0, *(r.pos + 1 for r in counts)])[:-1]
    parts = np.array([r.part for r in counts], np.int64)
    kinds = T.StructType([T.StructField("place", T.LongType()), *ends.schema.fields])
    arrow, names = to_arrow_schema(kinds), ends.columns

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, pos = (batch.column(c).to_numpy() for c in ("part", "pos"))
            place = starts[np.searchsorted(parts, part)] + pos
            low, high = (np.searchsorted(starts[1:], place + x, "right") for x in (-wide, wide))
            row = np.repeat(np.arange(len(place)), high - low)
            border = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - high + low, high - low) + np.repeat(low, high - low)
            taken = {c: batch.column(c).take(pa.array(row)) for c in names}
            taken |= {"place": pa.array(place[row]), "part": pa.array(border.astype(np.int32))}
            yield pa.RecordBatch.from_arrays([taken[f.name].cast(f.type) for f in arrow], schema=arrow)

    around = ends.mapInArrow(spread, kinds).repartition("part").sortWithinPartitions("part", "place")
    return around.mapInArrow(_neighbours(reach, percent, False), _PLACED)


def _candidates(members: DataFrame, full: DataFrame, rows: int, reach: int, percent: int) -> DataFrame:
    """(a, b) and (far, id) of all orders, the borders of tasks included, as ``_neighbours`` gives them."""
    found = cut_lineage(_orders(members, full, rows, reach).mapInArrow(_neighbours(reach, percent, True), _PLACED))
    both = found.where("part is null").union(_across(found, reach, percent))
    both = cut_lineage(both.select("a", "b", "far", "id").distinct())
    release(found)
    sweep(both)
    return both


def _beyond(crowd: DataFrame, full: DataFrame, percent: int, common: int = COMMON) -> DataFrame:
    """Pairs (a, b) of sets of two groups that may be alike, none left out: a prefix-filter join on shingles.

    Shingles are ordered by rarity. Two alike sets have their first common shingle so early in both that enough
    shingles follow; so each set offers its first ones, each with the sizes that a partner may have there. The join also
    compares the parity sketches, so that few pairs leave it that are not alike.
    """
    sets = cut_lineage(full.join(crowd.select("id", "group"), "id").select("id", "group", "set", "parity"))
    counts = sets.select(F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("f")).where(F.col("f") >= common)
    counts = counts.orderBy(F.desc("f")).limit(BROADCAST_COMMON).toArrow().sort_by("s")
    shared = crowd.sparkSession.sparkContext.broadcast(np.column_stack([counts.column(c).to_numpy() for c in ("s", "f")]))
    out = T.StructType().add("s", "long").add("id", "long").add("group", "long").add("n", "long").add("most", "long")
    sketch = [f"p{i}" for i in range(PARITY_BITS // 64)]
    for name in sketch:
        out = out.add(name, "long")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, often = shared.value[:, 0], shared.value[:, 1]
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            for id_, group, found, parity in zip(*(batch.column(c) for c in ("id", "group", "set", "parity"))):
                found = found.values.to_numpy()
                n = len(found)
                f = np.zeros(n, np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
                    f = np.where(values[at] == found, often[at], 0)
                found = found[np.lexsort([found, f])]
                most = (100 + percent) * (n - np.arange(n)) // percent - n
                first = int(np.count_nonzero(100 * most >= percent * n))  # most falls
                columns = [found[:first], np.full(first, id_.as_py()), np.full(first, group.as_py()), np.full(first, n), most[:first]]
                columns += [np.full(first, p) for p in np.frombuffer(parity.as_py(), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=arrow)

    offered = cut_lineage(sets.mapInArrow(run, out))
    release(sets)
    shared.destroy()
    per = offered.groupBy("s").agg(
        F.sum((F.col("most") >= F.col("n")).cast("long")).alias("small"), F.min("group").alias("least"), F.max("group").alias("last")
    )
    per = per.where("small > 0 and least < last").select("s", F.ceil(F.col("small") / ROWS_PER_PART).cast("int").alias("parts"))
    met = cut_lineage(offered.join(per, "s"))
    release(offered)
    dealt = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    x = met.where("most >= n").withColumn("salt", dealt)
    y = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x, y = (d.select("s", "salt", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "group", "n", "most", *sketch))) for k, d in (("x", x), ("y", y)))
    differ = " + ".join(f"bit_count({p}_x ^ {p}_y)" for p in sketch)  # or more
    pairs = x.join(y, ["s", "salt"]).where(
        "group_x <> group_y and n_x <= n_y and n_y <= most_x and n_x <= most_y and "
        f"100 * n_x >= {percent} * n_y and (n_x < n_y or id_x < id_y) and "
        f"({differ}) * {100 + percent} <= (n_x + n_y) * {100 - percent}"
    )
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _confirmed(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    left = shingles.select(F.col("id").alias("a"), F.col("set").alias("s"))
    right = shingles.select(F.col("id").alias("b"), F.col("set").alias("t"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("s", "t"))
    return both.where(common * 100 >= (F.size("s") + F.size("t") - common) * percent).select("a", "b").distinct()


def connected(links: DataFrame, rounds: int = 60, broadcast_ids: int = BROADCAST_LABELS) -> DataFrame:
    """(id, group): the least id that each id of ``links`` (a, b) can reach; ids without a link are left out.

    Labels spread along links and jump to the label of their label, so chains take few rounds. Every round is
    written to the shared folder and the one before it removed; only counts of changed labels come to the driver. The
    labels that moved, one row for each however many members it has, go to every task, beyond ``broadcast_ids`` into a join.
    """
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("group")))
    for _ in range(rounds):
        spread = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("group").alias("least"))
        met = labels.join(spread, labels.id == spread.a, "left").select(
            "id", F.col("group").alias("old"), F.least("group", "least").alias("group")
        )
        met = cut_lineage(met)
        release(labels)
        moved = cut_lineage(met.where(F.col("old") != F.col("group")).select(F.col("id").alias("group"), F.col("group").alias("further")))
        n_moved = moved.count()
        if not n_moved:
            release(both)
            sweep(met)
            return met.select("id", "group")
        jump = F.broadcast(moved) if n_moved <= broadcast_ids else moved
        labels = cut_lineage(met.join(jump, "group", "left").select("id", F.least("group", "further").alias("group")))
        release(met)
        release(moved)
        del spread, jump
        sweep(labels)
    raise RuntimeError(f"components are still growing after {rounds} rounds")


def _grouped(links: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(id, group) with more links: those between the groups of ``groups`` are connected, and all members follow."""
    if groups is None:
        return connected(links)
    for end in ("a", "b"):
        links = links.join(groups.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("group", end)).drop("group")
    new = connected(links.where("a <> b").select("a", "b"))
    old = groups.join(new.select(F.col("id").alias("group"), F.col("group").alias("further")), "group", "left")
    old = old.select("id", F.coalesce("further", "group").alias("group"))
    return cut_lineage(old.union(new.join(groups, "id", "left_anti").select("id", "group")))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    broadcast_ids: int = BROADCAST_IDS,
    reach: int = NEIGHBOURS,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept.

    Two texts are linked when 100 times the shingles they share is at least ``percent`` times those of either; the
    component is the least id that links can reach. A text of fewer than ``shingle`` words is one shingle; NULL and
    blank texts have none and link with nothing. Copies of one set are one member. Rows that share an id are one
    document, whatever their texts, so all their sets are linked; a row without an id stands alone, with a NULL
    component, and is kept. An empty table gives no rows. Columns other than the two named are left out. Candidates are
    found with a chance: of the pairs at 80 percent, fewer than one in ten million is missed, however dense their regions
    are.
    """
    rows = per_text(docs, lambda: Signer(shingle), _SIGNED, (doc_id,), text).withColumnRenamed(doc_id, "doc")
    rows = cut_lineage(rows)
    known = rows.where("doc is not null and n > 0")
    sets = known.groupBy("d1", "d2").agg(F.min(F.col("doc").cast("long")).alias("id"), F.first("regions").alias("regions"))
    sets = cut_lineage(sets)
    keys = sets.select("d1", "d2", "id")
    found = _linked(docs, sets, _of_one_document(known, keys), doc_id, text, shingle, percent, broadcast_ids, reach)
    named = keys.join(found, "id", "left").select("d1", "d2", F.coalesce("group", "id").alias("set_group"))
    joined = rows.drop("regions").join(named, ["d1", "d2"], "left")
    group = F.when(F.col("doc").isNull(), F.lit(None)).otherwise(F.coalesce("set_group", F.col("doc").cast("long")))
    return joined.select(
        F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), group.alias("component_id"),
        F.coalesce(F.col("doc") == group, F.lit(True)).alias("kept"),
    )


def _of_one_document(known: DataFrame, keys: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of a document id that has several."""
    both = F.struct("d1", "d2")
    several = known.groupBy("doc").agg(F.min(both).alias("x"), F.max(both).alias("y")).where("x <> y").select("doc")
    of = known.join(several, "doc", "left_semi").select("doc", "d1", "d2").distinct().join(keys, ["d1", "d2"])
    return of.select(F.col("doc").cast("long").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()


def _shared_regions(members: DataFrame, of: str) -> DataFrame:
    """The ``members`` (id, tree, region, group) of regions that hold two or more different values of ``of``."""
    held = members.groupBy("region").agg(F.min(of).alias("least"), F.max(of).alias("last")).where("least < last")
    return members.join(held.select("region"), "region", "left_semi")


def _linked(docs, sets, given, doc_id, text, shingle, percent, broadcast_ids, reach) -> DataFrame:
    """(id, group) of all sets that have a link; ``given`` are links that hold without a look at the sets."""
    given = cut_lineage(given)
    placed = sets.select("id", F.posexplode("regions").alias("tree", "region"))
    members = cut_lineage(_shared_regions(placed, "id"))
    active = cut_lineage(members.select("id").distinct())
    n_active = active.count()
    mine = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    if n_active <= broadcast_ids:  # so that few texts move for the join
        mine = hinted(mine, "id", active, n_active, "maybe").where("maybe").drop("maybe")
    full = per_text(mine.join(active, "id", "left_semi"), lambda: Reader(shingle), _READ, ("id",))
    full = cut_lineage(full.where("n > 0").dropDuplicates(["id", "set"]))
    sweep(full)
    alone = members.withColumn("group", F.col("id"))
    first = _candidates(alone, full, members.count(), 1, percent).select("a", "b")
    links = cut_lineage(_confirmed(first, full, percent).union(given))
    for done in (given, active):
        release(done)
    groups = connected(links)
    release(links)
    crowd = members.join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))
    crowd = cut_lineage(_shared_regions(crowd, "group"))
    release(members)
    sweep(crowd)
    n_crowd = crowd.count()
    if not n_crowd:
        return groups
    found = _candidates(crowd, full, n_crowd, reach, percent)
    more = found.where("a is not null").select("a", "b").join(first, ["a", "b"], "left_anti")
    more = cut_lineage(_confirmed(more, full, percent))
    groups = _grouped(more, groups)
    far = found.where("far is not null").select(F.col("far").alias("region"), "id")
    far = far.join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))
    far = cut_lineage(_shared_regions(far, "group").select("id", "group").distinct())
    if far.isEmpty():
        return groups
    return _grouped(_confirmed(_beyond(far, full, percent), full, percent), groups)
