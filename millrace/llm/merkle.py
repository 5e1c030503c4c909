"""A Merkle manifest of a dataset: one tree per source over its rows, and one tree over the sources.

Nodes carry nested-interval labels: the interval of leaf ranks that they cover. A level is the nodes below it grouped by
``rank div width``, 16 at most. An ancestor is attached to a node by the bucket of its level and by containment of
the intervals; what the interval of the parent covers besides that of the node are its siblings. Proofs are passed down
level by level, so that no join key ever has more than 16 rows on its larger side. Texts stay where they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.numbering import global_row_number
from millrace.session import cut_lineage

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Trees whose first number goes to every task; beyond that they are joined with a shuffle.
BROADCAST_TREES = 100_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STEPS = "array<struct<left:string,right:string>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 of all fields, each ``-`` if NULL, else its UTF-8 byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["digest"]), "")


def _step(kids: Column, lo: Column, hi: Column) -> Column:
    """The siblings of [lo, hi) among the children of its parent, those before it and those after it."""
    left, right = F.filter(kids, lambda k: k["hi"] <= lo), F.filter(kids, lambda k: k["lo"] >= hi)
    return F.struct(_joined(left).alias("left"), _joined(right).alias("right"))


def _level(nodes: DataFrame, k: int, fanout: int, *payload: str) -> DataFrame:
    """Nodes of level ``k`` from those of the level below, with their children; trees of one node there are left out."""
    kid = F.struct("lo", "hi", "digest", *payload)
    found = nodes.where(F.col("size") > fanout ** (k - 1)).groupBy("tree", F.expr(f"lo div {fanout**k}").alias("bucket"))
    found = found.agg(F.first("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(kid)).alias("kids"))
    return cut_lineage(found.withColumn("digest", F.sha2(_joined(F.col("kids")), 256)))


def _levels(leaves: DataFrame, fanout: int, *payload: str) -> list[DataFrame]:
    """All levels above the leaves (tree, size, lo, hi, digest, payload), the lowest first; only the largest size comes to the driver."""
    largest = leaves.agg(F.max("size")).first()[0] or 0
    found, k = [], 1
    while fanout ** (k - 1) < largest:
        below = found[-1] if found else leaves
        found.append(_level(below, k, fanout, *([] if found else payload)))
        k += 1
    return found


def _tops(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("lo") == 0) & (F.col("hi") == F.col("size"))).select("tree", F.col("digest").alias("subroot"))


def _passed_down(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The nodes of the lowest level with the columns of ``tops`` and ``steps``: the siblings on the way up to the root."""
    given = [c for c in tops.columns if c not in ("tree", "steps")]
    above = None
    for k in range(len(levels), 0, -1):
        nodes = levels[k - 1].drop("bucket")
        roots = nodes.where((F.col("lo") == 0) & (F.col("hi") == F.col("size"))).join(tops, "tree")
        if above is not None:
            up = above.select(
                "tree", F.expr(f"lo div {fanout ** (k + 1)}").alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"),
                F.col("kids").alias("of"), *given, F.col("steps").alias("further"),
            )
            met = nodes.withColumn("bucket", F.expr(f"lo div {fanout ** (k + 1)}")).join(up, ["tree", "bucket"])
            met = met.where("`from` <= lo and hi <= `to` and size > hi - lo")
            step = _step(F.col("of"), F.col("lo"), F.col("hi"))
            met = met.withColumn("steps", F.concat(F.array(step), "further").cast(_STEPS))
            roots = roots.unionByName(met.select(*roots.columns))
        above = roots if k == len(levels) else cut_lineage(roots)
    return above


def manifest(
    docs: DataFrame,
    tampered: Column | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    fields: Sequence[str] = FIELDS,
    text: str = "text",
    fanout: int = FANOUT,
) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof (sibling digests from leaf to root) and folded_root.

    ``tampered`` marks the rows whose text is lower-cased (A-Z) before their leaf is folded with the siblings of the
    manifest; folded_root of all other rows comes from their own leaf. A NULL field counts as ``-``, so it differs from
    an empty text; NULL sources are a tree of their own, the first, and NULL ids come first in theirs. Rows that share an
    id are ordered by their leaf; rows alike in all fields are leaves of their own with one digest, and which of them
    stands first makes no difference to digests but to their proofs. A source of one row has its leaf as subroot, and a
    single tree its subroot as root. An empty table gives no rows. Columns other than ``fields`` and the two keys are
    not read, so extra columns and their names do not matter. Texts of any length are hashed whole, where they are read.
    """
    def of(name: str) -> Column:
        return F.col(f"`{name}`")

    leaf = leaf_digest([of(f) for f in fields])
    changed = leaf_digest([F.translate(of(f), _UPPER, _UPPER.lower()) if f == text else of(f) for f in fields])
    folded = leaf if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), changed).otherwise(leaf)
    rows = docs.select(of(source).alias("source"), of(doc_id).alias("doc"), leaf.alias("digest"), folded.alias("folded"))
    rows = global_row_number(rows, [F.col("source").asc_nulls_first(), F.col("doc").asc_nulls_first(), F.col("digest")], "n")
    trees = cut_lineage(rows.groupBy("source").agg(F.min("n").alias("tree"), F.count("*").alias("size")).withColumnRenamed("source", "of"))
    few = F.broadcast(trees) if trees.count() <= BROADCAST_TREES else trees
    leaves = rows.join(few, F.col("source").eqNullSafe(F.col("of")))  # the first number is the tree: sources in order
    leaves = leaves.select(
        "tree", "size", (F.col("n") - F.col("tree")).alias("lo"), (F.col("n") - F.col("tree") + 1).alias("hi"), "digest", "doc", "folded"
    )
    leaves = cut_lineage(leaves)
    levels = _levels(leaves, fanout, "doc", "folded")
    single = leaves.where("size = 1")
    tops = single.select("tree", F.col("digest").alias("subroot"))
    for nodes in levels:
        tops = tops.union(_tops(nodes))
    tops = _rooted(cut_lineage(tops), trees.count(), fanout)
    columns = ["doc", "digest", "subroot", "root", "folded", "steps"]
    found = single.join(tops, "tree").select(*columns)
    if levels:
        runs = _passed_down(levels, tops, fanout).select("kids", "subroot", "root", "steps", F.explode("kids").alias("kid"))
        step = _step(F.col("kids"), F.col("kid.lo"), F.col("kid.hi"))
        each = F.concat(F.array(step), "steps").cast(_STEPS).alias("steps")
        found = found.union(runs.select("kid.doc", "kid.digest", "subroot", "root", "kid.folded", each))
    fold = F.aggregate("steps", F.col("folded"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select(
        F.col("doc").alias(doc_id), F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof"), fold.alias("folded_root")
    )


def _rooted(tops: DataFrame, n: int, fanout: int) -> DataFrame:
    """(tree, subroot, root, steps) of the subroots: the tree over the ``n`` sources, its siblings as first steps."""
    leaves = global_row_number(tops, [F.col("tree")], "n").select(
        F.lit(0).alias("tree"), F.lit(n).cast("long").alias("size"), (F.col("n") - 1).alias("lo"), F.col("n").alias("hi"),
        F.col("subroot").alias("digest"), F.col("tree").alias("of"),
    )
    levels = _levels(leaves, fanout, "of")
    if not levels:  # one source or none
        return tops.select("tree", "subroot", F.col("subroot").alias("root"), F.array().cast(_STEPS).alias("steps"))
    roots = _tops(levels[-1]).withColumn("steps", F.array().cast(_STEPS))
    runs = _passed_down(levels, roots, fanout).select("kids", F.col("subroot").alias("root"), "steps", F.explode("kids").alias("kid"))
    step = _step(F.col("kids"), F.col("kid.lo"), F.col("kid.hi"))
    each = F.concat(F.array(step), "steps").cast(_STEPS).alias("steps")
    return cut_lineage(runs.select(F.col("kid.of").alias("tree"), F.col("kid.digest").alias("subroot"), "root", each))
