"""Line dedup: lines that stand in many documents lose all their copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.rows import SPACES, fresh_names, row_key
from millrace.session import cut_lineage

MIN_DOCUMENTS, MIN_LENGTH = 10, 1
#: Hashes of common lines that are sent to every task; beyond that they are joined with a shuffle.
BROADCAST_ROWS = 1_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """What makes two lines the same: no white space at the ends, A-Z as a-z."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _UPPER.lower())


def common_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH,
) -> DataFrame:
    """Two 64-bit hashes (h1, h2) of each line key found in at least ``min_documents`` documents.

    A document gives each of its keys once; pairs are made distinct on the map side first, and the count is
    combined there, so a line of every document reaches the last shuffle as one row per task.
    """
    keys = F.array_distinct(F.transform(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n"), line_key))
    each = docs.select(F.col(f"`{doc_id}`").alias("d"), F.explode(keys).alias("k")).where(F.length("k") >= min_length)
    h1, h2 = row_key(F.col("k"))
    seen = each.select("d", h1.alias("h1"), h2.alias("h2")).distinct()
    return seen.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("h1", "h2")


def drop_common_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_documents: int = MIN_DOCUMENTS,
    min_length: int = MIN_LENGTH,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """All rows and columns of ``docs``, with three more behind them: n_lines, n_dropped and kept_text.

    One of the three whose name ``docs`` has already gets underscores behind it. A NULL text counts as one empty line;
    keys shorter than ``min_length`` code points are never dropped. A document is a doc_id: rows that repeat an id count
    once, and rows without an id count as one document together. Each row is rebuilt on its own, by line position, so
    repeated rows all stay; a row that loses no line passes with its own text. A text of any number of lines takes time in
    proportion. An empty table gives no rows. The common lines are broadcast if there are at most ``broadcast_rows`` of
    them, else joined with a shuffle.
    """
    common = cut_lineage(common_lines(docs, doc_id, text, min_documents, min_length))
    if common.count() <= broadcast_rows:
        common = F.broadcast(common)
    a, b, marks, split = fresh_names(docs.columns, ["__a", "__b", "__marks", "__lines"])
    names = fresh_names(docs.columns, ["n_lines", "n_dropped", "kept_text"])
    key_a, key_b = row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.select(key_a.alias("a"), key_b.alias("b"), whole.alias("t"))  # hashed before it is exploded, not for each line
    place = keyed.select("a", "b", F.posexplode(F.split("t", "\n")).alias("at", "line"))
    h1, h2 = row_key(line_key(F.col("line")))
    place = place.select("a", "b", "at", h1.alias("h1"), h2.alias("h2"))
    dropped = place.join(common, ["h1", "h2"], "left_semi")
    dropped = dropped.groupBy("a", "b").agg(F.collect_set("at").alias("m"))  # places of one document
    # The lines go through the join in the place of the text: as a column they are split once, whatever is asked of them.
    held = [F.split(F.col(f"`{c}`"), "\n").alias(split) if c == text else F.col(f"`{c}`") for c in docs.columns]
    joined = docs.select(*held, key_a.alias(a), key_b.alias(b)).join(dropped.toDF(a, b, marks), [a, b], "left")
    lines, gone = F.col(f"`{split}`"), F.col(f"`{marks}`")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    rebuilt = F.array_join(F.transform(places, lambda at: lines.getItem(at)), "\n")
    whole = F.array_join(lines, "\n")
    return joined.select(
        *[whole.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.when(lines.isNull(), F.lit(1)).otherwise(F.size(lines)).cast("long").alias(names[0]),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(names[1]),
        F.when(gone.isNull(), F.coalesce(whole, F.lit(""))).otherwise(rebuilt).alias(names[2]),
    )
