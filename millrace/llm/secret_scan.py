"""Secret scans with fixed patterns and character Markov models, as DataFrame expressions throughout.

Two first-order models give the chance of each character after the one before: one learned from random strings, one
from ordinary identifiers. A long token whose log-likelihood ratio favours the random model is reported beside what
the patterns find.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from millrace.session import cut_lineage

# The patterns of the kinds that are always reported.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A token is scored when it is this long, and reported when the mean ratio of its steps reaches the limit (in nats).
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MEAN_RATIO = 0.4
#: Documents whose words and digests are the labelled samples, those with the least hash of their text, and digests of each.
SAMPLE_DOCUMENTS, DIGESTS = 1_000, 8

_NO_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


@dataclass(frozen=True)
class MarkovRatio:
    """Log-likelihood ratio of each step between two characters of ``ALPHABET``, row by row."""

    steps: tuple[float, ...]

    def mean(self, token: Column) -> Column:
        """Mean ratio per step; characters outside the alphabet do not occur in tokens."""
        table = F.from_json(F.lit(json.dumps(self.steps)), "array<double>")
        size = len(ALPHABET)
        place = lambda at: F.instr(F.lit(ALPHABET), F.substring(token, at, F.lit(1))) - 1
        total = F.aggregate(
            F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0),
            lambda acc, i: acc + F.get(table, place(i) * size + place(i + 1)),
        )
        return total / (F.length(token) - 1)


def samples(docs: DataFrame, text: str = "text", documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Labelled strings (random, token) made from a bounded sample of documents.

    Random strings are digests of the sampled texts, written in hexadecimal, in base 64 and in capitals with digits.
    Ordinary identifiers are their words, alone and joined in twos the way names and paths are.
    """
    t = F.col(f"`{text}`")
    texts = docs.select(t.alias("t"), F.xxhash64(t).alias("h")).where("t is not null")
    least = cut_lineage(texts.select("h").distinct().orderBy("h").limit(documents))  # hashes only are sorted
    chosen = cut_lineage(texts.join(F.broadcast(least), "h").dropDuplicates(["h"]).select("t"))
    salted = chosen.select(F.sha2("t", 256).alias("d"), F.explode(F.sequence(F.lit(1), F.lit(DIGESTS))).alias("salt"))
    digest = F.sha2(F.concat("d", F.col("salt").cast("string")), 256)
    base64 = F.rtrim(F.base64(F.unhex(digest)), F.lit("="))
    random = salted.select(F.lit(1).alias("random"), F.explode(F.array(digest, base64, base64, F.upper(base64))).alias("token"))
    words = F.regexp_extract_all("t", F.lit(r"[A-Za-z]{3,}"), F.lit(0))
    named = chosen.select(words.alias("w"))
    at = F.sequence(F.lit(1), F.size("w") - 1)
    joined = F.transform(
        at, lambda i: F.concat(
            F.get("w", i - 1), F.element_at(F.array(*[F.lit(x) for x in ("_", "-", "", "/")]), F.pmod(i, F.lit(4)) + 1),
            F.when(i % 3 == 0, F.initcap(F.get("w", i))).when(i % 3 == 1, F.upper(F.get("w", i))).otherwise(F.get("w", i)),
        ),
    )
    ordinary = named.where(F.size("w") > 1).select(F.lit(0).alias("random"), F.explode(joined).alias("token"))
    return random.union(ordinary)


def trained(strings: DataFrame) -> MarkovRatio:
    """The ratio of the two models of labelled strings (random 1 or 0, token), with one added to every step.

    Steps are counted in Spark; what comes to the driver is at most two counts for each pair of the alphabet.
    """
    steps = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))
    counted = strings.where(F.length("token") > 1).select("random", F.explode(steps).alias("step"))
    counted = counted.where(F.col("step").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "step").count().collect()
    size = len(ALPHABET)
    tables = {0: [[1.0] * size for _ in ALPHABET], 1: [[1.0] * size for _ in ALPHABET]}
    for row in counted:
        tables[row.random][ALPHABET.index(row.step[0])][ALPHABET.index(row.step[1])] += row["count"]
    chance = {k: [[v / sum(line) for v in line] for line in table] for k, table in tables.items()}
    return MarkovRatio(tuple(math.log(chance[1][i][j] / chance[0][i][j]) for i in range(size) for j in range(size)))


def _found(text: Column, pattern: str, kind: str, holds, present: str | None = None) -> Column:
    """Spans of the leftmost matches that ``holds`` accepts, counted in code points."""
    parts = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NO_SPANS).alias("out"))

    def step(state: Column, one: Column) -> Column:
        begin = state["at"] + one["gap"]
        end = begin + F.length(one["m"])
        span = F.struct(
            begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")
        )
        out = F.when(holds(one["m"]), F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    spans = F.aggregate(sizes, start, step, lambda state: state["out"])
    return F.when(text.rlike(present or pattern), spans).otherwise(F.array().cast(_NO_SPANS))


def _joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan(docs: DataFrame, model: MarkovRatio, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, base (spans of the fixed patterns) and spans (those and the Markov spans), both by start, then kind.

    Spans are (start, rank, end, kind) in code points, the end exclusive. A token that meets a base span is not
    reported again. NULL and empty texts have no spans; rows are read one by one without a shuffle, so repeated rows
    and NULL ids change nothing.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, t.alias("t"))
    t = F.col("t")
    assign = _found(t, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8)
    access = _found(t, r"AKIA[A-Z0-9]{12,}", "access", lambda m: F.length(m) >= 16)  # runs are taken whole, so the
    found = _found(t, r"[0-9a-f]{32,}", "hex", lambda m: F.length(m) >= 32)  # least length may stand in the pattern
    base = rows.withColumn("base", F.array_sort(F.concat(assign, access, found)))
    tokens = _found(t, TOKEN, "markov", lambda m: model.mean(m) >= MEAN_RATIO)
    alone = F.filter(
        tokens, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    done = base.withColumn("spans", F.array_sort(F.concat("base", alone)))
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    return done.select(*names, "base", "spans")


def digests(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        *[F.col(f"`{c}`") for c in keep], number("assign"), number("access"), number("hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
