"""Quality classifier: a sparse ensemble of rules.

Statistics of each text are measured in one pass. Trees are grown on a bounded sample of labelled texts; every path
of a tree becomes a conjunctive rule over the statistics, a logistic model with a lasso penalty keeps few of the rules,
and what remains is compiled into one Spark column.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.llm.rows import fresh, per_text
from millrace.session import cut_lineage

#: Labelled texts to learn from: those with the least hash of their id.
SAMPLE_ROWS = 20_000
TREES, PATH_LENGTH, PENALTY, SEED = 24, 3, 0.0005, 7
THRESHOLD = 0.7

STATISTICS = [
    "words", "word_length", "longest", "symbols", "uppercase", "exclamations", "digits", "pipes", "repeats",
    "distinct", "repeated_runs", "repeated_lines", "stops", "blank",
]

_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS, _DIGITS, _UPPER = b"#*$%&<>", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower()


def statistics_of(text: bytes) -> tuple:
    """The statistics of one text, each a number that does not grow with the text except ``words`` and ``longest``."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)

    def count(characters: bytes) -> int:
        return len(text) - len(text.translate(None, characters))

    size = len(text) - count(_CONTINUATION)
    blanks = count(b" \t\n\x0b\x0c\r")
    letters = count(_LETTERS)
    runs = list(zip(words, words[1:], words[2:]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        math.log1p(n),
        (size - blanks) / n,
        float(len(max(words, key=len))),
        count(_SYMBOLS) / size,
        count(_UPPER) / letters if letters else 0.0,
        count(b"!") / n,
        count(_DIGITS) / size,
        count(b"|") / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(words)) / n,
        1 - len(set(runs)) / len(runs) if runs else 0.0,
        1 - len(set(lines)) / len(lines),
        count(b".") / n,
        blanks / size,
    )


_FIELDS = T.StructType([T.StructField(name, T.DoubleType()) for name in STATISTICS])


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and the statistics of every row; no shuffle. NULL and empty texts measure 0 throughout."""
    names = [fresh(docs, f"__{name}") for name in STATISTICS]
    fields = T.StructType([T.StructField(name, T.DoubleType()) for name in names])
    return per_text(docs, lambda: statistics_of, fields, keep, text)


@dataclass(frozen=True)
class Rule:
    """Holds where every condition (statistic, whether it is at most, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, place: dict[str, str]) -> Column:
        parts = [
            F.col(f"`{place[name]}`") <= bound if at_most else F.col(f"`{place[name]}`") > bound
            for name, at_most, bound in self.conditions
        ]
        return reduce(Column.__and__, parts)


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, place: dict[str, str] | None = None) -> Column:
        """Chance of label 1 as a column over the statistics, which stand under the names of ``place``."""
        place = place or {name: name for name in STATISTICS}
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(place), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


_NODE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)")


def rules_of(trees: list[str]) -> list[Rule]:
    """Each path from the root to an inner edge or leaf of the trees, as printed, without repeats."""
    found: dict[Rule, None] = {}
    for tree in trees:
        path: list[tuple[int, tuple[str, bool, float]]] = []
        for line in tree.splitlines():
            m = _NODE.match(line)
            if not m:
                continue
            depth = len(m[1])
            path = [p for p in path if p[0] < depth]
            path.append((depth, (STATISTICS[int(m[3])], m[4] == "<=", float(m[5]))))
            found[Rule(tuple(sorted({c for _, c in path})))] = None
    return list(found)


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics and label (y) of at most ``rows`` labelled texts, those with the least hash of their id.

    Only ids and labels are sorted; they are at most ``rows`` when they are sent to the texts.
    """
    place = F.xxhash64(F.col("id").cast("string"))
    chosen = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("double").alias("y")).dropna().distinct()
    chosen = cut_lineage(chosen.orderBy(place, "id", "y").limit(rows))
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    both = texts.join(F.broadcast(chosen), "id")
    found = per_text(both, lambda: statistics_of, _FIELDS, ("id", "y"))
    return cut_lineage(found.repartitionByRange(4, place, "id", "y").sortWithinPartitions(place, *found.columns))


def fit(sample: DataFrame, seed: int = SEED) -> RuleModel:
    """Learn from the columns ``STATISTICS`` and ``y`` (0 or 1). With one class only, the score is its share."""
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not 0 < ones < n:
        share = (ones + 1) / (n + 2)
        return RuleModel((), (), math.log(share / (1 - share)))
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="x").transform(sample).select("x", "y", *STATISTICS)
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=PATH_LENGTH, maxBins=64, seed=seed,
        featureSubsetStrategy="onethird",
    ).fit(vectors)
    rules = rules_of([tree.toDebugString for tree in forest.trees])
    place = {name: name for name in STATISTICS}
    held = vectors.select("y", *[r.column(place).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(held).select("x", "y")
    lasso = LogisticRegression(
        featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=PENALTY, maxIter=100, standardization=True
    ).fit(cut_lineage(held))
    weights = lasso.coefficients.toArray().tolist()
    used = [(r, w) for r, w in zip(rules, weights) if abs(w) > 1e-9]
    return RuleModel(tuple(r for r, _ in used), tuple(w for _, w in used), float(lasso.intercept))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def learned(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> RuleModel:
    allowed = labels.where(~F.coalesce(held_out(F.col(f"`{doc_id}`")), F.lit(True)))
    return fit(sampled(docs, allowed, "quality", rows, doc_id, text))


def scored(docs: DataFrame, model: RuleModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and a column score; further columns hold the statistics.

    Only the text counts. NULL and empty texts get the score of a text without words; repeated rows and NULL ids are
    scored like any row; an empty table gives no rows.
    """
    rows = measured(docs, keep, text)
    place = dict(zip(STATISTICS, rows.columns[len(keep) :]))
    return rows.withColumn(fresh(rows, "score"), model.score(place))
