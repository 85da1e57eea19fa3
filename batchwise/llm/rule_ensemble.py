"""Operator 2, quality classifier: a sparse rule ensemble.

Shallow trees of a random forest over text statistics give conjunctive rules
(one per path from the root to a node), a logistic regression with an L1 penalty
weighs them, and the rules with a weight other than 0 are compiled into one
Spark column expression that scores every document.

Labels are learned from rows that are not held out; ids, sources, languages and
labels are no inputs.  Defined cases: a null text counts as empty, and an empty
one is scored as any other (its statistics are 0).  Null labels are left out; of
several labels of an id the smallest counts.  If only one class is at hand the
score is its smoothed share, and 0.5 without any label.  Repeated rows have
equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .common import held_out, short_batches
from .statistics import text_statistics

# Statistics of a text, SQL over its counts.  greatest(.., 1) keeps empty texts defined.
FEATURES = {
    "words": "ln(1.0 + n_words)",
    "word_length": "word_chars / CAST(greatest(n_words, 1) AS DOUBLE)",
    "symbols": "n_symbols / CAST(greatest(n_words, 1) AS DOUBLE)",
    "dup_lines": "n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE)",
    "repeats": "n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE)",
    "distinct": "n_distinct_words / CAST(greatest(n_words, 1) AS DOUBLE)",
    "line_words": "n_words / CAST(greatest(n_lines, 1) AS DOUBLE)",
    "capitals": "n_upper / CAST(greatest(word_chars, 1) AS DOUBLE)",
    "digits": "n_digits / CAST(greatest(word_chars, 1) AS DOUBLE)",
    "stops": "n_stops / CAST(greatest(n_words, 1) AS DOUBLE)",
}
TREES, DEPTH = 24, 3
L1 = 0.001
SEED = 2


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.terms:
            out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
        return out

    @staticmethod
    def of(path: list[tuple[str, bool, float]]) -> Rule:
        """Terms on one feature and side are merged into the tightest."""
        tight: dict[tuple[str, bool], float] = {}
        for name, above, at in path:
            old = tight.get((name, above))
            tight[name, above] = at if old is None else (max if above else min)(old, at)
        return Rule(tuple(sorted((n, a, t) for (n, a), t in tight.items())))


def rules_of(debug: str, names: list[str]) -> list[Rule]:
    """The rules of every path in a tree ensemble's printed form, without repetition."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in debug.splitlines():
        if m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            indent = len(m[1])
            while path and path[-1][0] >= indent:
                path.pop()
            path.append((indent, (names[int(m[2])], m[3] == ">", float(m[4]))))
            found[Rule.of([t for _, t in path])] = None
        elif line.lstrip().startswith("Tree "):
            path = []
    return list(found)


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    short_batches(docs.sparkSession)
    counts = docs.select(F.col(id_col).alias(id_col), text_statistics(F.col(text_col)).alias("_c"))
    return counts.select(id_col, "_c.*").select(
        id_col, held_out(id_col).alias("held_out"), *[F.expr(e).alias(name) for name, e in FEATURES.items()])


def learn(train: DataFrame) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from the columns of FEATURES and ``label`` (0 or 1)."""
    n, ones = train.agg(F.count("label"), F.sum("label")).first()
    ones = ones or 0
    if not n or ones in (0, n):
        share = (ones + 1) / (n + 2)
        return math.log(share / (1 - share)), []
    names = list(FEATURES)
    rows = train.select(F.col("label").cast("double").alias("label"),
                        array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, subsamplingRate=0.7,
                                    featureSubsetStrategy="onethird", seed=SEED).fit(rows)
    rules = rules_of(forest.toDebugString, names)
    if not rules:
        return math.log(ones / (n - ones)), []
    held = train.select(F.col("label").cast("double").alias("label"),
                        array_to_vector(F.array(*[r.holds().cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=L1, maxIter=60, tol=1e-5).fit(held)
    weights = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w]
    return float(model.intercept), weights


def score_of(intercept: float, weights: list[tuple[Rule, float]]) -> Column:
    total = F.lit(intercept)
    for rule, w in weights:
        total = total + F.when(rule.holds(), F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     label_col: str = "quality", at_least: float = 0.3) -> DataFrame:
    """Per row of ``docs``: id, held_out, score and predicted (1 if the score is at least ``at_least``)."""
    rows = materialize(features(docs, id_col, text_col), "rule-ensemble")
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.min(label_col).alias("label"))
    train = materialize(rows.where("not held_out").join(marks, F.col(id_col) == F.col("_id")).select(
        *FEATURES, "label"), "rule-ensemble-train")
    score = score_of(*learn(train))
    return rows.select(id_col, "held_out", score.alias("score")).withColumn(
        "predicted", (F.col("score") >= at_least).cast("int"))
