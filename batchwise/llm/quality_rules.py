"""Operator 1, quality rules with risk-controlled thresholds.

Base rules reject short and repetitive texts outright.  Of what passes them,
each further rule rejects a document whose score (a rate of the text) is above a
cutoff.  The cutoffs are chosen per stratum (the language here) on labelled
holdouts: the ladder of cutoffs is fixed beforehand, so no label was used to
make it, and every labelled document is a holdout.

For each rule and stratum the ladder is walked from the loosest cutoff on.  With
n good documents, of which k are above the cutoff, the cutoff is certified if
P(Binomial(n, share) <= k) <= level, which is the exact (Clopper-Pearson) upper
bound of the false rejection rate being at most ``share``.  Rejections grow along
the ladder, so the walk ends at the first failure: a fixed sequence, which needs
no correction of its own.  Over rules and strata the level is ``delta`` divided
by their number (Bonferroni), and ``share`` is ``max_false_rejection`` divided by
the number of rules.  So, with probability 1 - delta, in every stratum at once at
most ``max_false_rejection`` of the good documents are rejected by all rules
together.  Among certified cutoffs the one that rejects most of the bad
documents beyond its share of good ones is used, the loosest of several alike.
A stratum with too few labels gets no cutoff and keeps what passes the base.

Defined cases: a null text has no word and fails the base.  A null stratum is
the stratum ''.  Labels that are null are left out; of several labels of an id
the smallest counts.  Repeated rows are judged alike.  Without labels, or on an
empty table, nothing but the base applies.  Input columns named like an added
one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .common import short_batches
from .statistics import NAMES, text_statistics

MIN_WORDS = 50
STEPS = 50
DELTA = 0.05
MAX_FALSE_REJECTION = 0.05
# Above this number of strata with a cutoff their table is not broadcast.
MAX_BROADCAST_STRATA = 10_000


@dataclass(frozen=True)
class Ladder:
    """A rule: its score as SQL over the counts, and its cutoffs ``start + step * i`` from the loosest on."""

    name: str
    score: str
    start: float
    step: float

    @property
    def cutoffs(self) -> list[float]:
        return [self.start + self.step * i for i in range(STEPS)]


RULES = (
    Ladder("short_words", "-(word_chars / CAST(n_words AS DOUBLE))", -0.1, -0.1),
    Ladder("long_words", "word_chars / CAST(n_words AS DOUBLE)", 15.0, -0.2),
    Ladder("symbols", "n_symbols / CAST(n_words AS DOUBLE)", 1.0, -0.02),
    Ladder("dup_lines", "n_dup_lines / CAST(n_lines AS DOUBLE)", 1.0, -0.02),
    Ladder("repeats", "n_repeat_words / CAST(n_words AS DOUBLE)", 0.5, -0.01),
    Ladder("capitals", "n_upper / CAST(word_chars AS DOUBLE)", 1.0, -0.02),
)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the counts of the text and base_failed; columns of these names are replaced."""
    short_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (*NAMES, "base_failed", "_counts")]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], text_statistics(F.col(text_col)).alias("_counts"))
    return rows.select(*[F.col(f"`{c}`") for c in others], "_counts.*").withColumn("base_failed", base_failed())


def most_rejected(n: int, share: float, level: float) -> int:
    """The largest k with P(Binomial(n, share) <= k) <= level; -1 if there is none."""
    top = int(n * share) + 1
    i = np.arange(top + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i[:-1]) / (i[:-1] + 1.0)))])  # log of n over i
    below = np.cumsum(np.exp(logs + i * np.log(share) + (n - i) * np.log1p(-share)))
    return int(np.searchsorted(below, level, "right")) - 1


def choose_cutoffs(counts: pd.DataFrame, share: float, level: float) -> list[tuple[str, float]]:
    """(rule, cutoff) for the rules of one stratum; ``counts`` has rule, first (ladder index), good and bad."""
    chosen = []
    for rule in RULES:
        own = counts[counts["rule"] == rule.name]
        good, bad = np.zeros(STEPS + 1), np.zeros(STEPS + 1)
        np.add.at(good, own["first"].to_numpy(int), own["good"].to_numpy(float))
        np.add.at(bad, own["first"].to_numpy(int), own["bad"].to_numpy(float))
        n, n_bad = int(good.sum()), bad.sum()
        if not n or not n_bad:
            continue
        rejected = np.cumsum(good)[:STEPS]  # a cutoff rejects what it or a looser one is first to reject
        certified = rejected <= most_rejected(n, share, level)
        gain = np.where(certified, np.cumsum(bad)[:STEPS] / n_bad - rejected / n, 0.0)
        if gain.max() > 0:
            chosen.append((rule.name, rule.cutoffs[int(gain.argmax())]))
    return chosen


def first_under(rule: Ladder) -> Column:
    """The index of the first cutoff under the score; STEPS if none is."""
    score = F.expr(rule.score)
    return F.size(F.filter(F.array(*map(F.lit, rule.cutoffs)), lambda c: c >= score))


def calibrate(counts: DataFrame, labels: DataFrame, id_col: str, stratum_col: str, label_col: str,
              delta: float = DELTA, max_false_rejection: float = MAX_FALSE_REJECTION) -> DataFrame:
    """One row per stratum that has a cutoff: stratum and a map ``cutoffs`` of rule to cutoff.

    ``counts`` has the id, the stratum, the text's counts and base_failed.
    """
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.min(label_col).alias("_good"))
    rows = counts.where("not base_failed").join(marks, F.col(id_col) == F.col("_id"))
    ladders = F.array(*[F.struct(F.lit(r.name).alias("rule"), first_under(r).alias("first")) for r in RULES])
    rows = rows.select(F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), "_good",
                       F.explode(ladders).alias("l"))
    table = materialize(rows.groupBy("stratum", "l.rule", "l.first").agg(
        F.count(F.when(F.col("_good") == 1, 1)).alias("good"), F.count(F.when(F.col("_good") != 1, 1)).alias("bad")),
        "quality-ladders")
    strata = max(1, table.select("stratum").distinct().count())
    share, level = max_false_rejection / len(RULES), delta / (len(RULES) * strata)

    def choose(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *c) for c in choose_cutoffs(pdf, share, level)],
                            columns=["stratum", "rule", "cutoff"])

    chosen = table.groupBy("stratum").applyInPandas(choose, "stratum string, rule string, cutoff double")
    return materialize(chosen.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")), "quality-cutoffs")


def judged(counts: DataFrame, cutoffs: DataFrame, stratum_col: str) -> DataFrame:
    """``counts`` with rejected_by (the names of the rules that reject) and kept."""
    side = cutoffs.select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cutoffs"))
    if cutoffs.count() <= MAX_BROADCAST_STRATA:
        side = F.broadcast(side)
    own = [c for c in counts.columns if c not in ("rejected_by", "kept")]
    rows = counts.join(side, F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) == F.col("_stratum"), "left")
    hits = F.array_compact(F.array(*[
        F.when(F.expr(r.score) > F.try_element_at(F.col("_cutoffs"), F.lit(r.name)), F.lit(r.name)) for r in RULES]))
    hits = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(hits)
    return rows.select(*[F.col(f"`{c}`") for c in own], hits.alias("rejected_by")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Per row of ``docs``: id, stratum, the counts, base_failed, rejected_by and kept."""
    counts = materialize(with_counts(docs.select(
        F.col(id_col).alias(id_col), F.col(stratum_col).alias(stratum_col), F.col(text_col).alias(text_col)), text_col)
        .drop(text_col), "quality-counts")
    return judged(counts, calibrate(counts, labels, id_col, stratum_col, label_col), stratum_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the rules keep.

    The cutoffs come from a first pass; the second judges each row where it is,
    so that no text is shuffled.
    """
    narrow = docs.select(F.col(id_col).alias(id_col), F.col(stratum_col).alias(stratum_col),
                         F.col(text_col).alias(text_col))
    counts = materialize(with_counts(narrow, text_col).drop(text_col), "quality-counts")
    cutoffs = calibrate(counts, labels, id_col, stratum_col, label_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(text_col).alias("_text"), F.col(stratum_col).alias("_own"))
    kept = judged(with_counts(rows, "_text"), cutoffs, "_own").where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
