"""Operator 3, toxicity: a factorization machine over hashed terms.

A term is a lower-cased run of letters, or the first letters of a longer one; a
text is the set of its terms, hashed into buckets.  The features are the buckets that tell the classes apart, alone or
with another one: a term may say nothing by itself and all with a second term.  They go into a second-order
factorization machine

    score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)   over the text's terms,

whose factors give weight to pairs (an insult with the mention of a group) that
additive weights miss.  It is fitted on a bounded sample of labelled texts, each
distinct one once, MAX_TRAIN of a class by the hash of their text; pairs are searched
among the PAIR_TERMS most frequent terms of the sample.  Every document is scored
in its whole, however long.

Labels are learned from rows that are not held out; ids, sources, languages and
labels are no inputs.  Defined cases: a null text counts as empty, and a text
without terms has score sigmoid(w0).  Columns other than id and text are not read,
so their names cannot clash.  Null labels are left out; of several labels
of an id the largest counts.  If only one class is at hand the score is its
smoothed share, and 0.5 without any label.  Repeated rows have equal scores; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .common import held_out, short_batches

BUCKETS = 1 << 18
TERM = re.compile(r"[^\W\d_]+")
# A longer term counts by its first letters too, so that its inflections are known by their stem.
STEMS = (5, 6, 7)
# The bound of the sample that the model is fitted on, in labelled rows of each class.
MAX_TRAIN = 10_000
MAX_FEATURES = 4096
MIN_DOCUMENTS = 4
# Terms among which pairs are searched, and the standard score from which a pair counts (some 5.4 for one false pair).
PAIR_TERMS, PAIR_SCORE = 4096, 6.0
# Features that come from pairs, at most.
MAX_PAIRED = 512
FACTORS = 4
EPOCHS, BATCH, RATE, SHRINK = 25, 256, 0.1, 2e-4
SEED = 3


def buckets_of(text: str | None) -> np.ndarray:
    terms = set(TERM.findall((text or "").lower()))
    stems = {f"^{t[:n]}" for n in STEMS for t in terms if len(t) > n}
    crc, mask = zlib.crc32, BUCKETS - 1
    found = {crc(t.encode("utf-8", "surrogatepass")) & mask for t in terms | stems}
    return np.fromiter(found, np.int32, len(found))


def _buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([np.sort(buckets_of(t)) for t in texts])


@dataclass(frozen=True)
class Machine:
    """``place`` has the feature of each bucket, or -1."""

    place: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, buckets: np.ndarray) -> float:
        at = self.place[buckets]
        at = at[at >= 0]
        v = self.v[at]
        total = self.w0 + self.w[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v ** 2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def choose_features(sample: DataFrame, n: int, ones: int) -> tuple[np.ndarray, np.ndarray]:
    """(the buckets whose presence says most about the class, by the square of their standard score; the most frequent ones).

    ``sample`` has _label and the array b of buckets; at most MAX_FEATURES + PAIR_TERMS numbers reach the driver.
    """
    share = F.lit(ones / n)
    seen = materialize(sample.select("_label", F.explode("b").alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("seen"), F.sum("_label").alias("ones")).where(F.col("seen") >= MIN_DOCUMENTS),
        "toxicity-seen")
    z = F.pow(F.col("ones") - F.col("seen") * share, 2) / (F.col("seen") * share * (1 - share))
    best = seen.select("bucket", z.alias("z")).where("z > 9").orderBy(F.col("z").desc(), "bucket").limit(MAX_FEATURES)
    # a term in nearly all texts pairs with nothing
    often = seen.where(F.col("seen") <= 0.95 * n).orderBy(F.col("seen").desc(), "bucket").limit(PAIR_TERMS)
    return tuple(np.sort(np.array([r["bucket"] for r in d.collect()], np.int64)) for d in (best, often))


def paired(rows: list[np.ndarray], y: np.ndarray, terms: int) -> np.ndarray:
    """The terms (numbers in ``rows``) of pairs whose meeting separates the classes beyond what each does alone.

    For the pair i, j the statistic is the sum over texts of (y - mean) (x_i - p_i) (x_j - p_j), divided by its
    standard deviation for independent ones: one blocked matrix product over a sample of bounded size.
    """
    n = len(y)
    p = np.bincount(np.concatenate(rows), minlength=terms) / n
    centred, products = y - y.mean(), np.zeros((terms, terms), np.float32)
    for at in range(0, n, 1024):
        own = rows[at:at + 1024]
        x = np.zeros((len(own), terms), np.float32)
        x[np.repeat(np.arange(len(own)), [len(r) for r in own]), np.concatenate(own)] = 1
        x -= p.astype(np.float32)
        products += x.T @ (x * centred[at:at + 1024, None].astype(np.float32))
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    products /= np.outer(spread, spread * np.sqrt((centred ** 2).sum()))
    # terms that come together nearly always (a word and its stem) are no pair
    np.fill_diagonal(products, 0)
    best = np.abs(products).max(1)
    order = np.argsort(-best, kind="stable")[:MAX_PAIRED]
    return order[best[order] >= PAIR_SCORE]


def fit(place: np.ndarray, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Machine:
    """A factorization machine with logistic loss, by adaptive gradient steps in a fixed order.

    ``place`` has the feature of each bucket; ``rows`` has the features of each text.
    """
    n, total = len(y), weight.sum()
    share = (float((y * weight).sum()) + 1) / (float(total) + 2)
    w0 = float(np.log(share / (1 - share)))
    size = int(place.max()) + 1
    if n == 0 or y.min() == y.max():
        return Machine(place, w0, np.zeros(size), np.zeros((size, FACTORS)))
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(size), rng.normal(0, 0.05, (size, FACTORS))
    g0, gw, gv = 1e-8, np.full(size, 1e-8), np.full(v.shape, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            own = order[at:at + BATCH]
            lengths = np.array([len(rows[i]) for i in own])
            col = np.concatenate([rows[i] for i in own])
            row = np.repeat(np.arange(len(own)), lengths)
            vs = v[col]
            sums = np.stack([np.bincount(row, vs[:, f], len(own)) for f in range(FACTORS)], 1)
            squares = np.bincount(row, (vs ** 2).sum(1), len(own))
            raw = w0 + np.bincount(row, w[col], len(own)) + 0.5 * ((sums ** 2).sum(1) - squares)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[own]) * weight[own] / len(own)
            d0 = err.sum()
            dw = np.bincount(col, err[row], len(w)) + SHRINK * w
            dvs = err[row, None] * (sums[row] - vs)
            dv = np.stack([np.bincount(col, dvs[:, f], len(w)) for f in range(FACTORS)], 1) + SHRINK * v
            g0, gw, gv = g0 + d0 ** 2, gw + dw ** 2, gv + dv ** 2
            w0 -= RATE * d0 / g0 ** 0.5
            w -= RATE * dw / gw ** 0.5
            v -= 0.5 * RATE * dv / gv ** 0.5
    return Machine(place, w0, w, v)


def _packed(place: np.ndarray, buckets: Column) -> Column:
    """The places of an array of buckets as bytes, those without a place left out."""
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([(a := place[b])[a >= 0].astype(np.int16).tobytes() for b in lists], dtype=object)

    return F.pandas_udf(features, "binary")(buckets)


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Machine:
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(label_col).alias("_label"))
    # ids and texts' hashes first: only the sample's texts are turned into terms
    rows = docs.select(F.col(id_col).alias("_doc"), held_out(id_col).alias("_held"), F.col(text_col).alias("_text"))
    rows = rows.where("not _held").withColumn("_at", F.xxhash64("_text", F.lit(SEED)))
    # copies of a text with the same label count once
    narrow = materialize(rows.select("_doc", "_at").join(marks, F.col("_doc") == F.col("_id")).groupBy(
        "_at", F.col("_label").cast("int").alias("_label")).agg(F.min("_doc").alias("_doc")), "toxicity-labelled")
    counts = {r["_label"]: r["n"] for r in narrow.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    samples = [narrow.where(F.col("_label") == k).orderBy("_at", "_doc").limit(MAX_TRAIN) for k in (0, 1)]
    sample = materialize(samples[0].unionByName(samples[1]), "toxicity-sample")
    # at most 2 * MAX_TRAIN rows of three numbers are broadcast; rows that repeat id and text are one again
    texts = rows.join(F.broadcast(sample), ["_doc", "_at"]).groupBy("_label", "_at", "_doc").agg(
        F.first("_text").alias("_text"))
    picked = materialize(texts.select("_label", "_at", "_doc", F.pandas_udf(_buckets, "array<int>")("_text").alias("b")),
                         "toxicity-terms")
    used = {r["_label"]: r["n"] for r in picked.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = np.full(BUCKETS, -1)
    often = np.full(BUCKETS, -1)
    if used.get(0) and used.get(1):
        chosen, frequent = choose_features(picked, used[0] + used[1], used[1])
        place[chosen] = np.arange(len(chosen))
        often[frequent] = np.arange(len(frequent))

    # at most MAX_FEATURES + PAIR_TERMS small numbers a row reach the driver
    got = picked.select("_label", "_at", "_doc", _packed(often, F.col("b")).alias("o")).collect()
    got.sort(key=lambda r: (r["_at"], r["_label"], str(r["_doc"])))
    y = np.array([r["_label"] for r in got], float)
    if often.max() >= 1:
        of_pairs = frequent[paired([np.frombuffer(r["o"], np.int16) for r in got], y, len(frequent))]
        chosen = np.union1d(chosen, of_pairs)
        place[:] = -1
        place[chosen] = np.arange(len(chosen))
    got = picked.select("_label", "_at", "_doc", _packed(place, F.col("b")).alias("f")).collect()
    got.sort(key=lambda r: (r["_at"], r["_label"], str(r["_doc"])))
    weight = np.array([counts.get(r["_label"], 0) / used[r["_label"]] for r in got])
    return fit(place, [np.frombuffer(r["f"], np.int16).astype(np.int64) for r in got], y,
               weight / weight.mean() if len(y) else weight)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", at_least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: id, held_out, score and predicted (1 if the score is at least ``at_least``)."""
    short_batches(docs.sparkSession)
    machine = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = machine.value
        for texts in batches:
            yield pd.Series([own.score(buckets_of(t)) for t in texts], dtype="float64")

    rows = docs.select(F.col(id_col).alias(id_col), held_out(id_col).alias("held_out"),
                       scores(F.col(text_col).cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= at_least).cast("int"))
