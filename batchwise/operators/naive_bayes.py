"""M1-M4: multinomial and Bernoulli naive Bayes as aggregations and joins.

State (additive, so order-free and mergeable):

* ``stats (label, bucket, sum_x, n_present)``: per class and bucket, the sum
  of the scaled feature values (multinomial) and the number of documents in
  which the bucket is present (Bernoulli);
* ``docs (label, n_docs)``: documents per class.

Both are bounded: stats <= k * n_features rows, docs <= k rows.  Training a
batch is a map-side-combined group-by; merging a batch into the state is a
union and a re-aggregate (write it as a new version to cut lineage).

Scoring uses closed forms so that nothing dense over the 2^20 buckets is ever
built:

multinomial  score_c = ln(D_c / D) + s * (ln a - ln(N_c + a F))
                       + sum_{f in row, seen in c} x_f (ln(N_cf + a) - ln a)
Bernoulli    score_c = ln(D_c / D) + sum_f ln(1 - p_cf) + nnz * u_c
                       + sum_{f in row, seen in c} (ln(p_cf / (1 - p_cf)) - u_c)
             p_cf = (D_cf + a) / (D_c + 2a), u_c = ln(a / (D_c + a)),
             sum_f ln(1 - p_cf) = sum over seen buckets + (F - seen_c) ln(1 - a / (D_c + 2a))

with s = sum of the row's x, nnz = number of buckets present in the row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import DEFAULT_ALPHA
from ..functions.text import DEFAULT_N_FEATURES
from .joins import broadcast_if_bounded
from .scoring import Terms, argmax, dots_array, drop_dots, sparse_class_sums


@dataclass
class NBState:
    stats: DataFrame
    docs: DataFrame
    n_classes: int
    n_features: int = DEFAULT_N_FEATURES


def batch_statistics(long_rows: DataFrame, rows: DataFrame, label: str = "label",
                     group: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """One batch (or any set of training rows) -> (stats, docs) deltas.

    ``group`` adds leading key columns (e.g. ``plan`` in a sweep).
    """
    stats = (
        long_rows.where(F.col("bucket").isNotNull())
        .groupBy(*group, F.col(label).alias("label"), "bucket")
        .agg(F.sum("x").alias("sum_x"), F.count(F.lit(1)).alias("n_present"))
    )
    docs = rows.groupBy(*group, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_docs"))
    return stats, docs


def nb_update(state: NBState | None, long_rows: DataFrame, rows: DataFrame, n_classes: int,
              n_features: int = DEFAULT_N_FEATURES, label: str = "label") -> NBState:
    """M1 + M3: add a batch to the state (union + re-aggregate)."""
    stats, docs = batch_statistics(long_rows, rows, label)
    if state is not None:
        stats = state.stats.unionByName(stats).groupBy("label", "bucket").agg(
            F.sum("sum_x").alias("sum_x"), F.sum("n_present").alias("n_present"))
        docs = state.docs.unionByName(docs).groupBy("label").agg(F.sum("n_docs").alias("n_docs"))
    return NBState(stats, docs, n_classes, n_features)


@dataclass
class ClassScalars:
    n_docs: list[float]
    total_x: list[float]
    seen: list[int]
    log1m_seen: list[float]


def class_scalars(state: NBState, alpha: float = DEFAULT_ALPHA) -> ClassScalars:
    """Per-class scalars in one small job (k rows reach the driver; nothing per row or bucket)."""
    k = state.n_classes
    d = broadcast_if_bounded(state.docs, k)
    per = (
        state.stats.join(d, "label")
        .groupBy("label")
        .agg(
            F.sum("sum_x").alias("total_x"),
            F.count(F.lit(1)).alias("seen"),
            F.sum(F.log(1.0 - (F.col("n_present") + alpha) / (F.col("n_docs") + 2 * alpha))).alias("log1m"),
        )
    )
    rows = {r["label"]: r for r in state.docs.join(per, "label", "left").collect()}
    return ClassScalars(
        n_docs=[float(rows[j]["n_docs"]) if j in rows else 0.0 for j in range(k)],
        total_x=[float(rows[j]["total_x"] or 0.0) if j in rows else 0.0 for j in range(k)],
        seen=[int(rows[j]["seen"] or 0) if j in rows else 0 for j in range(k)],
        log1m_seen=[float(rows[j]["log1m"] or 0.0) if j in rows else 0.0 for j in range(k)],
    )


def _log_priors(cs: ClassScalars) -> list[float]:
    total = sum(cs.n_docs)
    return [math.log(n / total) if n > 0 else float("-inf") for n in cs.n_docs]


def mnb_terms(state: NBState, alpha: float = DEFAULT_ALPHA, scalars: ClassScalars | None = None) -> Terms:
    """M2 as score = a + sum_x * b + sum of x * w."""
    cs = scalars or class_scalars(state, alpha)
    weights = state.stats.select("label", "bucket", (F.log(F.col("sum_x") + alpha) - math.log(alpha)).alias("w"))
    slopes = [math.log(alpha) - math.log(total + alpha * state.n_features) for total in cs.total_x]
    return Terms(weights, _log_priors(cs), slopes, "sum_x")


def bnb_terms(state: NBState, alpha: float = DEFAULT_ALPHA, scalars: ClassScalars | None = None) -> Terms:
    """M4 as score = a + nnz * b + sum of w over the buckets present."""
    cs = scalars or class_scalars(state, alpha)
    weights = state.stats.join(broadcast_if_bounded(state.docs, state.n_classes), "label").select(
        "label", "bucket",
        (F.log((F.col("n_present") + alpha) / (F.col("n_docs") - F.col("n_present") + alpha))
         - F.log(alpha / (F.col("n_docs") + alpha))).alias("w"))
    prior = _log_priors(cs)
    offsets, slopes = [], []
    for j, dc in enumerate(cs.n_docs):
        absent = cs.log1m_seen[j] + (state.n_features - cs.seen[j]) * math.log(1.0 - alpha / (dc + 2 * alpha))
        offsets.append(prior[j] + absent)
        slopes.append(math.log(alpha / (dc + alpha)))
    return Terms(weights, offsets, slopes, "nnz", binary=True)


def _predict(terms: Terms, state: NBState, long_rows: DataFrame, keep: Sequence[str], row_id: str) -> DataFrame:
    k = state.n_classes
    sums = sparse_class_sums(long_rows, terms.weights, k, state.n_features, keep, row_id, binary=terms.binary)
    dots = dots_array(k)
    per_row = F.col(terms.per_row).cast("double")
    scores = F.array(*[F.lit(terms.a[j]) + per_row * F.lit(terms.b[j]) + dots[j] for j in range(k)])
    out = drop_dots(sums.withColumn("scores", scores), k)
    return out.withColumn("predicted", argmax(F.col("scores")))


def mnb_predict(state: NBState, long_rows: DataFrame, keep: Sequence[str], alpha: float = DEFAULT_ALPHA,
                row_id: str = "row_id", scalars: ClassScalars | None = None) -> DataFrame:
    """M2: (row_id, keep..., scores array<double>, predicted).

    ``keep`` must contain ``sum_x`` (the row's sum of x).
    """
    return _predict(mnb_terms(state, alpha, scalars), state, long_rows, keep, row_id)


def bnb_predict(state: NBState, long_rows: DataFrame, keep: Sequence[str], alpha: float = DEFAULT_ALPHA,
                row_id: str = "row_id", scalars: ClassScalars | None = None) -> DataFrame:
    """M4: (row_id, keep..., scores array<double>, predicted).

    ``keep`` must contain ``nnz`` (buckets present in the row).  Present means
    x > 0, which holds for every stored bucket.
    """
    return _predict(bnb_terms(state, alpha, scalars), state, long_rows, keep, row_id)
