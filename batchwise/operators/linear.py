"""M5 / M6: a linear classifier (hinge loss, L2) trained one mini-batch
sub-gradient step per batch (Pegasos), with weights in a table.

State: ``weights (bucket, w)`` (<= n_features rows), the bias and the step
counter.  One step on batch B (labels y in {-1, +1}):

    margin_i = y_i (w . x_i + b)                    join on bucket, sum per row
    V        = {i in B : margin_i < 1}              violators
    eta      = 1 / (lam (t + 1))
    w'       = (1 - eta lam) w + eta / |B| sum_{i in V} y_i x_i
    b'       = b + INTERCEPT_DECAY eta / |B| sum_{i in V} y_i

The weight update is a union of the shrunk old table and the batch gradient,
re-aggregated on bucket; the new version is written to the checkpoint folder
so the chain of batches never grows a lineage.  Binary labels only (label 1
is the positive class), as in the reference's metrics.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import DEFAULT_LAMBDA, INTERCEPT_DECAY
from ..store import materialize
from .features import long_features
from .scoring import Terms, sparse_class_sums


@dataclass
class LinearState:
    weights: DataFrame      # bucket, w
    bias: float
    steps: int
    n_features: int
    lam: float = DEFAULT_LAMBDA


def linear_init(spark, n_features: int, lam: float = DEFAULT_LAMBDA) -> LinearState:
    empty = spark.createDataFrame([], "bucket int, w double")
    return LinearState(empty, 0.0, 0, n_features, lam)


def _margins(state: LinearState, rows: DataFrame, keep: Sequence[str], row_id: str) -> DataFrame:
    """(row_id, keep..., dot) with dot = w . x (0 for rows without overlap)."""
    weights = state.weights.select(F.lit(0).alias("label"), "bucket", "w")
    sums = sparse_class_sums(long_features(rows, keep, row_id), weights, 1, state.n_features, keep, row_id)
    return sums.withColumnRenamed("_dot0", "dot")


def linear_update(state: LinearState, batch_rows: DataFrame, row_id: str = "row_id",
                  path: str | None = None) -> LinearState:
    """M5: one sub-gradient step on one batch (row table with ``label``); the new weights are written
    to ``path``, by default a fresh folder."""
    t = state.steps + 1
    eta = 1.0 / (state.lam * (t + 1))
    y = (2 * F.col("label") - 1).cast("double")
    m = _margins(state, batch_rows, ("label",), row_id).withColumn("y", y)
    m = m.withColumn("margin", F.col("y") * (F.col("dot") + F.lit(state.bias)))
    # one row per batch row, used twice (scalars, violators): keep it for this step only
    m = m.select(row_id, "y", "margin").persist()
    viol = m.where(F.col("margin") < 1.0).select(row_id, "y")
    scal = m.agg(F.count(F.lit(1)).alias("n"),
                 F.coalesce(F.sum(F.when(F.col("margin") < 1.0, F.col("y"))), F.lit(0.0)).alias("sy")).first()
    n = int(scal["n"])
    if n == 0:
        m.unpersist()
        return state
    step = eta / n
    grad = (
        long_features(batch_rows.join(viol, row_id), ("y",), row_id)
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket").agg(F.sum(F.col("y") * F.col("x")).alias("g"))
    )
    shrink = 1.0 - eta * state.lam
    new_w = (
        state.weights.select("bucket", (F.col("w") * F.lit(shrink)).alias("w"))
        .unionByName(grad.select("bucket", (F.col("g") * F.lit(step)).alias("w")))
        .groupBy("bucket").agg(F.sum("w").alias("w"))
    )
    new_w = materialize(new_w, f"linear-w{t}", path=path)
    m.unpersist()
    bias = state.bias + INTERCEPT_DECAY * step * float(scal["sy"])
    return LinearState(new_w, bias, t, state.n_features, state.lam)


def linear_predict(state: LinearState, rows: DataFrame, keep: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """M6: (row_id, keep..., score = w . x + b, predicted = 1 if score > 0 else 0)."""
    m = _margins(state, rows, keep, row_id)
    out = m.withColumn("score", F.col("dot") + F.lit(state.bias)).drop("dot")
    return out.withColumn("predicted", (F.col("score") > 0).cast("int"))


def linear_terms(state: LinearState) -> Terms:
    """M6 as two classes: class 0 scores 0, class 1 scores w . x + b (the larger wins, a tie goes to 0)."""
    return Terms(state.weights.select(F.lit(1).alias("label"), "bucket", "w"), [0.0, state.bias], [0.0, 0.0], "sum_x")
