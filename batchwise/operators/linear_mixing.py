"""M5 nearer to row order: local passes row by row, their weights averaged (parameter mixing).

The rows of a batch are dealt by a hash of their id to parts of about ``part_rows``
rows.  Each part starts from the batch's weights and takes one step for each of its
rows, in the order of their ids (t counts on from the batches before):

    eta  = 1 / (lam (1 / (lam FIRST_STEP) + t))
    w   <- (1 - eta lam) w,  and where y (w . x + b) < 1 before that:  w <- w + eta y x,  b <- b + INTERCEPT_DECAY eta y

The new weights are the mean of the parts' weights, each part counted by its rows,
and t grows by the mean number of rows of a part.  With one part this is the pass in
row order.  A part hands back what it changed and the factor it shrank the rest by,
so buckets it never met are not sent.  A task holds the features of one part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import INTERCEPT_DECAY
from ..store import materialize
from .features import long_features
from .joins import broadcast_if_bounded
from .linear import LinearState

PART_ROWS = 1024
FIRST_STEP = 10.0


def local_pass(group: pd.DataFrame, bias: float, steps: int, lam: float,
               row_id: str = "row_id") -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """(buckets, change beyond shrinking, shrink factor, bias, rows) after one step for each row of the part."""
    group = group.sort_values(row_id, kind="stable")
    starts = np.flatnonzero(np.r_[True, group[row_id].to_numpy()[1:] != group[row_id].to_numpy()[:-1]])
    label, real = group["label"].to_numpy()[starts], group["bucket"].notna().to_numpy()
    buckets, at = np.unique(group["bucket"].fillna(-1).to_numpy(np.int64), return_inverse=True)
    x = np.where(real, group["x"].to_numpy(float), 0.0)
    began = np.zeros(len(buckets))
    began[at] = group["w"].fillna(0.0).to_numpy(float)
    v, scale = began.copy(), 1.0
    for i, (low, high) in enumerate(zip(starts, np.r_[starts[1:], len(group)]), 1):
        y = 2.0 * label[i - 1] - 1.0
        eta = 1.0 / (lam * (1.0 / (lam * FIRST_STEP) + steps + i))
        margin = y * (scale * float(v[at[low:high]] @ x[low:high]) + bias)
        scale *= 1.0 - eta * lam
        if margin < 1.0:
            v[at[low:high]] += eta * y / scale * x[low:high]
            bias += INTERCEPT_DECAY * eta * y
    own = buckets >= 0
    return buckets[own], (scale * (v - began))[own], scale, bias, len(starts)


def linear_mix_update(state: LinearState, batch_rows: DataFrame, n_rows: int, row_id: str = "row_id",
                      part_rows: int = PART_ROWS, path: str | None = None) -> LinearState:
    """M5: one batch of local passes; ``n_rows`` (about right is enough) sets the number of parts.

    Binary labels; a row without tokens takes its step on the bias alone; an empty batch changes nothing.
    """
    parts = max(1, math.ceil(n_rows / part_rows))
    weights = broadcast_if_bounded(state.weights, state.n_features)
    dealt = long_features(batch_rows, ("label",), row_id).join(weights, "bucket", "left").withColumn(
        "_part", F.pmod(F.xxhash64(row_id), F.lit(parts)))
    bias, steps, lam = state.bias, state.steps, state.lam

    def train(group: pd.DataFrame) -> pd.DataFrame:
        buckets, change, scale, b, n = local_pass(group, bias, steps, lam, row_id)
        changed = pd.DataFrame({"bucket": buckets, "v": n * change})
        # the part's scalars in a row of their own
        return pd.concat([changed.assign(n=0), pd.DataFrame({"bucket": [-1], "v": 0.0, "n": n, "s": n * scale,
                                                             "b": n * b})])

    trained = materialize(dealt.groupBy("_part").applyInPandas(train, "bucket int, v double, n long, s double, b double"),
                          f"linear-parts{steps}")
    total = trained.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("b").alias("b"),
                        F.count_if(F.col("bucket") < 0).alias("parts")).first()
    n = total["n"] or 0
    if not n:
        return state
    shrunk = state.weights.select("bucket", (F.col("w") * F.lit(total["s"] / n)).alias("w"))
    moved = trained.where(F.col("bucket") >= 0).select("bucket", (F.col("v") / F.lit(float(n))).alias("w"))
    new_w = materialize(shrunk.unionByName(moved).groupBy("bucket").agg(F.sum("w").alias("w")), "linear-mix-w", path=path)
    return LinearState(new_w, total["b"] / n, steps + math.ceil(n / total["parts"]), state.n_features, lam)
