"""Per-row, per-class sparse dot products and arg-max / arg-min.

All incremental models score a row against k classes (or clusters) as

    score[j] = a[j] + b[j] * s + sum over the row's buckets f of x_f * w[j, f]

with per-class scalars a, b (k values, known on the driver), a per-row
scalar s and a sparse model table w.  The sparse part is one join of the
long feature table with the bounded model table on ``bucket`` followed by a
group-by on the row, with one conditional sum per class.  The rows of one row
id sit in one task (they come from one exploded row), so partial aggregation
collapses them before the shuffle: the exchange carries about one record per
row, not one per feature.  No rows x classes cross product is formed; the k
scores live in an array column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import MAX_BROADCAST_BYTES, MODEL_ROW_BYTES, join_packed


@dataclass
class Terms:
    """A trained model in the form above."""

    weights: DataFrame      # label, bucket, w
    a: list[float]
    b: list[float]
    per_row: str            # the row scalar s: sum_x or nnz
    binary: bool = False    # a bucket present counts as x = 1


def sparse_class_sums(long_rows: DataFrame, weights: DataFrame, n_classes: int, n_features: int,
                      keep: Sequence[str], row_id: str = "row_id", class_col: str = "label",
                      value: str = "w", binary: bool = False, group: Sequence[str] = (),
                      n_groups: int = 1) -> DataFrame:
    """(row_id, group..., keep..., dot_0 ... dot_{k-1}) = sum_f x_f * weights[group, j, f].

    ``binary``: the row's values count as 1 where present (Bernoulli events).
    ``group``: extra key columns shared by rows and weights (e.g. ``plan``);
    the weight table is then bounded by n_groups * k * n_features rows.
    """
    # the k weights of a bucket in one model row: the join keeps the feature side's number of rows
    values = [F.when(F.col(class_col) == F.lit(j), F.col(value)) for j in range(n_classes)]
    names = [f"_w{j}" for j in range(n_classes)]
    if n_groups * n_classes * n_features * MODEL_ROW_BYTES <= MAX_BROADCAST_BYTES:
        joined = join_packed(long_rows, weights, group, values, names)
    else:
        per_bucket = weights.groupBy(*group, "bucket").agg(*[F.max(v).alias(n) for v, n in zip(values, names)])
        joined = long_rows.join(per_bucket, [*group, "bucket"], "left")
    sums = [
        F.coalesce(F.sum(F.col(f"_w{j}") if binary else F.col("x") * F.col(f"_w{j}")), F.lit(0.0)).alias(f"_dot{j}")
        for j in range(n_classes)
    ]
    # keep columns are functions of the row: carried, not hashed into the exchange key
    carried = [F.first(c).alias(c) for c in keep]
    return joined.groupBy(row_id, *group).agg(*carried, *sums)


def dots_array(n_classes: int) -> Column:
    return F.array(*[F.col(f"_dot{j}") for j in range(n_classes)])


def drop_dots(df: DataFrame, n_classes: int) -> DataFrame:
    return df.drop(*[f"_dot{j}" for j in range(n_classes)])


def argmax(scores: Column) -> Column:
    """Index of the largest score; ties go to the lowest index."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmin(scores: Column) -> Column:
    """Index of the smallest score; ties go to the lowest index."""
    return (F.array_position(scores, F.array_min(scores)) - 1).cast("int")


def explode_scores(df: DataFrame, keep: Sequence[str], scores: str = "scores", class_col: str = "label",
                   value: str = "score", digits: int | None = 6) -> DataFrame:
    """Array of k scores -> one row per (row, class); a k-fold generator, no join."""
    out = df.select(*keep, F.posexplode(scores).alias("_pos", "_val"))
    val = F.round("_val", digits) if digits is not None else F.col("_val")
    return out.select(*keep, F.col("_pos").cast("int").alias(class_col), val.alias(value))
