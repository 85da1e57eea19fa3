"""Confusion counts, metrics and their series.

Predictions are rows ``(..by.., actual, predicted)``.  Everything is one
group-by (partial aggregation first), so the data volume behind a metric row
never matters.  Precision and recall treat class ``positive`` as positive; a
zero denominator gives 0.0.  Values are rounded to 6 digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall")
DIGITS = 6


def confusion(pred: DataFrame, by: Sequence[str] = ("batch_no", "model"), actual: str = "actual",
              predicted: str = "predicted") -> DataFrame:
    """Counts per (by..., actual, predicted)."""
    return pred.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def dense_confusion(pred: DataFrame, n_classes: int, by: Sequence[str] = ("batch_no", "model"), actual: str = "actual",
                    predicted: str = "predicted") -> DataFrame:
    """E1, the whole matrix: a count for every pair of classes of every group, zeros included.

    The cells are columns of one aggregate and a generator makes them rows: no join.
    """
    cells = [(i, j) for i in range(n_classes) for j in range(n_classes)]
    counts = pred.groupBy(*by).agg(*[
        F.count(F.when((F.col(actual) == i) & (F.col(predicted) == j), 1)).alias(f"_{i}_{j}") for i, j in cells])
    matrix = F.array(*[F.struct(F.lit(i).alias("actual"), F.lit(j).alias("predicted"), F.col(f"_{i}_{j}").alias("n"))
                       for i, j in cells])
    return counts.select(*by, F.explode(matrix).alias("_c")).select(*by, "_c.*")


def _ratio(num, den):
    return F.when(den > 0, F.round(num.cast("double") / den, DIGITS)).otherwise(F.lit(0.0))


def binary_metrics(pred: DataFrame, by: Sequence[str] = ("batch_no", "model"), actual: str = "actual",
                   predicted: str = "predicted", positive: int = 1) -> DataFrame:
    """Tp, fp, fn, tn, accuracy, precision, recall per group."""
    a = F.col(actual) == F.lit(positive)
    p = F.col(predicted) == F.lit(positive)
    counts = pred.groupBy(*by).agg(
        F.sum((a & p).cast("long")).alias("tp"),
        F.sum((~a & p).cast("long")).alias("fp"),
        F.sum((a & ~p).cast("long")).alias("fn"),
        F.sum((~a & ~p).cast("long")).alias("tn"),
    )
    return metrics_from_counts(counts)


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """Metrics from (tp, fp, fn, tn) columns (e.g. a golden confusion table)."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.withColumns({
        "accuracy": _ratio(F.col("tp") + F.col("tn"), n),
        "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")),
    })


def counts_from_confusion(conf: DataFrame, by: Sequence[str] = ("batch_no", "model"), positive: int = 1) -> DataFrame:
    """E1 -> (tp, fp, fn, tn) per group, from long confusion rows (actual, predicted, n)."""
    a = F.col("actual") == F.lit(positive)
    p = F.col("predicted") == F.lit(positive)
    return conf.groupBy(*by).agg(
        F.sum(F.when(a & p, F.col("n")).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(~a & p, F.col("n")).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(a & ~p, F.col("n")).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.when(~a & ~p, F.col("n")).otherwise(0)).cast("long").alias("tn"),
    )


def multiclass_accuracy(pred: DataFrame, by: Sequence[str] = ("batch_no", "model"), actual: str = "actual",
                        predicted: str = "predicted") -> DataFrame:
    """Share correct per group, for k > 2 classes."""
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col(actual) == F.col(predicted)).cast("double")), DIGITS).alias("accuracy"))


def metric_history(metrics: DataFrame, series: Sequence[str] = ("cycle", "model"),
                   order: str = "batch_no") -> DataFrame:
    """Long series (series..., metric, idx, value), idx = 1, 2, ... per series.

    The window is partitioned by (series, metric): each partition is one
    metric list (one value per test batch), never the whole table.
    """
    long = metrics.unpivot([*series, order], list(METRICS), "metric", "value")
    w = Window.partitionBy(*series, "metric").orderBy(order)
    return long.withColumn("idx", F.row_number().over(w).cast("int"))


def compare_models(metrics: DataFrame, models: Sequence[str], metric: str = "accuracy",
                   keys: Sequence[str] = ("cycle", "batch_no")) -> DataFrame:
    """One column per model for one metric (pivot values given: no extra job)."""
    return metrics.groupBy(*keys).pivot("model", list(models)).agg(F.first(metric))


def summary(metrics: DataFrame, by: Sequence[str] = ("cycle", "model")) -> DataFrame:
    """Mean / min / max of each metric per model over the test batches."""
    aggs = []
    for m in METRICS:
        aggs += [F.round(F.avg(m), DIGITS).alias(f"{m}_mean"), F.min(m).alias(f"{m}_min"),
                 F.max(m).alias(f"{m}_max")]
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_batches"), *aggs)
