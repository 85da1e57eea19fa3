"""Skew: a third of the rows are copies of one document from one source.
Work stays spread: the row table is partitioned by row id, so copies land in
many tasks, and the model side of scoring is broadcast (no shuffle on bucket)."""

from pyspark.sql import functions as F

from batchwise.operators.features import hashed_rows, long_features
from batchwise.operators.naive_bayes import NBState, batch_statistics, mnb_predict


def _skewed(spark, n=3000):
    base = spark.range(0, n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, F.lit("buy cheap pills now cheap cheap"))
        .otherwise(F.concat(F.lit("meeting notes item "), F.col("id").cast("string"), F.lit(" agenda")))
        .alias("text"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("label"))
    return base


def test_copies_spread_over_partitions(spark):
    rows = hashed_rows(_skewed(spark), "text", ("label",), n_features=1 << 12)
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000
    assert max(sizes) <= 2.5 * (sum(sizes) / len(sizes))


def test_hot_bucket_scoring_is_broadcast_and_correct(spark):
    rows = hashed_rows(_skewed(spark), "text", ("label",), n_features=1 << 12).cache()
    long = long_features(rows, ("label", "sum_x"))
    stats, docs = batch_statistics(long_features(rows, ("label",)), rows)
    state = NBState(stats, docs, 2, 1 << 12)
    pred = mnb_predict(state, long, ("label", "sum_x"))
    got = pred.select((F.col("predicted") == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got == 1.0
    plan = pred._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan or "BroadcastHashJoin" in plan
