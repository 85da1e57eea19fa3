"""M1 and M3 kept by the stream itself: naive Bayes counts in Spark's state store.

Training records of a stream of wire lines are cleaned, hashed and grouped by
(label, bucket); the sums are the query's state, versioned and restored by its
checkpoint.  A micro-batch emits only the keys it changed (update mode).  They are
written to the micro-batch's own folder, which a replayed micro-batch overwrites, so
the log holds each change once; ``latest`` is the newest value of each key, and
``compact`` folds the older folders into one.  Documents of a class are
counted under the bucket NO_BUCKET.

A line that arrives twice counts once: lines are deduplicated by (batch, line) in
the state store too.  Both states are bounded: k * n_features sums, and a few numbers
per line of at most ``line_size`` records.

With many keys use the RocksDB state store, which spills, and fix
``spark.sql.shuffle.partitions`` before the first start: a checkpoint keeps it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phases import TRAIN, phase
from ..functions.text import DEFAULT_N_FEATURES
from ..operators.features import encode_labels, hashed_rows
from ..operators.naive_bayes import NBState
from ..plans.tasks import Schedule, cleaned_emails
from ..sources.wire import explode_records, line_table
from ..store import drop_path, write_table

NO_BUCKET = -1
COUNTS_SCHEMA = "label int, bucket int, sum_x double, n_present long, micro_batch long"


def running_counts(lines: DataFrame, classes: Sequence[str], schedule: Schedule = Schedule(),
                   n_features: int = DEFAULT_N_FEATURES) -> DataFrame:
    """(label, bucket, sum_x, n_present) over all training records of ``lines``, a batch or streaming DataFrame."""
    whole = line_table(lines).where(F.col("problem").isNull()).dropDuplicates(["batch_no", "line_no"])
    train = explode_records(whole).where(phase("batch_no", schedule.n_train, schedule.n_total) == TRAIN)
    train = encode_labels(train, classes, "feature2", "label").withColumn("row_id", F.struct("batch_no", "line_no", "pos"))
    rows = hashed_rows(cleaned_emails(train), "text", ("label",), n_features=n_features)
    entries = F.concat(
        F.array(F.struct(F.lit(NO_BUCKET).alias("bucket"), F.lit(0.0).alias("x"))),
        F.transform("features", lambda f: F.struct(f["bucket"].alias("bucket"), (f["cnt"] / F.col("norm")).alias("x"))))
    return rows.select("label", "norm", F.explode(entries).alias("e")).groupBy("label", F.col("e.bucket").alias("bucket")).agg(
        F.sum("e.x").alias("sum_x"), F.count(F.lit(1)).alias("n_present"))


def _folder(path: str, micro_batch: int) -> str:
    return f"{path}/micro_batch={micro_batch}"


def run_counts(lines: DataFrame, classes: Sequence[str], path: str, checkpoint: str, schedule: Schedule = Schedule(),
               n_features: int = DEFAULT_N_FEATURES) -> None:
    """Drains the stream ``lines`` into the log of changes at ``path``; a later call goes on from the checkpoint."""
    counts = running_counts(lines, classes, schedule, n_features)

    def keep(changed: DataFrame, micro_batch: int) -> None:
        write_table(changed, _folder(path, micro_batch))

    query = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(
        availableNow=True).start()
    query.awaitTermination()


def newest_values(log: DataFrame) -> DataFrame:
    return log.groupBy("label", "bucket").agg(F.max_by(F.struct("sum_x", "n_present"), "micro_batch").alias("s")).select(
        "label", "bucket", "s.sum_x", "s.n_present")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest (label, bucket, sum_x, n_present) of each key in the log."""
    return newest_values(spark.read.schema(COUNTS_SCHEMA).parquet(path))


def compact(spark: SparkSession, path: str) -> None:
    """Folds all folders of a log but the newest, which a restart may replay, into the newest of them.

    For a stream that is not running.  The folded rows are first written to
    ``path``-folded, which stays, whole, if a later step fails.
    """
    folders = sorted(r[0] for r in spark.read.schema(COUNTS_SCHEMA).parquet(path).select("micro_batch").distinct().collect())
    if len(folders) < 3:
        return
    *older, target, newest = folders
    log = spark.read.schema(COUNTS_SCHEMA).parquet(path).where(F.col("micro_batch") < newest)
    write_table(newest_values(log), f"{path}-folded")
    write_table(spark.read.parquet(f"{path}-folded"), _folder(path, target))
    for micro_batch in older:
        drop_path(spark, _folder(path, micro_batch))
    drop_path(spark, f"{path}-folded")


def state_of(spark: SparkSession, path: str, n_classes: int, n_features: int = DEFAULT_N_FEATURES) -> NBState:
    """The state that ``mnb_predict`` and ``bnb_predict`` score with."""
    counts = latest(spark, path)
    return NBState(counts.where(F.col("bucket") != NO_BUCKET),
                   counts.where(F.col("bucket") == NO_BUCKET).select("label", F.col("n_present").alias("n_docs")),
                   n_classes, n_features)
