"""S2 in event time: the stream cut into slices of 5 s by when its lines were sent.

The interval of a processing-time trigger depends on the machine; a slice by the
sender's clock does not.  A *stamped* line is a wire line whose envelope also names
``sent_at``; a *heartbeat* names nothing else and only moves the clock on.

``slices`` counts the lines and records of each slice.  A slice is closed, and its
row written once by the file sink, when the watermark (the latest ``sent_at`` seen less
``delay``) has passed its end.  Until then its lines are keys in the state store, so
a line that arrives twice counts once.  A line that comes after its slice was closed is
late: the slice stays as it was.  ``line_log``, a stream without state, keeps a narrow
row for every stamped line; ``with_late`` counts from it what each closed slice missed.
A line that is late and a copy of one counted in time is not missed.

Damaged lines that still name their time count as ``n_bad`` in the log's report; lines
without a readable time belong to no slice and are left to the quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import TRIGGER_INTERVAL
from ..sources.wire import line_table

DEFAULT_DELAY = "2 seconds"
SLICES_SCHEMA = "slice_start timestamp, slice_end timestamp, n_lines long, n_records long, n_bad long"
LOG_SCHEMA = "sent_at timestamp, batch_no int, line_no int, n_records int, bad boolean, heartbeat boolean, id string"
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSX"


def _stamp(at: Column) -> Column:
    return F.concat(F.lit('{"sent_at":"'), F.date_format(at, STAMP), F.lit('"'))


def stamped(lines: DataFrame, sent_at: Column, value: str = "value") -> DataFrame:
    """Wire lines with the time they were sent at in front of their envelope (to the millisecond)."""
    return lines.withColumn(value, F.concat(_stamp(sent_at), F.lit(","), F.expr(f"substring({value}, 2)")))


def heartbeat(at: Column) -> Column:
    return F.concat(_stamp(at), F.lit(',"heartbeat":true}'))


def stamped_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Stamped lines in LOG_SCHEMA; ``id`` tells lines apart: batch and line, or the hash of a damaged line."""
    at = F.regexp_extract(value, r'^\{"sent_at":"([^"]*)"', 1)
    beat = F.col("value").rlike(r'^\{"sent_at":"[^"]*","heartbeat":true\}$')
    table = line_table(lines, value).withColumns({
        "sent_at": F.try_to_timestamp(at, F.lit(STAMP)), "heartbeat": beat,
        "bad": F.col("problem").isNotNull() & ~beat})
    whole = F.concat_ws("/", "batch_no", "line_no")
    return table.where(F.col("sent_at").isNotNull()).select(
        "sent_at", "batch_no", "line_no",
        F.when(F.col("records").isNull(), F.lit(0)).otherwise(F.size("records")).alias("n_records"), "bad", "heartbeat",
        F.when(F.col("problem").isNull(), whole).otherwise(F.sha2("value", 256)).alias("id"))


def _per_line(log: DataFrame, interval: str) -> DataFrame:
    """One row per distinct line: (slice, id, n_records, good, bad)."""
    return log.groupBy(F.window("sent_at", interval).alias("slice"), "id").agg(
        F.max("n_records").alias("n_records"), F.max(~F.col("bad") & ~F.col("heartbeat")).alias("good"),
        F.max("bad").alias("bad"))


def slices(lines: DataFrame, interval: str = TRIGGER_INTERVAL, delay: str = DEFAULT_DELAY) -> DataFrame:
    """(slice_start, slice_end, n_lines, n_records, n_bad) of a batch or streaming DataFrame of stamped lines."""
    per_line = _per_line(stamped_lines(lines).withWatermark("sent_at", delay), interval)
    counts = per_line.groupBy(F.window(F.window_time("slice"), interval).alias("slice")).agg(
        F.count_if("good").alias("n_lines"), F.sum("n_records").cast("long").alias("n_records"),
        F.count_if("bad").alias("n_bad"))
    return counts.select(F.col("slice.start").alias("slice_start"), F.col("slice.end").alias("slice_end"), "n_lines",
                         "n_records", "n_bad")


def _drain(rows: DataFrame, out: str, checkpoint: str) -> None:
    rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start(out).awaitTermination()


def run_slices(lines: DataFrame, root: str, interval: str = TRIGGER_INTERVAL, delay: str = DEFAULT_DELAY) -> None:
    """Drains ``lines`` into the tables of closed slices and of lines under ``root``; a later call goes on."""
    _drain(slices(lines, interval, delay), f"{root}/slices", f"{root}/checkpoint-slices")
    _drain(stamped_lines(lines), f"{root}/lines", f"{root}/checkpoint-lines")


def closed_slices(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SLICES_SCHEMA).parquet(f"{root}/slices")


def line_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/lines")


def with_late(spark: SparkSession, root: str, interval: str = TRIGGER_INTERVAL,
              delay: str = DEFAULT_DELAY) -> DataFrame:
    """Every closed slice that had a line, in time or not, with the lines and records that came late.

    Batch only; what a slice missed is what the log holds of it beyond its counts.
    """
    log = line_log(spark, root)
    clock = log.agg((F.max("sent_at") - F.expr(f"interval {delay}")).alias("clock"))
    seen = _per_line(log, interval).groupBy("slice").agg(
        F.count_if("good").alias("all_lines"), F.sum("n_records").cast("long").alias("all_records"),
        F.count_if("bad").alias("all_bad"))
    # one value, the clock
    closed = seen.where((F.col("slice.end") <= clock.scalar()) & (F.col("all_lines") + F.col("all_bad") > 0)).select(
        F.col("slice.start").alias("slice_start"), "all_lines", "all_records", "all_bad")
    kept = closed_slices(spark, root).drop("slice_end")
    both = closed.join(kept, "slice_start", "left").fillna(0, ["n_lines", "n_records", "n_bad"])
    return both.select("slice_start", "n_lines", "n_records", "n_bad",
                       (F.col("all_lines") - F.col("n_lines")).alias("late_lines"),
                       (F.col("all_records") - F.col("n_records")).alias("late_records"),
                       (F.col("all_bad") - F.col("n_bad")).alias("late_bad"))
