"""Slices in event time: late lines, lines sent twice, damaged lines, heartbeats, restarts."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from batchwise.session import scratch_path
from batchwise.streaming.learner import read_stream
from batchwise.streaming.slices import closed_slices, heartbeat, line_log, run_slices, slices, stamped, with_late

BASE = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp())
GOOD = '{"batch_no":%d,"line_no":%d,"n_lines":9,"records":{"0":{"feature0":"a","feature1":"b","feature2":"c"},' \
       '"1":{"feature0":"a","feature1":null,"feature2":"c"}}}'


def lines_of(spark, items):
    """(seconds since BASE, line); a line of None is a heartbeat, a time of None leaves the line unstamped."""
    df = spark.createDataFrame(items, "at double, value string").withColumn(
        "time", F.timestamp_millis((F.col("at") * 1000).cast("long") + BASE * 1000))
    raw = df.select("at", "time", "value", F.col("value").alias("raw"))
    marked = stamped(raw, F.col("time"))
    return marked.select(F.when(F.col("at").isNull(), F.col("raw")).when(F.col("raw").isNull(), heartbeat(F.col("time")))
                         .otherwise(F.col("value")).alias("value"))


def table(df):
    return sorted((int(r[0].timestamp()) - BASE, *r[1:]) for r in df.collect())


def test_slices_close_once_and_late_lines_are_counted(spark):
    root = scratch_path(spark, "t-slices")
    cut = (GOOD % (1, 7))[:60]
    parts = [
        [(0.0, GOOD % (1, 0)), (4.999, GOOD % (1, 1)), (5.0, GOOD % (1, 2)), (1.0, cut), (None, GOOD % (1, 8)), (None, "")],
        [(7.5, GOOD % (1, 3)), (3.0, GOOD % (1, 4)), (0.0, GOOD % (1, 0)), (0.0, GOOD % (1, 0))],  # clock at 3 s: in time
        [(4.0, GOOD % (1, 5)), (4.999, GOOD % (1, 1)), (2.0, cut[:50])],    # clock at 5.5 s: late, late copy, late and bad
        [(13.0, GOOD % (2, 0)), (5.0, GOOD % (1, 2))],                      # clock at 5.5 s still: the copy changes nothing
        [(100.0, None)],                                                    # a heartbeat closes what is open
    ]
    closed = []
    for i, part in enumerate(parts):
        lines_of(spark, part).coalesce(1).write.text(f"{root}/in/{i}")
        run_slices(read_stream(spark, f"{root}/in", None), root)
        closed.append(table(closed_slices(spark, root).drop("slice_end")))
    first, second, third = (0, 3, 6, 1), (5, 2, 4, 0), (10, 1, 2, 0)
    assert closed == [[], [first], [first], [first, second], [first, second, third]]
    assert table(with_late(spark, root)) == [(*first, 1, 2, 1), (*second, 0, 0, 0), (*third, 0, 0, 0)]
    # nothing new: nothing changes
    run_slices(read_stream(spark, f"{root}/in", None), root)
    assert table(closed_slices(spark, root).drop("slice_end")) == closed[-1]
    assert line_log(spark, root).count() == 14


def test_a_slice_of_late_lines_only(spark):
    root = scratch_path(spark, "t-slices-late")
    for i, part in enumerate(([(50.0, GOOD % (1, 0))], [(1.0, GOOD % (1, 1)), (46.0, GOOD % (1, 2))], [(99.0, None)])):
        lines_of(spark, part).coalesce(1).write.text(f"{root}/in/{i}")
        run_slices(read_stream(spark, f"{root}/in", None), root)
    assert table(with_late(spark, root)) == [(0, 0, 0, 0, 1, 2, 0), (45, 1, 2, 0, 0, 0, 0), (50, 1, 2, 0, 0, 0, 0)]


def test_batch_form_and_empty_input(spark):
    rows = lines_of(spark, [(0.0, GOOD % (1, 0)), (0.0, GOOD % (1, 0)), (61.0, GOOD % (1, 1)), (None, "no line")])
    assert table(slices(rows, "1 minute").drop("slice_end")) == [(0, 1, 2, 0), (60, 1, 2, 0)]
    assert slices(rows.limit(0)).count() == 0
