"""Counts in Spark's state store: equal to the replay's state, over restarts, repeated and damaged lines."""

from pyspark.sql import functions as F

from batchwise.operators.naive_bayes import mnb_predict
from batchwise.plans.classify import nb_state_through
from batchwise.plans.tasks import SCORE_KEYS, Schedule, language_task, scheduled_emails
from batchwise.session import scratch_path
from batchwise.sources.tables import email_rows
from batchwise.sources.wire import encode_wire_lines
from batchwise.store import materialize
from batchwise.streaming.counts import compact, latest, run_counts, running_counts, state_of
from batchwise.streaming.learner import read_stream
from tests.conftest import SF_SMALL

SCHEDULE = Schedule(4, 3, 4)


def bag(df):
    return sorted((r["label"], r["bucket"], round(r["sum_x"], 6), r["n_present"]) for r in df.collect())


def test_state_store_counts_equal_the_replay_over_restarts(spark):
    batched, classes = scheduled_emails(email_rows(spark, SF_SMALL), SCHEDULE)
    lines = materialize(encode_wire_lines(batched, line_size=20, ordinal="ord"), "t-lines")
    prep = language_task(spark, SF_SMALL, SCHEDULE)
    want = nb_state_through(prep)
    root = scratch_path(spark, "t-counts")
    # each run takes new files; lines of batch 1 come twice, one line is damaged, one file is empty
    parts = [lines.where("batch_no = 3"), lines.where("batch_no = 1"), lines.where("batch_no = 1 or batch_no = 4"),
             lines.limit(0), lines.where("batch_no = 2")]
    for i, part in enumerate(parts):
        part.select("value").coalesce(1).write.text(f"{root}/in/{i}")
        if i == 1:
            spark.createDataFrame([("{damaged",)], "value string").coalesce(1).write.text(f"{root}/in/bad")
        run_counts(read_stream(spark, f"{root}/in", 1), classes, f"{root}/counts", f"{root}/checkpoint", SCHEDULE)
        if i == 2:
            compact(spark, f"{root}/counts")
    state = state_of(spark, f"{root}/counts", len(classes))
    assert bag(state.stats) == bag(want.stats)
    assert sorted(map(tuple, state.docs.collect())) == sorted(map(tuple, want.docs.collect()))
    # nothing new: the state is as it was, before and after the log is folded
    run_counts(read_stream(spark, f"{root}/in", 1), classes, f"{root}/counts", f"{root}/checkpoint", SCHEDULE)
    before = bag(latest(spark, f"{root}/counts"))
    compact(spark, f"{root}/counts")
    assert bag(latest(spark, f"{root}/counts")) == before
    log = spark.read.parquet(f"{root}/counts")
    assert log.select("micro_batch").distinct().count() == 2 and log.count() >= len(before)
    # the batch form of the same query
    assert bag(running_counts(lines, classes, SCHEDULE)) == before
    test = prep.test_rows()
    scored = [mnb_predict(s, prep.long(test, SCORE_KEYS), SCORE_KEYS).select("row_id", "predicted")
              for s in (state_of(spark, f"{root}/counts", len(classes)), want)]
    assert sorted(map(tuple, scored[0].collect())) == sorted(map(tuple, scored[1].collect()))


def test_replayed_micro_batch_overwrites_its_folder(spark):
    from batchwise.store import write_table
    from batchwise.streaming import counts

    root = scratch_path(spark, "t-replay")
    rows = spark.createDataFrame([(0, 5, 1.0, 1)], "label int, bucket int, sum_x double, n_present long")
    for _ in range(2):
        write_table(rows, counts._folder(root, 0))
    write_table(rows.withColumn("sum_x", F.lit(3.0)), counts._folder(root, 1))
    assert bag(latest(spark, root)) == [(0, 5, 3.0, 1)]
    assert spark.read.parquet(root).count() == 2
