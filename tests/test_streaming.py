"""The stream learner is replay-safe and order-free."""

import json

from pyspark.sql import functions as F

from batchwise.plans.tasks import Schedule, scheduled_emails
from batchwise.session import scratch_path
from batchwise.sources.tables import email_rows
from batchwise.sources.wire import encode_wire_lines
from batchwise.streaming.learner import StreamLearner
from tests.conftest import SF_SMALL


def _lines(spark):
    batched, classes = scheduled_emails(email_rows(spark, SF_SMALL), Schedule(4, 3, 4))
    return encode_wire_lines(batched, line_size=20, ordinal="ord").cache(), classes


def test_out_of_order_and_replayed_microbatches(spark):
    lines, classes = _lines(spark)
    learner = StreamLearner(spark, scratch_path(spark, "stream-test"), classes, Schedule(4, 3, 4))
    # micro-batches arrive as: batch 4, batch 2, batch 1, batch 3 (then batch 1 again)
    for b in (4, 2, 1, 3, 1):
        learner(lines.where(F.col("batch_no") == b).select("value"), b)
    prog = learner.progress()
    assert prog["batch_no"] == 4
    m = learner.metrics().collect()
    assert {r["model"] for r in m} == {"multinomial_nb", "bernoulli_nb", "linear_sgd"}
    assert all(r["batch_no"] == 4 for r in m) and len(m) == 3
    n_test = lines.where("batch_no = 4").count()
    assert all(r["tp"] + r["fp"] + r["fn"] + r["tn"] > 0 for r in m) and n_test > 0


def test_empty_microbatch_does_nothing(spark):
    lines, classes = _lines(spark)
    learner = StreamLearner(spark, scratch_path(spark, "stream-empty"), classes, Schedule(4, 3, 4))
    learner(lines.where(F.lit(False)).select("value"), 0)
    assert learner.progress() is None


def test_incomplete_batch_waits(spark):
    lines, classes = _lines(spark)
    learner = StreamLearner(spark, scratch_path(spark, "stream-wait"), classes, Schedule(4, 3, 4))
    first_line = lines.where("batch_no = 1 AND line_no = 0").select("value")
    learner(first_line, 0)
    n_lines = lines.where("batch_no = 1").count()
    if n_lines > 1:
        assert learner.progress() is None
    learner(lines.where("batch_no = 1").select("value"), 1)
    assert learner.progress()["batch_no"] == 1


def test_restarted_learner_resumes_from_tables(spark):
    lines, classes = _lines(spark)
    root = scratch_path(spark, "stream-restart")
    first = StreamLearner(spark, root, classes, Schedule(4, 3, 4))
    for b in (1, 2):
        first(lines.where(F.col("batch_no") == b).select("value"), b)
    assert first.progress()["batch_no"] == 2
    # a new driver process: only the tables under root survive
    second = StreamLearner(spark, root, classes, Schedule(4, 3, 4))
    for b in (3, 4):
        second(lines.where(F.col("batch_no") == b).select("value"), b)
    fresh = StreamLearner(spark, scratch_path(spark, "stream-once"), classes, Schedule(4, 3, 4))
    for b in (1, 2, 3, 4):
        fresh(lines.where(F.col("batch_no") == b).select("value"), b)
    cols = ["batch_no", "model", "tp", "fp", "fn", "tn"]
    assert sorted(map(tuple, second.metrics().select(*cols).collect())) == \
        sorted(map(tuple, fresh.metrics().select(*cols).collect()))


def test_processing_time_trigger_runs_the_file_stream(spark):
    from batchwise.streaming.learner import run_stream, write_stream_files

    lines, classes = _lines(spark)
    root = scratch_path(spark, "stream-trigger")
    write_stream_files(lines, f"{root}/in")
    learner = StreamLearner(spark, f"{root}/state", classes, Schedule(4, 3, 4))
    query = run_stream(spark, f"{root}/in", learner, f"{root}/checkpoint", trigger="1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert learner.progress()["batch_no"] == 4
    assert learner.metrics().count() == 3


def test_restart_completes_a_half_landed_batch(spark):
    lines, classes = _lines(spark)
    n_lines = lines.where("batch_no = 1").count()
    assert n_lines > 1
    root = scratch_path(spark, "stream-half")
    first = StreamLearner(spark, root, classes, Schedule(4, 3, 4))
    first(lines.where("batch_no = 1 AND line_no = 0").select("value"), 0)
    assert first.progress() is None
    # a new driver: line 0 is only known from the landing table
    second = StreamLearner(spark, root, classes, Schedule(4, 3, 4))
    second(lines.where("batch_no = 1 AND line_no > 0").select("value"), 1)
    assert second.progress()["batch_no"] == 1


# --------------------------------------------------------------------------- damaged, repeated and bare lines

def _records(b, j):
    words = "alpha beta gamma" if (b + j) % 2 else "delta beta omega"
    return {str(i): {"feature0": f"s{i}", "feature1": f"{words} w{i}", "feature2": "spam" if (b + j + i) % 2 else "ham"}
            for i in range(4)}


def _line(b, j, n=2, **changed):
    return json.dumps({"batch_no": b, "line_no": j, "n_lines": n, "records": _records(b, j)} | changed)


def _frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def _learner(spark, name, **kw):
    kw = {"models": ("multinomial_nb",), "schedule": Schedule(4, 3, 4), "n_features": 4096} | kw
    return StreamLearner(spark, scratch_path(spark, name), ["ham", "spam"], **kw)


def _log(learner):
    return [tuple(r) for r in learner.batch_log().orderBy("batch_no").collect()]


def test_truncated_line_is_quarantined_and_its_batch_completes(spark):
    learner = _learner(spark, "stream-cut")
    for b in (1, 2, 3, 4):      # two lines per micro-batch, the second of batch 2 cut short
        second = _line(b, 1)
        learner(_frame(spark, _line(b, 0), second[:70] if b == 2 else second), b)
    assert _log(learner) == [(1, 2, 0, 8, 0), (2, 2, 1, 4, 0), (3, 2, 0, 8, 0), (4, 2, 0, 8, 0)]
    assert [(r["batch_no"], r["line_no"], r["problem"]) for r in learner.quarantined().collect()] == [
        (2, 1, "bad records")]
    assert [r["batch_no"] for r in learner.metrics().collect()] == [4]
    assert learner.waiting() == {}


def test_line_without_records_completes_its_batch(spark):
    learner = _learner(spark, "stream-norecords")
    learner(_frame(spark, _line(1, 0, 1, records={})), 0)
    learner(_frame(spark, _line(2, 0, 1)), 1)
    assert _log(learner) == [(1, 1, 0, 0, 0), (2, 1, 0, 4, 0)]
    assert learner.progress()["nb_version"] == 2


def test_line_without_n_lines_is_bad_and_counts(spark):
    learner = _learner(spark, "stream-nolines")
    learner(_frame(spark, _line(1, 0, None), _line(1, 1, 2)), 0)
    assert _log(learner) == [(1, 2, 1, 4, 0)]
    assert [r["problem"] for r in learner.quarantined().collect()] == ["bad envelope"]


def test_line_sent_again_counts_once_and_the_good_copy_wins(spark):
    learner = _learner(spark, "stream-again")
    learner(_frame(spark, _line(1, 0)[:70], _line(1, 0)[:70]), 0)
    learner(_frame(spark, _line(1, 0), _line(1, 0)), 1)
    assert learner.progress() is None
    learner(_frame(spark, _line(1, 1)), 2)
    rows = learner._p("nb", "v=1", "docs")
    assert spark.read.parquet(rows).agg(F.sum("n_docs")).first()[0] == 8


def test_line_for_a_learned_batch_is_late(spark):
    learner = _learner(spark, "stream-late")
    learner(_frame(spark, _line(1, 0, 1)), 0)
    learner(_frame(spark, _line(1, 0, 1)), 0)       # the same micro-batch again is a replay
    assert learner.quarantined().count() == 0
    learner(_frame(spark, _line(1, 0, 1), _line(2, 0, 1)), 1)
    assert [(r["batch_no"], r["problem"]) for r in learner.quarantined().collect()] == [(1, "late")]
    assert learner.progress()["batch_no"] == 2


def test_gaps_close_only_when_unnamed_lines_account_for_them(spark):
    learner = _learner(spark, "stream-gaps")
    learner(_frame(spark, _line(1, 0), "garbage"), 0)
    learner(_frame(spark, _line(2, 0), _line(2, 1)), 1)
    learner(_frame(spark, _line(3, 0)), 2)
    assert learner.progress() is None and sorted(learner.waiting()) == [1, 2, 3]
    # a restarted driver finds the same, and batch 3 keeps waiting for its second line
    again = StreamLearner(spark, learner.root, learner.classes, learner.schedule, learner.n_features, learner.models)
    assert again.close_gaps() == 2
    assert _log(again) == [(1, 1, 0, 4, 1), (2, 2, 0, 8, 0)]
    assert sorted(again.waiting()) == [3]
    assert again.close_gaps() == 0


def test_bare_lines_are_batches_by_arrival(spark):
    learner = _learner(spark, "stream-bare", wire="bare", schedule=Schedule(n_train=1, n_total=2))
    bare = [json.dumps(_records(b, 0)) for b in range(4)]
    learner(_frame(spark, bare[0]), 0)
    learner(_frame(spark, "{oops", *bare[1:3]).coalesce(1), 1)
    learner(_frame(spark, "{oops", *bare[1:3]).coalesce(1), 1)      # replayed: the same numbers again
    learner(_frame(spark, bare[3]), 2)
    assert _log(learner) == [(1, 1, 0, 4, 0), (2, 1, 1, 0, 0), (3, 1, 0, 4, 0), (4, 1, 0, 4, 0), (5, 1, 0, 4, 0)]
    assert [r["batch_no"] for r in learner.quarantined().collect()] == [2]
    assert {(r["cycle"], r["batch_no"]) for r in learner.metrics().collect()} == {(2, 4)}


def test_superseded_tables_and_cached_blocks_go(spark):
    import os

    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    learner = _learner(spark, "stream-clean", models=("multinomial_nb", "linear_sgd", "kmeans"))
    for b in (1, 2):
        learner(_frame(spark, _line(b, 0, 1)), b)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    local = learner.root.removeprefix("file:")
    for name in ("nb", "linear", "kmeans"):
        assert os.listdir(f"{local}/{name}") == ["v=2"]
    assert os.listdir(f"{local}/rows") == [] and os.listdir(f"{local}/landing") == []


def test_fewer_rows_than_clusters(spark):
    from batchwise.operators.features import dense_rows
    from batchwise.operators.kmeans import kmeans_init_first, kmeans_init_plusplus, kmeans_update

    raw = spark.createDataFrame([(1, [0.0, 3.0]), (2, [3.0, 0.0])], "row_id long, vec array<double>")
    rows = dense_rows(raw, "vec")
    for state in (kmeans_init_first(rows, 4, 2), kmeans_init_plusplus(rows, 4, 2)):
        assert state.k == 2
        assert kmeans_update(state, rows).counts == [1.0, 1.0]


def test_waiting_batches_are_learned_together_and_equal_one_by_one(spark, monkeypatch):
    """Naive Bayes over cycles: all batches in one micro-batch, in two with a cycle cut through, or one at a time."""
    batched, classes = scheduled_emails(email_rows(spark, SF_SMALL), Schedule(9, 2, 3))
    lines = encode_wire_lines(batched, line_size=20, ordinal="ord").cache()
    runs = []
    own = StreamLearner._learn_run
    monkeypatch.setattr(StreamLearner, "_learn_run", lambda self, run, *more: (runs.append(len(run)), own(self, run, *more))[1])

    def learned(parts):
        learner = StreamLearner(spark, scratch_path(spark, "t-runs"), classes, Schedule(9, 2, 3), models=("multinomial_nb", "bernoulli_nb"))
        for i, where in enumerate(parts):
            learner(lines.where(where).select("value"), i)
        again = StreamLearner(spark, learner.root, classes, Schedule(9, 2, 3), models=learner.models)
        assert again.progress()["nb_version"] == 8 and again.progress()["batch_no"] == 9
        stats = again._nb_state(8).stats.select("label", "bucket", F.round("sum_x", 9), "n_present")
        return [sorted(map(tuple, df.collect())) for df in (again.metrics(), again.batch_log(), stats)]

    one_by_one = learned([f"batch_no = {b}" for b in range(1, 10)])
    assert runs == [] and len(one_by_one[1]) == 9 and len(one_by_one[0]) == 6
    assert learned(["true"]) == one_by_one and runs == [9]
    assert learned(["batch_no <= 4", "batch_no > 4"]) == one_by_one and runs == [9, 4, 5]
