"""Scores by the file sink: equal to the replay, over restarts, a replayed micro-batch, repeated and damaged lines."""

import glob

from pyspark.sql import functions as F

from batchwise.plans.classify import classifier_predictions, linear_replay, model_versions, nb_predictions
from batchwise.plans.tasks import Schedule, language_task, scheduled_emails
from batchwise.session import scratch_path
from batchwise.sources.batches import batch_size_for
from batchwise.sources.tables import email_rows
from batchwise.sources.wire import encode_wire_lines
from batchwise.store import drop_path, materialize
from batchwise.streaming.learner import read_stream
from batchwise.streaming.scores import publish, read_scores, run_scores, scored
from tests.conftest import SF_SMALL

SCHEDULE = Schedule(4, 1, 2)
COLUMNS = ("ord", "model", "actual", "predicted")


def test_stream_scores_equal_the_replay(spark):
    prep = language_task(spark, SF_SMALL, SCHEDULE)
    root = scratch_path(spark, "t-scores")
    versions = dict(model_versions(prep))
    assert sorted(versions) == [1, 2]
    publish(spark, f"{root}/models", 1, versions[1], 2)
    emails = email_rows(spark, SF_SMALL)
    lines = materialize(encode_wire_lines(scheduled_emails(emails, SCHEDULE)[0], line_size=10), "t-score-lines")
    n_rows = emails.count()
    size = batch_size_for(n_rows, 4)

    def run():
        run_scores(read_stream(spark, f"{root}/in", 1), f"{root}/models", prep.classes, f"{root}/out",
                   f"{root}/checkpoint", SCHEDULE)
        return read_scores(spark, f"{root}/out")

    def put(name, df):
        df.select("value").coalesce(1).write.text(f"{root}/in/{name}")

    put("a", lines.where("batch_no <= 2"))
    put("bad", spark.createDataFrame([("{damaged",), ("",)], "value string"))
    assert run().select("version").distinct().collect() == [(1,)]
    publish(spark, f"{root}/models", 2, versions[2], 2)
    put("c", lines.where("batch_no = 2 or batch_no = 4"))       # batch 2 for the second time
    put("d", lines.limit(0))
    got = run()
    place = ((F.col("batch_no") - 1) * size + F.col("line_no") * 10 + F.col("pos") + 1).alias("ord")
    bag = sorted(map(tuple, got.select(place, *COLUMNS[1:]).collect()))
    rows = prep.rows.select("row_id", "batch_no")
    ids = {r["row_id"]: i for i, r in enumerate(rows.orderBy("row_id").collect(), 1)}
    want = nb_predictions(prep, tuple(m for m in versions[1] if m != "linear_sgd"))
    want = want.select("row_id", *COLUMNS[1:]).unionByName(linear_replay(prep)[1].select("row_id", *COLUMNS[1:]))
    assert bag == sorted((ids[r["row_id"]], *r[1:]) for r in want.collect())
    assert len(bag) == 3 * prep.test_rows().count()

    # the last micro-batches run again, as after a driver lost between the sink's log and the checkpoint's
    kept = sorted(glob.glob(f"{root.removeprefix('file:')}/checkpoint/commits/[0-9]*"), key=lambda p: int(p.split("/")[-1]))
    assert len(kept) >= 3
    drop_path(spark, kept[-1])
    assert sorted(map(tuple, run().select(place, *COLUMNS[1:]).collect())) == bag
    assert sorted(map(tuple, run().select(place, *COLUMNS[1:]).collect())) == bag


def test_batch_form_and_unpublished_versions(spark):
    prep = language_task(spark, SF_SMALL, SCHEDULE)
    root = scratch_path(spark, "t-scores-batch")
    for version, models in model_versions(prep):
        if version == 1:
            publish(spark, root, version, models, 2)
            publish(spark, root, version, models, 2)            # once more: the same version
    lines = encode_wire_lines(scheduled_emails(email_rows(spark, SF_SMALL), SCHEDULE)[0], line_size=10)
    strange = spark.createDataFrame([(
        '{"batch_no":2,"line_no":900,"n_lines":901,"records":{"0":{"feature0":null,"feature1":"","feature2":"new"}}}',)],
        "value string")
    got = scored(lines.select("value").unionByName(strange), root, prep.classes, SCHEDULE)
    by_version = {r[0]: r[1:] for r in got.groupBy("version").agg(
        F.count(F.lit(1)), F.count("predicted"), F.count("scores")).collect()}
    n1, n2 = (prep.test_rows().where(F.col("cycle") == c).count() for c in (1, 2))
    assert by_version == {1: (3 * n1 + 3,) * 3, 2: (3 * n2, 0, 0)}   # kept, without scores
    empty = got.where("line_no = 900").collect()
    assert len(empty) == 3 and all(r["actual"] is None and r["predicted"] in (0, 1) for r in empty)
    nothing = scored(lines.limit(0), root, prep.classes, SCHEDULE)
    assert nothing.count() == 0 and nothing.columns == got.columns


def test_versions_know_what_the_replay_knows(spark):
    prep = language_task(spark, SF_SMALL, Schedule(4, 3, 4))
    (version, models), = model_versions(prep)
    assert version == 1 and sorted(models) == ["bernoulli_nb", "linear_sgd", "multinomial_nb"]
    state, _ = linear_replay(prep)
    assert models["linear_sgd"].a == [0.0, state.bias]
    assert classifier_predictions(prep).select("model").distinct().count() == 3


def test_large_weights_are_not_broadcast(spark):
    prep = language_task(spark, SF_SMALL, SCHEDULE)
    root = scratch_path(spark, "t-scores-large")
    for version, models in model_versions(prep):
        publish(spark, root, version, models, 2)
    lines = encode_wire_lines(scheduled_emails(email_rows(spark, SF_SMALL), SCHEDULE)[0], line_size=10).select("value")
    small, large = (scored(lines, root, prep.classes, SCHEDULE, limit=limit) for limit in (1 << 20 << 10, 0))
    hints = [df._jdf.queryExecution().analyzed().toString().count("strategy=broadcast") for df in (small, large)]
    assert hints[0] == hints[1] + 1
    columns = ("batch_no", "line_no", "pos", "model", "predicted")
    assert sorted(map(tuple, small.select(*columns).collect())) == sorted(map(tuple, large.select(*columns).collect()))
