"""E9 invariant: each plan of the one-job sweep equals a run at that schedule alone."""

from pyspark.sql import functions as F

from batchwise.plans.classify import MNB, classifier_predictions, nb_metrics
from batchwise.operators.evaluate import binary_metrics
from batchwise.plans.sweep import sweep_classifier_metrics, sweep_mnb_metrics
from batchwise.plans.tasks import Schedule, language_task
from batchwise.sources.tables import email_rows
from tests.conftest import SF_SMALL


def test_sweep_plan_equals_single_run(spark):
    plans = (("p4", 3, 4), ("p8", 6, 8))
    sweep = sweep_mnb_metrics(email_rows(spark, SF_SMALL), plans).cache()
    for name, n_train, n_total in plans:
        alone = nb_metrics(language_task(spark, SF_SMALL, Schedule(n_total, n_train, n_total)), MNB)
        cols = ["batch_no", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall"]
        a = sorted(tuple(r) for r in sweep.where(F.col("plan") == name).select(*cols).collect())
        b = sorted(tuple(r) for r in alone.select(*cols).collect())
        assert a == b and len(a) == n_total - n_train


def test_sweep_takes_the_batch_size_of_each_run(spark):
    emails = email_rows(spark, SF_SMALL)
    n_rows = emails.count()
    size = -(-n_rows // 4)
    # a size beyond the rows trains on its only batch and has nothing to report
    got = sweep_classifier_metrics(emails, [(size, 3, 4), (2 * n_rows, 1, 2)])
    alone = binary_metrics(classifier_predictions(language_task(spark, SF_SMALL, Schedule(4, 3, 4))),
                           by=("cycle", "batch_no", "model"))
    assert {r["batch_size"] for r in got.collect()} == {size}
    assert sorted(map(tuple, got.drop("batch_size").collect())) == sorted(map(tuple, alone.collect()))
    assert len(alone.collect()) == 3
