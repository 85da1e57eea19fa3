"""E1-E4, E7, E8, E10 against the published metric lists (golden confusion
matrices of FIXTURES.md §3, 500 rows per test batch, batches 61-66)."""

import pytest
from pyspark.sql import functions as F

from batchwise.operators.evaluate import (binary_metrics, compare_models, confusion, counts_from_confusion,
                                          metric_history, metrics_from_counts, summary)

# tp/fp/fn/tn per test batch 61..66
GOLDEN = {
    "multinomial_nb": [(276, 11, 0, 213), (234, 10, 0, 256), (246, 4, 0, 250), (276, 4, 0, 220), (272, 6, 0, 222),
                       (267, 8, 0, 225)],
    "linear_sgd": [(276, 0, 0, 224), (234, 0, 0, 266), (246, 0, 0, 254), (276, 0, 0, 224), (272, 2, 0, 226),
                   (267, 0, 0, 233)],
    "bernoulli_nb": [(276, 10, 0, 214), (234, 10, 0, 256), (246, 3, 0, 251), (276, 4, 0, 220), (272, 7, 0, 221),
                     (267, 9, 0, 224)],
    "kmeans": [(124, 13, 152, 211), (114, 13, 120, 253), (111, 5, 135, 249), (140, 6, 136, 218),
               (135, 8, 137, 220), (131, 9, 136, 224)],
}
# published lists (accuracy, precision, recall)
PUBLISHED = {
    "multinomial_nb": ([0.978, 0.98, 0.992, 0.992, 0.988, 0.984],
                       [0.9616724738675958, 0.9590163934426229, 0.984, 0.9857142857142858, 0.9784172661870504,
                        0.9709090909090909], [1.0] * 6),
    "linear_sgd": ([1.0, 1.0, 1.0, 1.0, 0.996, 1.0], [1.0, 1.0, 1.0, 1.0, 0.9927007299270073, 1.0], [1.0] * 6),
    "bernoulli_nb": ([0.98, 0.98, 0.994, 0.992, 0.986, 0.982],
                     [0.965034965034965, 0.9590163934426229, 0.9879518072289156, 0.9857142857142858,
                      0.974910394265233, 0.967391304347826], [1.0] * 6),
    "kmeans": ([0.67, 0.734, 0.72, 0.716, 0.71, 0.71],
               [0.9051094890510949, 0.8976377952755905, 0.9568965517241379, 0.958904109589041, 0.9440559440559441,
                0.9357142857142857],
               [0.4492753623188406, 0.48717948717948717, 0.45121951219512196, 0.5072463768115942,
                0.4963235294117647, 0.49063670411985016]),
}


@pytest.fixture(scope="module")
def predictions(spark):
    rows = []
    for model, cells in GOLDEN.items():
        for i, (tp, fp, fn, tn) in enumerate(cells):
            b = 61 + i
            for a, p, n in ((1, 1, tp), (0, 1, fp), (1, 0, fn), (0, 0, tn)):
                rows += [(1, b, model, a, p)] * n
    return spark.createDataFrame(rows, "cycle int, batch_no int, model string, actual int, predicted int")


@pytest.fixture(scope="module")
def metrics(predictions):
    return binary_metrics(predictions, by=("cycle", "batch_no", "model")).cache()


def test_metrics_reproduce_published_lists(metrics):
    for model, (acc, prec, rec) in PUBLISHED.items():
        got = metrics.where(F.col("model") == model).orderBy("batch_no").collect()
        assert [r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in got] == [500] * 6
        assert [r["accuracy"] for r in got] == pytest.approx(acc, abs=1e-6)
        assert [r["precision"] for r in got] == pytest.approx(prec, abs=1e-6)
        assert [r["recall"] for r in got] == pytest.approx(rec, abs=1e-6)


def test_confusion_roundtrip(predictions, metrics):
    conf = confusion(predictions, by=("cycle", "batch_no", "model"))
    again = metrics_from_counts(counts_from_confusion(conf, by=("cycle", "batch_no", "model")))
    a = sorted(tuple(r) for r in again.select("batch_no", "model", "accuracy", "precision", "recall").collect())
    b = sorted(tuple(r) for r in metrics.select("batch_no", "model", "accuracy", "precision", "recall").collect())
    assert a == b


def test_metric_history_series(metrics):
    hist = metric_history(metrics)
    got = hist.where("model = 'bernoulli_nb' AND metric = 'accuracy'").orderBy("idx").collect()
    assert [r["idx"] for r in got] == [1, 2, 3, 4, 5, 6]
    assert [r["value"] for r in got] == pytest.approx(PUBLISHED["bernoulli_nb"][0], abs=1e-6)


def test_compare_models_pivot(metrics):
    side = compare_models(metrics, ["multinomial_nb", "linear_sgd", "bernoulli_nb"]).orderBy("batch_no").collect()
    assert [r["linear_sgd"] for r in side] == pytest.approx(PUBLISHED["linear_sgd"][0], abs=1e-6)


def test_summary_means(metrics):
    got = {r["model"]: r for r in summary(metrics).collect()}
    assert got["multinomial_nb"]["accuracy_mean"] == pytest.approx(0.9857, abs=1e-4)
    assert got["linear_sgd"]["accuracy_mean"] == pytest.approx(0.9993, abs=1e-4)
    assert got["kmeans"]["recall_mean"] == pytest.approx(0.4803, abs=1e-4)
    assert got["kmeans"]["precision_min"] == pytest.approx(0.897638, abs=1e-6)
