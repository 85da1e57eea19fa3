"""M5 by local passes and averaged weights, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchwise.fixed import INTERCEPT_DECAY
from batchwise.operators.features import dense_rows
from batchwise.operators.linear import linear_init
from batchwise.operators.linear_mixing import FIRST_STEP, linear_mix_update
from batchwise.plans.classify import linear_metrics
from batchwise.plans.tasks import language_task

LAM, NF = 0.01, 5


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = np.where(rng.random((60, NF)) < 0.4, np.round(rng.normal(size=(60, NF)), 3), 0.0)
    x[7] = 0.0
    y = (x @ rng.normal(size=NF) > 0).astype(int)
    # ids out of order, in several partitions
    ids = rng.permutation(60)
    frame = spark.createDataFrame([(int(i), [float(v) for v in x[i]], int(y[i])) for i in ids],
                                  "row_id long, vec array<double>, label int").repartition(5)
    rows = dense_rows(frame, "vec", ("label",)).withColumn("features", F.filter("features", lambda f: f["cnt"] != 0))
    return x, y, rows.cache()


def _brute(x, y, part_of, w, b, steps):
    parts = sorted(set(part_of.values()))
    new_w, new_b = np.zeros(NF), 0.0
    for p in parts:
        own = [i for i in range(len(x)) if part_of[i] == p]
        pw, pb = w.copy(), b
        for t, i in enumerate(own, 1):
            sign = 2 * y[i] - 1
            eta = 1 / (LAM * (1 / (LAM * FIRST_STEP) + steps + t))
            hit = sign * (pw @ x[i] + pb) < 1
            pw = pw * (1 - eta * LAM)
            if hit:
                pw = pw + eta * sign * x[i]
                pb += INTERCEPT_DECAY * eta * sign
        new_w += len(own) / len(x) * pw
        new_b += len(own) / len(x) * pb
    return new_w, new_b, steps + -(-len(x) // len(parts))


@pytest.mark.parametrize("part_rows", [1000, 20])
def test_passes_match_brute_force(spark, data, part_rows):
    x, y, rows = data
    n_parts = -(-60 // part_rows)
    part_of = {r[0]: r[1] for r in rows.select("row_id", F.pmod(F.xxhash64("row_id"), F.lit(n_parts))).collect()}
    state, w, b, steps = linear_init(spark, NF, LAM), np.zeros(NF), 0.0, 0
    for _ in range(2):
        state = linear_mix_update(state, rows, 60, part_rows=part_rows)
        w, b, steps = _brute(x, y, part_of, w, b, steps)
        got = np.zeros(NF)
        for r in state.weights.collect():
            got[r["bucket"]] = r["w"]
        assert np.allclose(got, w, atol=1e-9) and state.bias == pytest.approx(b) and state.steps == steps
    assert len(set(part_of.values())) == n_parts


def test_an_empty_batch_changes_nothing(spark, data):
    state = linear_init(spark, NF, LAM)
    assert linear_mix_update(state, data[2].where(F.lit(False)), 60) is state


def test_accuracy_is_above_one_step_a_batch(spark):
    got = linear_metrics(language_task(spark, "/root/testdata/sf0.1"), mixing=True).collect()
    print(got)
    assert len(got) == 2 and sum(r["accuracy"] for r in got) / 2 > 0.9884
