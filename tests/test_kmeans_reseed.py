"""M8 with re-seeding: tiny clusters become rows of the batch, by a weighted race on MD5 numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchwise.operators.features import dense_rows
from batchwise.operators.kmeans import KMeansState, inertia, kmeans_assign, kmeans_init_first, kmeans_update, \
    tiny_clusters
from batchwise.plans.tasks import Schedule, language_task, schedule_table, scheduled_emails
from batchwise.session import scratch_path
from batchwise.sources.tables import email_rows
from batchwise.sources.wire import encode_wire_lines
from batchwise.streaming.learner import KMEANS, StreamLearner
from tests.conftest import SF_SMALL


def _u(salt, i, seed=42):
    return (int(hashlib.md5(f"{seed}|{salt}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52


def test_tiny_clusters_smallest_first_and_half_a_batch():
    assert tiny_clusters([100.0, 1.0, 0.0, 9.0, 1.0], 0.05, 100) == [2, 1, 4]
    assert tiny_clusters([100.0, 1.0, 0.0, 9.0, 1.0], 0.05, 4) == [2, 1]
    assert tiny_clusters([100.0, 1.0], 0.0, 100) == [] and tiny_clusters([0.0, 0.0], 0.5, 9) == []


def _brute(x, c, n, ratio, step):
    d2 = np.round(((x[:, None] - c[None]) ** 2).sum(2), 9)
    own = d2.argmin(1)
    m = np.bincount(own, minlength=len(c))
    moved = np.array([(c[j] * n[j] + x[own == j].sum(0)) / (n[j] + m[j]) if m[j] else c[j] for j in range(len(c))])
    total = n + m
    tiny = [j for j in range(len(c)) if total[j] < ratio * total.max()]
    least = min(t for j, t in enumerate(total) if j not in tiny)
    near = d2.min(1)
    race = sorted((-math.log(_u(f"r{step}", i)) / near[i], i) for i in range(len(x)) if near[i] > 0)
    for j, (_, i) in zip(sorted(tiny, key=lambda j: (total[j], j))[:len(x) // 2], race):
        moved[j], total[j] = x[i], least
    return moved, total


def test_reseeding_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(40, 3)), 3) + 2
    c, n = np.array([[2.0, 2, 2], [50, 50, 50], [-40, 0, 0], [2.5, 2, 2]]), np.array([30.0, 1, 0, 25])
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, vec array<double>")
    rows = dense_rows(frame, "vec")
    centers = spark.createDataFrame([(j, f, float(c[j, f])) for j in range(4) for f in range(3)],
                                    "cluster int, bucket int, c double")
    state = KMeansState(centers, [float(v) for v in n], 4, 3)
    for step in (1, 2):
        state = kmeans_update(state, rows, reseed_ratio=0.2)
        c, n = _brute(x, c, n, 0.2, step)
        got = np.zeros((4, 3))
        for r in state.centers.collect():
            got[r["cluster"], r["bucket"]] = r["c"]
        assert np.allclose(got, c, atol=1e-9) and state.counts == [float(v) for v in n]
        assert not np.any(np.abs(got) > 20)     # the far centers are gone


def test_rows_on_their_centers_are_not_drawn(spark):
    frame = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "row_id long, vec array<double>")
    state = kmeans_init_first(dense_rows(frame, "vec"), 3, 2)
    new = kmeans_update(state, dense_rows(frame, "vec"), reseed_ratio=0.5)
    assert new.counts == [6.0, 0.0, 0.0]


def test_stream_and_replay_draw_the_same_rows(spark):
    schedule, size = Schedule(4, 3, 4), 20
    batched, classes = scheduled_emails(email_rows(spark, SF_SMALL), schedule)
    lines = encode_wire_lines(batched, line_size=size, ordinal="ord").cache()
    learner = StreamLearner(spark, scratch_path(spark, "stream-reseed"), classes, schedule, n_features=4096,
                            models=(KMEANS,), k=6, reseed_ratio=0.5)
    for b in (1, 2, 3):
        learner(lines.where(F.col("batch_no") == b).select("value"), b)
    stream = {r["batch_no"]: r["inertia"] for r in learner.cluster_report().collect()}
    # the replay, with the ids that rows have in the stream
    place = schedule_table(email_rows(spark, SF_SMALL), schedule).select(
        "row_id", F.pmod(F.col("ord") - 1, F.lit(50)).alias("at"))
    task = language_task(spark, SF_SMALL, schedule, n_features=4096)
    rows = task.rows.join(place, "row_id").withColumn(
        "row_id", F.floor(F.col("at") / size) * (1 << 20) + F.pmod("at", F.lit(size))).cache()
    plain, state = None, None
    for b in (1, 2, 3):
        batch = rows.where(F.col("batch_no") == b)
        state = state or kmeans_init_first(batch, 6, 4096)
        plain = kmeans_update(plain or state, batch)
        state = kmeans_update(state, batch, reseed_ratio=0.5)
        want = inertia(kmeans_assign(state, batch, ("batch_no", "sq_x"))).first()["inertia"]
        assert stream[b] == pytest.approx(want, abs=2e-6)
    assert state.counts != plain.counts     # some cluster was drawn anew
