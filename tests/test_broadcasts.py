"""What the driver holds for a broadcast: one version or one group at a time, neighbouring buckets in one row."""

import re

import pytest
from pyspark.sql import functions as F

from batchwise.operators import kmeans
from batchwise.operators.joins import join_packed, packed_width
from batchwise.plans.cluster import kmeans_replay
from batchwise.plans.tasks import language_task
from batchwise.store import CLEANUP_KEY, materialize, write_table
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def run(spark):
    prep = language_task(spark, SF_SMALL)
    return prep, kmeans_replay(prep, k=2, with_silhouette=False)


def test_versions_of_long_models_are_broadcast_one_after_another(run):
    """2^20 buckets, k = 2: no plan holds the centers of several versions."""
    prep, replay = run
    assert "BroadcastExchange" not in _plan(replay.train)
    assert replay.train.count() == prep.train_rows().count()


def test_silhouettes_group_by_group_equal_all_at_once(run, monkeypatch):
    prep, replay = run
    assigned, rows = materialize(replay.train, "t-assigned"), prep.train_rows()
    written = []
    write = kmeans.materialize
    monkeypatch.setattr(kmeans, "materialize", lambda df, name, **kw: written.append(name) or write(df, name, **kw))

    def samples(limit):
        found = kmeans.silhouette_samples(assigned, rows, 2, prep.n_features, ("batch_no",), n_groups=6, limit=limit)
        return {r["row_id"]: r["s"] for r in found.collect()}

    whole = samples(1 << 30)
    assert "silhouette-dots" not in written and len(whole) == rows.count()
    single = samples(2 << 20)                      # one batch's sums fit, six do not
    assert written.count("silhouette-dots") == 6
    shuffled = samples(0)
    assert written.count("silhouette-dots") == 12
    for i, s in whole.items():
        assert single[i] == pytest.approx(s, abs=1e-12) and shuffled[i] == pytest.approx(s, abs=1e-12)


def test_packed_table_has_a_row_for_neighbouring_buckets(spark):
    table = spark.range(0, 1000, 3).select(F.col("id").cast("int").alias("bucket"), (F.col("id") * 2.0).alias("a"),
                                           (F.col("id") + 0.5).alias("b"))
    rows = spark.createDataFrame([(0, 0), (1, 1), (2, 999), (3, 2000), (4, None)], "row_id long, bucket int")
    joined = join_packed(rows, table, (), [F.col("a"), F.col("b")], ["va", "vb"])
    got = {r["row_id"]: (r["va"], r["vb"]) for r in joined.collect()}
    assert got == {0: (0.0, 0.5), 1: (None, None), 2: (1998.0, 999.5), 3: (None, None), 4: (None, None)}
    assert packed_width(2) == 16 and len(re.findall("BroadcastExchange", _plan(joined))) >= 1


def test_a_write_leaves_the_setting_of_the_session(spark, tmp_path):
    """Shuffles go with the write that made them; a collect keeps its own."""
    before = spark.conf.get(CLEANUP_KEY)
    seen = []
    session = type(spark.conf)
    put = session.set
    try:
        session.set = lambda self, key, value: seen.append((key, value)) or put(self, key, value)
        write_table(spark.range(100).groupBy(F.col("id") % 7).count(), str(tmp_path / "t"))
    finally:
        session.set = put
    assert seen == [(CLEANUP_KEY, "true"), (CLEANUP_KEY, before)] and spark.conf.get(CLEANUP_KEY) == before
