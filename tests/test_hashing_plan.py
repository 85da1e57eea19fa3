"""Hashing at scale: feature arrays are made after the last shuffle, tokens are made once, and a bucket
is the same whichever way its digits are read."""

import hashlib

import pytest
from pyspark.sql import functions as F

from batchwise.functions.text import bucket_of
from batchwise.plans import sweep
from batchwise.plans.tasks import prepare_email_task
from batchwise.queries import QUERIES
from tests.conftest import SF_SMALL


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.fixture
def emails(spark):
    return spark.createDataFrame([(i, "web", f"aa bb w{i} aa", "en" if i % 2 else "other") for i in range(16)],
                                 "row_id long, feature0 string, feature1 string, feature2 string")


def _below_exchange(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "regexp_extract_all" in plan
    return plan[plan.index("Exchange"):]


def test_row_table_is_hashed_above_the_shuffle(no_broadcast, emails):
    prep = prepare_email_task(emails, write=False)
    assert "regexp_extract_all" not in _below_exchange(prep.rows)
    got = prep.rows.orderBy("row_id").collect()
    assert [r["batch_no"] for r in got] == [i // 2 + 1 for i in range(16)]
    assert all(r["n_tokens"] == 5 and sorted(f["cnt"] for f in r["features"]) == [1, 1, 1, 2] for r in got)


def test_sweep_rows_are_hashed_above_the_shuffle(no_broadcast, emails, monkeypatch):
    monkeypatch.setattr(sweep, "materialize", lambda df, name: df)
    rows, _, n_rows = sweep._hashed_once(emails, 1 << 20)
    assert "regexp_extract_all" not in _below_exchange(rows)
    assert n_rows == 16 and [r["ord"] for r in rows.orderBy("row_id").collect()] == list(range(1, 17))


def test_count_vectors_splits_the_text_once(spark):
    plan = QUERIES["count_vectors"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan


@pytest.mark.parametrize("n_features", [1, 16, 1000, 4096, 1 << 18, 1 << 20, 1 << 28])
def test_bucket_is_the_remainder_of_the_first_digits(spark, n_features):
    words = ["aa", "bb", "été", "_x9", "w" * 300, ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["b"] for r in df.select("w", bucket_of(F.col("w"), n_features).alias("b")).collect()}
    assert got == {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % n_features for w in words}
