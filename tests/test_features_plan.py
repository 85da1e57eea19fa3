"""Hashed features move no token: no exchange above the scan."""

from batchwise.operators.features import hashed_rows
from tests.conftest import SF_SMALL


def test_hashing_needs_no_shuffle(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumnRenamed("doc_id", "row_id")
    rows = hashed_rows(docs, "text", keep=("lang",))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_hashing_of_null_empty_and_repeated_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "aa bb aa aa")], "row_id long, text string")
    got = {r["row_id"]: r for r in hashed_rows(df, "text").collect()}
    assert [got[i]["nnz"] for i in (1, 2, 3)] == [0, 0, 2]
    assert [got[i]["n_tokens"] for i in (1, 2, 3)] == [0, 0, 4]
    assert sorted(f["cnt"] for f in got[3]["features"]) == [1, 3]
    assert [got[i]["sum_x"] for i in (1, 2)] == [0.0, 0.0]
