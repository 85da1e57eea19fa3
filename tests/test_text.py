"""T1-T7 on hand fixtures (FIXTURES.md §2) and parity facts (§5)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from batchwise.fixed import ENGLISH_STOPWORDS, NOISE_SYMBOLS
from batchwise.functions.stopwords import stopword_set
from batchwise.functions.text import bucket_of, concat_text, strip_noise_tokens, tokenize

STOP = stopword_set(words=["the", "is", "at"])


@pytest.mark.parametrize("text,expected", [
    ("The offer is free !", "offer free"),
    ("free! the (deal)", "free! (deal)"),
    ("5 pm 10 am", "pm 10 am"),
    ("AT Noon", "Noon"),
    ("a + b", "a + b"),
    ("x \t\n  y", "x y"),
    ("the ! 7", ""),
    (None, ""),
])
def test_strip_noise_tokens(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(strip_noise_tokens("t", STOP).alias("c")).first()["c"] == expected


def test_symbol_list_is_fixed():
    assert len(NOISE_SYMBOLS) == 38
    assert "+" not in NOISE_SYMBOLS and "=" not in NOISE_SYMBOLS
    assert sum(s.isdigit() for s in NOISE_SYMBOLS) == 10


def test_default_stopwords_come_from_spark():
    words = ENGLISH_STOPWORDS
    assert "the" in words and "and" in words and len(words) > 100
    full = stopword_set()
    assert set(NOISE_SYMBOLS) <= set(full)


def test_concat_order_and_nulls(spark):
    df = spark.createDataFrame([("s", "b"), (None, "b"), ("s", None)], "a string, b string")
    got = [r[0] for r in df.select(concat_text("a", "b")).collect()]
    assert got == ["s b", " b", "s "]


def test_tokenize_runs_of_two(spark):
    df = spark.createDataFrame([("Héllo, a wörld_x 12 b3 !!",)], "t string")
    assert df.select(tokenize("t").alias("k")).first()["k"] == ["héllo", "wörld_x", "12", "b3"]


def test_md5_bucket_matches_python(spark):
    words = ["meeting", "spam", "héllo", "x1"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(bucket_of(F.col("w"), 1 << 20)).collect()]
    want = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (1 << 20) for w in words]
    assert got == want


def test_hashed_rows_counts_and_norm(spark):
    from batchwise.operators.features import hashed_rows, long_features

    df = spark.createDataFrame([(1, "aa bb aa"), (2, ""), (3, None)], "row_id long, text string")
    rows = hashed_rows(df, "text", n_features=1 << 20)
    got = {r["row_id"]: r for r in rows.collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["nnz"] == 2
    assert abs(got[1]["norm"] - 5 ** 0.5) < 1e-12
    assert got[2]["nnz"] == 0 and got[3]["nnz"] == 0 and got[2]["sum_x"] == 0.0
    lf = {(r["row_id"], r["bucket"]): r["x"] for r in long_features(rows).collect()}
    # rows without tokens keep one line with a null bucket
    assert (2, None) in lf and (3, None) in lf
    xs = sorted(v for (rid, b), v in lf.items() if rid == 1)
    assert abs(xs[0] - 1 / 5 ** 0.5) < 1e-12 and abs(xs[1] - 2 / 5 ** 0.5) < 1e-12


def test_no_python_udf_in_text_path(spark):
    from batchwise.functions.text import clean_columns

    df = spark.createDataFrame([("a b", "c d", "x")], "feature0 string, feature1 string, feature2 string")
    plan = clean_columns(df)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
