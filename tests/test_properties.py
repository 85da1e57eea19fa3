"""Property tests: the Spark expressions for T1 and T5 agree with their plain
Python statements on random text (letters incl. accents, digits, marks,
several kinds of white space incl. no-break and em spaces)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from batchwise.functions.stopwords import stopword_set
from batchwise.functions.text import strip_noise_tokens, tokenize

STOP = stopword_set(words=["the", "is", "at", "a", "free"])
ALPHABET = "abcXYZéÉüßø019_!?.,;:'\"-()#" + " \t\n\r\x0b\x0c\xa0\u2003\u2028"
WORD = re.compile(r"\w\w+")


def py_clean(s):
    return " ".join(w for w in s.split() if w.lower() not in STOP)


def py_tokens(s):
    return WORD.findall(s.lower())


texts = st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts)
def test_clean_matches_python_split_filter(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", strip_noise_tokens("t", STOP).alias("c")).collect()}
    assert [got[i] for i in range(len(batch))] == [py_clean(t) for t in batch]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts)
def test_tokenize_matches_python_word_runs(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = {r["i"]: r["k"] for r in df.select("i", tokenize("t").alias("k")).collect()}
    assert [list(got[i]) for i in range(len(batch))] == [py_tokens(t) for t in batch]


@st.composite
def count_matrices(draw):
    n_rows = draw(st.integers(4, 9))
    n_feat = draw(st.integers(2, 7))
    X = [[draw(st.integers(0, 3)) for _ in range(n_feat)] for _ in range(n_rows)]
    Y = [draw(st.integers(0, 1)) for _ in range(n_rows)]
    Y[0], Y[1] = 0, 1                       # both classes present
    return X, Y, n_feat


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(count_matrices())
def test_naive_bayes_scores_match_dense_brute_force(spark, data):
    import numpy as np
    from pyspark.sql import functions as F

    from batchwise.operators.features import dense_rows, long_features
    from batchwise.operators.naive_bayes import NBState, batch_statistics, bnb_predict, mnb_predict

    X, Y, nf = data
    X, Y = np.array(X, dtype=float), np.array(Y)
    df = spark.createDataFrame([(i, [float(v) for v in x], int(y)) for i, (x, y) in enumerate(zip(X, Y))],
                               "row_id long, vec array<double>, label int")
    rows = dense_rows(df, "vec", ("label",))
    rows = rows.withColumn("features", F.filter("features", lambda f: f["cnt"] != 0)).withColumn(
        "nnz", F.size("features").cast("long"))
    stats, docs = batch_statistics(long_features(rows, ("label",)), rows)
    state = NBState(stats, docs, 2, nf)
    keep = ("sum_x", "nnz")
    lf = long_features(rows, keep)
    mnb = {r["row_id"]: r["scores"] for r in mnb_predict(state, lf, keep).collect()}
    bnb = {r["row_id"]: r["scores"] for r in bnb_predict(state, lf, keep).collect()}
    prior = np.log(np.bincount(Y, minlength=2) / len(Y))
    fc = np.array([X[Y == c].sum(0) for c in range(2)]) + 1.0
    want_m = X @ np.log(fc / fc.sum(1, keepdims=True)).T + prior
    B = (X > 0).astype(float)
    dc = np.bincount(Y, minlength=2).astype(float)
    p = (np.array([B[Y == c].sum(0) for c in range(2)]) + 1.0) / (dc[:, None] + 2.0)
    want_b = B @ (np.log(p) - np.log(1 - p)).T + np.log(1 - p).sum(1) + prior
    for i in range(len(X)):
        assert np.allclose(mnb[i], want_m[i], atol=1e-9)
        assert np.allclose(bnb[i], want_b[i], atol=1e-9)
