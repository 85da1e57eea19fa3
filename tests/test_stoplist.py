"""T1-T3 with the stop list as a table, against the literal list."""

import random

import pytest
from pyspark.sql import functions as F

from batchwise.functions.text import clean_columns
from batchwise.operators.stoplist import strip_listed_words

COLS = ("feature0", "feature1")


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120_000)]
    rows = [(i, " ".join(rng.choice(("The", "the", "to", *rng.sample(words, 3))) for _ in range(rng.randint(0, 60))),
             "\tthe  The\n" + rng.choice(words) + "  Straße ", i * 2) for i in range(300)]
    rows += [(300, None, None, 1), (301, "", "the THE the", 2), (302, "the " * 30_000 + "End", None, 3)]
    return spark.createDataFrame(rows, "row_id long, feature1 string, feature0 string, n int").cache(), words


@pytest.mark.parametrize("limit", [1 << 40, 0])
def test_a_hundred_thousand_words_equal_the_literal_list(spark, texts, limit):
    frame, words = texts
    stop = ["the", *words[:100_000], "straße"]
    listed = spark.createDataFrame([(w,) for w in [*stop, "THE", None, "the"]], "word string")
    got = strip_listed_words(frame, COLS, listed, limit=limit)
    assert got.columns == frame.columns
    want = clean_columns(frame, COLS, sorted(_used(frame) & set(stop)))     # the others drop nothing
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def _used(frame):
    return {w.lower() for r in frame.collect() for c in COLS for w in (r[c] or "").split()}


def test_an_unlisted_hot_word_is_not_shuffled_by_its_value(spark, texts):
    frame, _ = texts
    listed = spark.createDataFrame([("w1",), ("end",)], "word string")
    got = {r["row_id"]: r for r in strip_listed_words(frame, COLS, listed, limit=0).collect()}
    assert got[302]["feature1"] == ("the " * 30_000).strip() and got[302]["feature0"] == ""
    assert got[301]["feature1"] == "" and got[301]["feature0"] == "the THE the"


def test_empty_list_and_empty_table(spark, texts):
    frame, _ = texts
    none = spark.createDataFrame([], "word string")
    got = strip_listed_words(frame, COLS, none)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, clean_columns(frame, COLS, []).collect()))
    assert strip_listed_words(frame.where(F.lit(False)), COLS, none, limit=0).collect() == []


@pytest.mark.parametrize("limit", [1 << 40, 0])
def test_the_texts_are_shuffled_and_not_their_tokens(spark, texts, limit):
    frame, words = texts
    listed = spark.createDataFrame([(w,) for w in words[:5000]], "word string")
    plan = strip_listed_words(frame, COLS, listed, limit=limit)._jdf.queryExecution().executedPlan().toString()
    lines = [line.strip(" :+-*") for line in plan.splitlines()]
    partial = next(i for i, line in enumerate(lines) if "partial_collect_list" in line)
    assert not any(" Exchange" in f" {line}" for line in lines[partial - 2:partial])     # put together where they are cut


@pytest.mark.parametrize("limit", [1 << 40, 0])
def test_repeated_and_null_ids(spark, limit):
    rows = [(1, "a Rare b", "s"), (1, "c a rare2 d", None), (2, "b c", "x"), (2, "b c", "x"), (None, "a b rare3", "s"),
            (3, "", None), (4, "rare b rare2", "rare"), (5, "rare4 a rare", "b " * 3000)]
    frame = spark.createDataFrame(rows, "row_id long, feature1 string, feature0 string")
    listed = spark.createDataFrame([("rare",), ("RARE2",), ("rare3",)], "word string")
    got = sorted(map(tuple, strip_listed_words(frame, COLS, listed, limit=limit).collect()), key=repr)
    merged = [(1, "a c a b d", "s")] * 2 + [(2, "b b c c", "x x")] * 2
    want = [*merged, (None, "", ""), (3, "", ""), (4, "b", ""), (5, "rare4 a", ("b " * 3000).strip())]
    assert got == sorted(want, key=repr)
