"""What the classifiers compute against plain Python; pairs of terms; samples whose rows repeat; long words; native plans."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchwise import store
from batchwise.llm import parameters as P
from batchwise.llm import queries as Q
from batchwise.llm import rule_ensemble, toxicity_fm
from batchwise.llm.byte_bpe import encode, fold, fold_long, read_ranks, unpack
from tests.conftest import SF_MID, SF_SMALL


def marked_texts(rule, n=2500, vocabulary=300, words=25, seed=1):
    """Texts of common words in which two words come by chance; ``rule`` of the two gives the label."""
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(vocabulary)]
    rows, marks = [], []
    for i in range(n):
        ws = [rng.choice(names) for _ in range(words)]
        one, two = rng.random() < 0.5, rng.random() < 0.5
        ws += ["zorkas"] * one + ["quimby"] * two
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        marks.append((i, int(rule(one, two))))
    return rows, marks


def frames(spark, rows, marks):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


@pytest.mark.parametrize("rule", [lambda a, b: a == b, lambda a, b: a != b, lambda a, b: a and b],
                         ids=["both or neither", "exactly one", "both"])
def test_pairs_that_say_nothing_alone(spark, rule):
    rows, marks = marked_texts(rule)
    docs, labels = frames(spark, rows, marks)
    got = toxicity_fm.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95


def test_pair_statistic_is_the_double_sum():
    rng = np.random.default_rng(0)
    x = (rng.random((1500, 6)) < 0.4).astype(float)
    y = ((x[:, 1] + x[:, 4]) % 2).astype(float)
    rows = [np.flatnonzero(r).astype(np.int16) for r in x]
    p, centred = x.mean(0), y - y.mean()
    best = np.zeros(6)
    for i in range(6):
        for j in range(6):
            if i != j:
                total = sum(c * (r[i] - p[i]) * (r[j] - p[j]) for c, r in zip(centred, x))
                spread = math.sqrt(p[i] * (1 - p[i]) * p[j] * (1 - p[j]) * (centred ** 2).sum())
                best[i] = max(best[i], abs(total / spread))
    assert set(toxicity_fm.paired(rows, y, 6)) == {i for i in range(6) if best[i] >= toxicity_fm.PAIR_SCORE} == {1, 4}


def test_score_is_the_double_loop_over_pairs(spark, monkeypatch):
    machines = []
    fit = toxicity_fm.fit
    monkeypatch.setattr(toxicity_fm, "fit", lambda *a: machines.append(fit(*a)) or machines[-1])
    rows, marks = marked_texts(lambda a, b: a and b, n=900)
    rows += [(5000, None), (5001, ""), (5002, "zorkas quimby " * 9), (5003, "ZORKAS unheard")]
    docs, labels = frames(spark, rows, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity_fm.score_toxicity(docs, labels).collect()}
    machine, texts = machines[0], dict(rows)
    for i in [*range(0, 900, 13), 5000, 5001, 5002, 5003]:
        at = [f for b in toxicity_fm.buckets_of(texts[i]) if (f := machine.place[b]) >= 0]
        total = machine.w0 + sum(machine.w[f] for f in at)
        for k, f in enumerate(at):
            for g in at[:k]:
                total += float(machine.v[f] @ machine.v[g])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)


def test_rows_that_repeat_do_not_reach_the_driver(spark, monkeypatch):
    """8 labelled rows, 4,000 times each, and copies under other ids: a row for each distinct text."""
    kind, seen = type(spark.range(1)), []
    collect = kind.collect

    def watch(df):
        rows = collect(df)
        seen.append(len(rows))
        return rows

    base = [(i, f"word{'abcdefgh'[i]} calm" + " insult" * (i % 2)) for i in range(1, 9) for i in [i % 8]]
    docs = spark.createDataFrame(base, "doc_id long, text string").crossJoin(spark.range(4000).select()).repartition(4)
    copies = spark.range(100, 3100).select(F.col("id").alias("doc_id"), F.lit("copied insult").alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int").unionByName(
        copies.select("doc_id", F.lit(1).alias("toxic")))
    monkeypatch.setattr(kind, "collect", watch)
    scores = toxicity_fm.score_toxicity(docs.unionByName(copies), labels)
    assert max(seen) <= 9
    monkeypatch.undo()
    assert scores.count() == 8 * 4000 + 3000


def test_compiled_rules_equal_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    rows = rule_ensemble.features(docs, "doc_id", "text").join(
        labels.select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    rows = store.materialize(rows, "t-rules")
    intercept, weights = rule_ensemble.learn(rows.where("label is not null and not held_out").select(
        *rule_ensemble.FEATURES, "label"))
    assert len(weights) > 3
    got = rows.withColumn("score", rule_ensemble.score_of(intercept, weights)).collect()
    fired = 0
    for r in got:
        total = intercept
        for rule, w in weights:
            if all(r[name] > at if above else r[name] <= at for name, above, at in rule.terms):
                total, fired = total + w, fired + 1
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-12)
    assert fired > len(got) / 10


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(P.vocabulary(P.BPE_FILE))


def test_long_words_fold_as_short_ones(ranks, monkeypatch):
    from batchwise.llm import byte_bpe

    rng = random.Random(4)
    for letters in ("ab", "acgt", "abcdefghijklmnopqrstuvwxyz", "é中x", "a"):
        for n in (2, 3, 17, 255, 700):
            word = "".join(rng.choice(letters) for _ in range(n)).encode()
            if word in ranks:
                continue
            with monkeypatch.context() as m:
                m.setattr(byte_bpe, "LONG_WORD", 1 << 30)
                assert fold_long(word, ranks) == fold(word, ranks)


def test_word_of_a_million_letters(spark, ranks):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.pattern(), mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    word = "".join(rng.choice("acgt") for _ in range(1_000_000))
    docs = spark.createDataFrame([(1, word), (2, "a" * 300_000), (3, "short")], "doc_id long, text string").coalesce(1)
    began = time.time()
    got = {r["doc_id"]: r for r in encode(docs, ranks, P.pattern(), decoded=True).collect()}
    assert time.time() - began < 60
    assert bytes(got[1]["decoded"]).decode() == word
    for i, text in ((1, word), (2, "a" * 300_000), (3, "short")):
        assert list(unpack(bytes(got[i]["ids"]))) == library.encode_ordinary(text)


PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "PythonUDF")


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op6_line_dedup", "op9_mix_sources", "op10_url_filter"])
def test_native_plans_have_no_python(spark, monkeypatch, name):
    """The final plan and that of every table written on the way."""
    found, write = [], store.write_table

    def nodes(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [n for n in PYTHON if n in plan]

    def watch(df, path, *a, **kw):
        found.extend(nodes(df))
        return write(df, path, *a, **kw)

    monkeypatch.setattr(store, "write_table", watch)
    final = Q.QUERIES[name](spark, SF_SMALL)
    assert found + nodes(final) == []
