"""Each operator against plain Python, over rows with nulls, empty and long texts, ties, repeats and clashing names."""

import base64
import hashlib
import math
import random
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchwise.llm import parameters as P
from batchwise.llm.byte_bpe import decode, digests, encode, fold, read_ranks
from batchwise.llm.components import connected_components
from batchwise.llm.exact_dedup import exact_dedup
from batchwise.llm.line_dedup import line_dedup
from batchwise.llm.mixing import mix_sources
from batchwise.llm.quality_rules import RULES, STEPS, keep_good, most_rejected, quality_rules
from batchwise.llm.rule_ensemble import classify_quality, rules_of
from batchwise.llm.simhash import (allocate, correlated_groups, forest, keep_one_of_each, plan_parts, simhash_dedup)
from batchwise.llm.token_counts import build, count_tokens
from batchwise.llm.toxicity_fm import score_toxicity
from batchwise.llm.url_filter import Rule, build_cascade, judge_urls
from tests.llm import brute

CLASH = ["row", "id", "_id", "key", "word", "best", "fp", "kept", "copy_no", "n_words", "rid", "lead", "_text",
         "n_tokens", "ids", "score", "emptied", "_counts", "base_failed"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def sentence(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    texts = [None, "", " \t\n", "one", "a b c", "A  b\tc", "x " * 200, "line\n" * 30, "###&&& $$$\n" * 20]
    shared = sentence(60)
    for _ in range(12):
        body = [sentence(rng.randint(4, 60)) for _ in range(rng.randint(1, 5))]
        texts += ["\n".join(body), "\n".join([*body, shared]), "\n".join(body).replace(" ", "  ", 2)]
        changed = body[0].split(" ")
        changed[rng.randrange(len(changed))] = "changed"
        texts.append("\n".join([" ".join(changed), *body[1:]]))
        changed.insert(rng.randrange(len(changed)), "inserted")
        texts.append(" ".join(changed))
    texts.append(" ".join(sentence(50) for _ in range(400)))
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, texts[15]), (None, None), (5000, texts[20]), (5001, texts[20])]
    langs, sources = ["en", "de", None], ["big", "big", "big", "small", None]
    return [(i, t, langs[k % 3], sources[k % 5], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


ROWS = corpus()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(r[0], k % 2, k % 3 == 0) for k, r in enumerate(ROWS)] + [(None, 1, True), (3, None, None), (10 ** 9, 1, True)]
    return spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in rows],
                                 "doc_id long, quality int, toxic int")


def bag(rows):
    return sorted(map(repr, map(tuple, rows)))


def empty(docs):
    return docs.where("false")


# 1 ------------------------------------------------------------------------------------------------------------------

def test_quality_rules_base(docs, labels):
    got = quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                             "n_repeat_words", "base_failed").collect()
    assert bag(got) == bag((i, *brute.base(t)) for i, t in PAIRS)
    assert keep_good(docs, labels).columns == docs.columns
    assert quality_rules(empty(docs), labels).count() == 0 and keep_good(empty(docs), labels).count() == 0


@pytest.mark.parametrize("n, share, level", [(200, 0.05, 0.01), (1000, 0.01, 0.002), (30, 0.1, 0.05), (5, 0.1, 0.01)])
def test_binomial_bound_is_exact(n, share, level):
    def below(k):
        return sum(math.comb(n, i) * share ** i * (1 - share) ** (n - i) for i in range(k + 1))

    k = most_rejected(n, share, level)
    assert k == max((i for i in range(-1, n) if i < 0 or below(i) <= level))


def test_cutoffs_limit_false_rejections(spark):
    """A rule that tells the classes apart gets a cutoff in the stratum with labels enough, and in no other."""
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(4000):
        bad = i % 5 == 0
        ws = [f"w{rng.randrange(10 ** 6)}" + ("#" if bad and k % 2 else "") for k in range(60)]
        rows.append((i, " ".join(ws), "en" if i >= 200 else "xx"))
        marks.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = quality_rules(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    kept = {r["doc_id"]: r["kept"] for r in judged.collect()}
    assert all(kept[i] for i in range(200))
    assert not any(kept[i] for i in range(200, 4000) if i % 5 == 0)
    assert sum(not kept[i] for i in range(200, 4000) if i % 5) <= 0.05 * 3040
    assert len({r.name for r in RULES}) == len(RULES) and all(len(r.cutoffs) == STEPS for r in RULES)


# 2, 3 ---------------------------------------------------------------------------------------------------------------

def test_rules_of_printed_trees():
    text = ("Tree 0 (weight 1.0):\n  If (feature 0 <= 0.5)\n   If (feature 1 <= 2.0)\n    Predict: 1.0\n"
            "   Else (feature 1 > 2.0)\n    Predict: 0.0\n  Else (feature 0 > 0.5)\n   Predict: 0.0\n")
    rules = [r.terms for r in rules_of(text, ["a", "b"])]
    assert rules == [(("a", False, 0.5),), (("a", False, 0.5), ("b", False, 2.0)),
                     (("a", False, 0.5), ("b", True, 2.0)), (("a", True, 0.5),)]


@pytest.mark.parametrize("classify", [classify_quality, score_toxicity])
def test_classifiers_on_odd_rows(docs, labels, classify):
    got = classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert all(r["held_out"] == (__import__("zlib").crc32(str(r["doc_id"]).encode()) % 5 == 0)
               for r in got if r["doc_id"] is not None)
    assert classify(empty(docs), labels).count() == 0
    none = classify(docs, labels.where("false")).collect()
    assert {round(r["score"], 6) for r in none} == {0.5}


def _accuracy(spark, classify, column, sf="/root/testdata/sf0.1"):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    return np.mean([r["predicted"] == r[column] for r in rows])


def test_quality_held_out_accuracy(spark):
    assert _accuracy(spark, classify_quality, "quality") > 0.98


def test_toxicity_held_out_accuracy(spark):
    assert _accuracy(spark, score_toxicity, "toxic") > 0.95


def test_toxicity_learns_pairs(spark):
    """Neither word alone is toxic, both together are."""
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(2500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        ws = [f"f{rng.randrange(40)}x" for _ in range(6)] + ["insult"] * insult + ["group"] * group
        rows.append((i, " ".join(w.replace("0", "o") for w in ws)))
        marks.append((i, int(insult and group)))
    docs, labels = (spark.createDataFrame(x, s) for x, s in (
        (rows, "doc_id long, text string"), (marks, "doc_id long, toxic int")))
    got = score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.97


# 4, 5, 6 ------------------------------------------------------------------------------------------------------------

def test_exact_dedup(docs):
    got = exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert bag(got) == bag(brute.exact(PAIRS))
    assert bag(exact_dedup(docs, max_filter_bytes=8).select(*got[0].asDict()).collect()) == bag(got)  # a full filter
    assert exact_dedup(empty(docs)).count() == 0


def test_simhash_components(docs):
    got = simhash_dedup(docs).collect()
    assert bag(got) == bag((i, *x) for (i, _), x in zip(PAIRS, brute.simhash(PAIRS)))
    assert simhash_dedup(empty(docs)).count() == 0
    stay = keep_one_of_each(docs)
    assert stay.columns == docs.columns
    ids = [r["doc_id"] for r in stay.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted({c for _, c in brute.simhash(PAIRS)}, key=str)


def test_thresholds_keep_every_pair():
    """Any two fingerprints at the distance or less are within some part's threshold."""
    rng = np.random.default_rng(1)
    moments = np.full((64, 64), 0.25) + 0.25 * np.eye(64)
    for n in (100, 10 ** 5, 10 ** 8, 10 ** 11):
        parts = plan_parts(n, moments)
        for _ in range(300):
            change = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any((change & p.mask).bit_count() <= p.threshold for p in parts)
            assert any(change & p.mask in p.flips for p in parts)
    groups = correlated_groups(moments, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    _, thresholds = allocate(groups, np.diag(moments), 1000, 4)
    assert sum(thresholds) == 4 - 3 + 1


def test_dense_group_gives_a_forest(spark):
    a = np.array([1, 1, 2, 5, 6], np.uint64)
    b = np.array([2, 3, 3, 6, 7], np.uint64)
    assert sorted(zip(*map(list, forest(a, b)))) == [(1, 2), (1, 3), (5, 6), (5, 7)]
    path = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (None, 3), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(path).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert connected_components(path.where("false")).count() == 0


def test_line_dedup(docs):
    got = line_dedup(docs).select("doc_id", "text", "n_lines", "n_exact", "n_near", "emptied").collect()
    want = brute.dedup_lines(PAIRS)
    assert bag(got) == bag((i, *want[i, t]) for i, t in PAIRS)
    assert sum(r["n_near"] for r in got) > 5
    assert line_dedup(empty(docs)).count() == 0


# 7, 8 ---------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ranks():
    return read_ranks(P.vocabulary(P.BPE_FILE))


def test_bpe_equals_the_library_and_round_trips(docs, ranks):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.pattern(), mergeable_ranks=ranks, special_tokens={})
    coded = encode(docs, ranks, P.pattern(), size=200)
    got = digests(decode(coded, ranks)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()

    def want(i, t):
        ids = library.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(
            (t or "").encode()).hexdigest()

    assert bag(got) == bag(want(i, t) for i, t in PAIRS)
    once = digests(encode(docs, ranks, P.pattern(), size=0, decoded=True)).select(*got[0].asDict()).collect()
    assert bag(once) == bag(got)
    assert encode(empty(docs), ranks, P.pattern()).count() == 0
    for text in ("<|endoftext|> it's\u00a0\u3000 ñandú\x1c😀 '11", "\n\n  \t x"):
        assert [i for w in __import__("regex").findall(P.pattern(), text) for i in fold(w.encode(), ranks)] == \
            library.encode_ordinary(text)


def test_token_counts(docs, ranks):
    longest = max(map(len, ranks))
    got = count_tokens(docs, ranks).collect()
    want = [(i, len(brute.words(t)), sum(brute.greedy(b" " + w.encode(), ranks, longest) for w in brute.words(t)))
            for i, t in PAIRS]
    assert bag(got) == bag(want) and count_tokens(empty(docs), ranks).count() == 0
    with pytest.raises(ValueError):
        build([b"a"])
    rng = random.Random(5)
    pieces = {bytes([b]) for b in range(256)} | {bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(60)}
    automaton = build(pieces)
    for _ in range(500):
        w = bytes(rng.choices(b"abc", k=rng.randint(0, 30)))
        assert automaton.count(w) == brute.greedy(w, pieces, 6)


# 9, 10 --------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("options", [{}, {"weights": {"small": 1.0}}, {"epochs": 40.0}, {"weights": {"none": 1.0}}])
def test_mixing(docs, options):
    got = mix_sources(docs, **options)
    counts = brute.copies([(r[0], r[3]) for r in ROWS], **options)
    want = [(*r, k, n) for r, n in zip(ROWS, counts) for k in range(1, n + 1)]
    assert bag(got.select("doc_id", "text", "lang", "source", "n_chars", "copy_no", "n_copies").collect()) == bag(want)
    assert mix_sources(empty(docs)).count() == 0


URLS = ["http://a.example.org/es/x?q#f", "https://EXAMPLE.org/en/12", "https://x.com/fr/1", "ftp://y.com/de/2", None, "", "no",
        "http://", "http://m.bad.example.net/p", "http://bad.example.net#x", "http://notbad.example.net/", "a://b://c/d",
        "http://one.net/only?x", "http://one.net/only/more", "http://x.com/fr/1", "http://example.org.evil/es/"]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS * 2)],
                                  "page_id long, url string, host string, key string")
    listed = ["bad.example.net", "one.net/only", "unseen.example"]

    def want(i, u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            at = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
            host, rest = rest[:at], rest[at:]
            path = rest[:next((k for k, c in enumerate(rest) if c in "?#"), len(rest))]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in P.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        hit = any(host == k or host.endswith("." + k) or host + path == k for k in listed)
        return i, host, path, rule and rule.name, rule.verdict if rule else "block" if hit else "allow"

    keys = spark.createDataFrame([(k,) for k in listed], "key string")
    expected = bag(want(i, u) for i, u in enumerate(URLS * 2))
    for most in (1 << 20, 4):  # filters, and the join that replaces them when they would be too large
        got = judge_urls(pages, keys, P.URL_RULES, max_bytes=most).select("page_id", "host", "path", "rule", "verdict")
        assert bag(got.collect()) == expected
    assert judge_urls(pages.where("false"), keys, P.URL_RULES).count() == 0
    assert judge_urls(pages, keys.where("false"), [Rule("org", "/", "block")]).count() == len(URLS) * 2


def test_url_rules_of_the_contract(spark):
    """Each rule's word as the contract lists it, on urls that only that rule decides."""
    want = {"http://a.org/": ("org/", "allow"), "http://example.org/es/x": ("example.org/es/", "block"),
            "http://m.example.org/en/12": ("example.org/en/1", "block"), "http://example.org/en/2": ("org/", "allow"),
            "http://x.com/fr/1": ("com/fr/", "allow"), "http://x.com/de/1": ("com/de/", "block")}
    pages = spark.createDataFrame([(u,) for u in want], "url string")
    # a listing that holds every host: the rules come first
    keys = spark.createDataFrame([("org",), ("com",)], "key string")
    got = judge_urls(pages, keys, P.URL_RULES).collect()
    assert {r["url"]: (r["rule"], r["verdict"]) for r in got} == want


def test_cascade_is_exact_over_the_universe(spark):
    from batchwise.llm.url_filter import member

    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("key % 7 = 3")
    levels = build_cascade(universe, listed)
    assert len(levels) >= 2
    wrong = universe.where(member(levels, F.col("key")) != (F.col("key") % 7 == 3)).count()
    assert wrong == 0


def test_vocabulary_file(ranks):
    with open(P.vocabulary(P.BPE_FILE), "rb") as f:
        first = f.readline().split()
    assert ranks[base64.b64decode(first[0])] == int(first[1]) and len(ranks) == 50_256
