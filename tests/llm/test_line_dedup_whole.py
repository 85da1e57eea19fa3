"""Line dedup with a bound that grows with the line, and exact repeats of short lines, against plain Python."""

import random

from pyspark.sql import functions as F

from batchwise.llm import line_dedup as module
from batchwise.llm.line_dedup import line_dedup, within
from tests.llm import brute


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def dedup(rows, exact, every, least=5):
    """(id, text) in order -> list of (id, text, n_exact, n_near)."""
    done, seen, out = set(), [], []
    for i, t in rows:
        kept, exact_n, near_n = [], 0, 0
        for line in t.split("\n"):
            ws = brute.words(line)
            if len(ws) < exact:
                kept.append(line)
            elif tuple(ws) in done:
                exact_n += 1
            else:
                done.add(tuple(ws))
                bounds = [(s, max(1, max(len(s), len(ws)) // every)) for s in seen if len(ws) >= least]
                if any(abs(len(s) - len(ws)) <= k and distance(ws, s) <= k for s, k in bounds):
                    near_n += 1
                else:
                    kept.append(line)
                if len(ws) >= least:
                    seen.append(ws)
        out.append((i, "\n".join(kept), exact_n, near_n))
    return out


def edited(rng, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            words.insert(at, rng.choice(vocabulary))
        else:
            del words[at]
    return words


def got_of(spark, rows, **kw):
    frame = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **kw)
    return sorted(map(tuple, frame.select("doc_id", "text", "n_exact", "n_near").collect()))


def test_edit_bound_grows_with_the_line(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    lines = []
    for n in (12, 38, 39, 40, 41, 45, 59, 60, 61, 80, 119, 120, 200):
        base = [rng.choice(vocabulary) for _ in range(n)]
        lines += [edited(rng, base, rng.randint(0, n // 20 + 2), vocabulary) for _ in range(6)]
        lines.append(base)
    # a passage that many lines share, with few words besides, and lines of few distinct runs
    for _ in range(25):
        lines.append([*passage, *(rng.choice(vocabulary[:4]) for _ in range(12))])
    lines += [["x"] * n for n in (36, 38, 40, 42, 60, 63, 67)] + [["x", "y"] * 20, ["x", "y"] * 21, ["y", "x"] * 20]
    rng.shuffle(lines)
    rows = [(i, "\n".join(" ".join(x) for x in lines[at:at + 2])) for i, at in enumerate(range(0, len(lines), 2))]
    want = dedup(rows, 5, 20)
    assert got_of(spark, rows, edit_every=20) == want
    assert sum(w[3] for w in want) > sum(w[3] for w in dedup(rows, 5, 10 ** 9)) + 10


def test_short_lines_go_as_exact_repeats(spark):
    rows = [(1, "a b\none\n \na b c d e f"), (2, "a  b\none\n\none two"), (3, "one\na b c d e g\none too\n,")]
    got = got_of(spark, rows, exact_words=1)
    assert got == dedup(rows, 1, 10 ** 9)
    assert [r[2] for r in got] == [0, 2, 1]


def test_within_counts_words(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("abc") * 3 for _ in range(rng.randint(1, 9))],
              [rng.choice("abc") * 3 for _ in range(rng.randint(1, 9))]) for _ in range(60)]
    rows = [(" ".join(a), " ".join(b), k, distance(a, b) <= k) for a, b in pairs for k in (1, 2, 4)]
    frame = spark.createDataFrame(rows, "a string, b string, k int, want boolean")
    assert frame.where(within(F.col("a"), F.col("b"), F.col("k")) != F.col("want")).count() == 0


def test_forms_with_the_same_key_keep_apart(spark, monkeypatch):
    """Were one hash equal for all forms, the other would still find each near partner."""
    whole = module.neighbourhood
    monkeypatch.setattr(module, "neighbourhood", lambda texts: whole(texts).withColumn("key", F.lit(0).cast("long")))
    rng = random.Random(11)
    base = [[rng.choice("abcdefgh") * 2 for _ in range(9)] for _ in range(12)]
    lines = base + [edited(rng, x, 1, ["new"]) for x in base]
    rows = [(i, " ".join(x)) for i, x in enumerate(lines)]
    want = dedup(rows, 5, 10 ** 9)
    assert got_of(spark, rows) == want and sum(w[3] for w in want) >= 10
