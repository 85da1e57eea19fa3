"""Whitening, Merkle manifest and sharding against plain Python, over nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchwise.llm import merkle, sharding, whitening
from batchwise.store import materialize

CLASH = ["id", "name", "group", "leaf", "seen", "tree", "rank", "digest", "path", "size", "vslot", "start", "x", "p", "_row"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def doc_rows(n=700, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "Ab c", "É" * 3, "w " * rng.randint(1, 300)])
        lang = rng.choices(["en", "de", "", "zz", None], [500, 70, 9, 64, 8])[0]
        rows.append((i * 7 % 10007, text, lang, rng.choice(["s", None]), None if text is None else len(text)))
    rows += [rows[3]] * 20 + [(None, "no id", "en", "s", 5), (None, None, None, None, None), (11, "Alone", "aa", "s", 5),
                              (12, "Long " * 200_000, "en", "s", 1_000_000)]
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    i, _, lang, source, n = row
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)]
    return sha("".join(fields))


def fold_all(nodes):
    """(root, a path of (digit, siblings) for each node)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 8 * 8:p // 8 * 8 + 8]
            paths[k].append((p % 8, run[:p % 8] + run[p % 8 + 1:]))
        at = [p // 8 for p in at]
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def up(node, path):
    for digit, siblings in path:
        node = sha("".join([*siblings[:digit], node, *siblings[digit:]]))
    return node


def merkle_brute(rows, tampered):
    first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (first(r[0]), leaf_of(r, r[1])))
        trees[lang] = own, *fold_all([leaf_of(r, r[1]) for r in own])
    root, tops = fold_all([trees[lang][1] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            path = path + top
            folded = up(leaf_of(r, tampered(r)), path)
            out.append((r[0], leaf_of(r, r[1]), subroot, root, sha("".join(s for _, ss in path for s in ss)), folded,
                        folded == root))
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("pick", [slice(None), slice(0, 1), slice(-1, None), slice(0, 9)])
def test_merkle_proofs_equal_plain_folding(spark, pick):
    rows = doc_rows()[pick]
    hit = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
    tampered = lambda r: r[1].lower() if hit(r) and r[1] is not None and r[1].isascii() else r[1]
    lowered = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & F.col("text").rlike(r"\A[\x00-\x7F]*\z"),
                     F.lower("text")).otherwise(F.col("text"))
    got = merkle.verify(docs_of(spark, rows), seen={"text": lowered})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = merkle_brute(rows, tampered)
    assert order(tuple(r) for r in got.collect()) == order(want)
    if len(rows) > 100:
        assert {w[-1] for w in want} == {True, False}


def test_merkle_empty_table(spark):
    assert merkle.verify(docs_of(spark, [])).collect() == []


def test_requests_descend_alone(spark):
    """Proofs of a few leaves: each step has no more rows than requests, and the paths are those of the whole run."""
    rows = doc_rows(400)
    leaves = docs_of(spark, rows).select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), merkle.leaf_digest(
        [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"))
    manifest = merkle.build_manifest(materialize(leaves, "t"), "id", "group")
    whole = {(r["tree"], r["rank"]): r["path"] for r in merkle.prove(manifest).collect()}
    asked = [(t, r) for t, r in whole if (t * 31 + r) % 97 == 0]
    assert len(asked) > 2
    some = merkle.prove(manifest, spark.createDataFrame(asked + asked, "tree long, rank long")).collect()
    assert {(r["tree"], r["rank"]): r["path"] for r in some} == {k: whole[k] for k in asked}
    assert len(some) == len(asked)


def test_records_are_found_by_their_content(spark):
    rows = [(1, "same", "en", "s", 4)] * 200
    leaves = docs_of(spark, rows).select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), F.sha2("text", 256).alias("leaf"))
    manifest = merkle.build_manifest(materialize(leaves, "t"), "id", "group")
    # 25 equal runs of 8 leaves are one record
    assert [(r["uses"], len(r["children"])) for r in manifest.lower.records[1].collect()] == [(25, 8)]
    for record in manifest.lower.records[2].collect():
        assert record["digest"] == sha("".join(record["children"]))


def shard_rows(spark, rows, shards=24, **kw):
    return sharding.shard_records(docs_of(spark, rows), shards, **kw).collect()


def test_shards_hold_near_equal_bytes(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400), "en", "s", 0) for i in range(3000)] + doc_rows(60)
    rows = [r for r in rows if r[1] is None or len(r[1]) < 10_000]
    got = shard_rows(spark, rows)
    size = lambda t: 8 + len((t or "").encode())
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert order((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == order((r[0], size(r[1]), crc(r[1])) for r in rows)
    load, places, homes = {}, {}, {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(r["vslot"], set()).add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(load) == set(range(24))
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 24
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(len(h) == 1 for h in homes.values())
    again = shard_rows(spark, random.Random(1).sample(rows, len(rows)))
    assert order(tuple(r) for r in again) == order(tuple(r) for r in got)


def test_sharding_edges(spark):
    assert shard_rows(spark, []) == []
    few = shard_rows(spark, [(1, "a", "en", "s", 1), (2, None, None, None, None), (None, None, None, None, None)])
    assert len(few) == 3 and all(r["slot"] == 0 for r in few) and len({r["shard"] for r in few}) == 3
    # rows that repeat an id share a slot; their places are apart
    same = shard_rows(spark, [(9, "t", "en", "s", 1)] * 50)
    assert len({r["shard"] for r in same}) == 1 and sorted(r["slot"] for r in same) == list(range(50))
    # one record larger than all others: the others are still spread
    big = shard_rows(spark, [(0, "y" * 2_000_000, "en", "s", 1)] + [(i, "z" * 100, "en", "s", 1) for i in range(1, 2300)])
    own = [r["shard"] for r in big if r["doc_id"] == 0][0]
    load = {}
    for r in big:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert load[own] == 2_000_008
    rest = [v for s, v in load.items() if s != own]
    assert max(rest) - min(rest) <= 108


def test_map_versions(spark):
    from batchwise.session import scratch_path

    rng = random.Random(8)
    weights = [rng.choice([0, 10, 100, 1000]) + rng.randint(0, 9) for _ in range(2000)]
    one = sharding.rebalance(sharding.first_map(2000, 24), weights, 24)
    two = sharding.rebalance(one, weights, 25)

    def loads(shard_of, shards):
        out = [0] * shards
        for s, w in zip(shard_of, weights):
            out[s] += w
        return out

    for shard_of, shards in ((one, 24), (two, 25)):
        own = loads(shard_of, shards)
        assert max(own) - min(own) <= 0.001 * sum(own) / shards + 1
    # edits, not a new map: a new shard takes little more than its share
    moved = sum(w for a, b, w in zip(one, two, weights) if a != b)
    assert moved <= 1.5 * sum(weights) / 25
    assert sharding.rebalance(two, weights, 25) == two
    path = scratch_path(spark, "t-map")
    for version, shard_of in enumerate((one, two), 1):
        sharding.store_map(spark, path, version, shard_of)
    for version, shard_of in enumerate((one, two), 1):
        assert [r["shard"] for r in sharding.read_map(spark, path, version).orderBy("vslot").collect()] == shard_of


VECTORS = "vec_id long, embedding array<double>, " + ", ".join(f"{c} string" for c in ("id", "x", "p", "n", "component"))


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, *["clash"] * 5) for i, v in rows], VECTORS)


def vector_rows(n=300, d=12, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.linspace(3, 0.2, d) + 1
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    bad = [None, [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [1.0] * (d - 1), []]
    return rows + rows[:40] * 3 + [(n + k, v) for k, v in enumerate(bad)] + [(None, rows[0][1])]


def test_whitening_equals_dense_eigenvectors(spark):
    rows = vector_rows()
    d = 12
    good = [(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v in rows
            if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in good}), float)
    mean, n = fit.mean(0), len(fit)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    assert len(got) == 4 * len(good)
    own = {}
    for r in got:
        own.setdefault((r["vec_id"], r["component"]), set()).add((r["deviation"], r["whitened"]))
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-10)
    total = [int(sum(c)) for c in zip(*({x for _, x in good}))]
    signs = {}
    for i, x in good:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, total))
        for k in range(1, 5):
            want = (np.array(x) - mean) @ vectors[:, k - 1] / values[k - 1] ** 0.5
            ((dev, white),) = own[i, k]
            assert dev == deviation and abs(white) == pytest.approx(abs(want), abs=1e-9)
            if abs(want) > 1e-6:
                signs.setdefault(k, set()).add(np.sign(white * want))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_edges(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])] * 3):
        got = whitening.whiten(vectors_of(spark, rows))
        assert got.columns == names and got.collect() == []
    # a constant and a dependent dimension: as many components as the rank
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]
    got = whitening.whiten(vectors_of(spark, line)).collect()
    assert len(got) == 20 and {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
    # sums beyond a long
    far = [(i, [float(i) * 1e14, 1.0 * (i % 3)]) for i in range(10)]
    got = whitening.whiten(vectors_of(spark, far)).collect()
    assert {r["deviation"] for r in got} == {None}
    xs = [(int(256 * i * 1e14), 256 * (i % 3)) for i in range(10)]
    assert whitening.Whitening(10, [sum(c) for c in zip(*xs)], np.ones(0), np.ones((2, 0)), 1.0).sums[0] == sum(x for x, _ in xs)


@pytest.mark.parametrize("rank", [1, 5, 30, 31])
def test_factor_and_rotation(rank):
    rng = np.random.default_rng(rank)
    a = rng.normal(size=(31, rank)) * np.logspace(0, -3, rank)
    a = a @ a.T
    factor = whitening.pivoted_cholesky(a)
    assert factor.shape == (31, rank) and np.allclose(factor @ factor.T, a, atol=1e-12)
    # triangular in the order of its pivots
    place = sorted(range(31), key=lambda i: np.flatnonzero(factor[i])[0] if factor[i].any() else rank, reverse=True)
    assert len(place) == 31
    values, vectors = whitening.eigen(a, 31)
    assert np.allclose(values[:rank], np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-9, atol=1e-14)
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-12)
