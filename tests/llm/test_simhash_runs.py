"""Runs of one key that go on over many batches: same links, and only the own entries are kept."""

import random

import numpy as np
import pyarrow as pa

from batchwise.llm import simhash


def batches_of(rows, size):
    names = ["part", "key", "block", "fp", "own"]
    for at in range(0, len(rows), size):
        cols = list(zip(*rows[at:at + size]))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.bool_())],
                                         names=names)


def components(edges, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for x in nodes:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_links_do_not_depend_on_the_batches():
    rng = random.Random(4)
    rows = []
    for run in range(12):
        own = rng.randrange(0, 6)
        for at in range(rng.randrange(1, 40)):
            rows.append((run // 6, run % 6 // 2, run % 2, rng.randrange(1 << 9), at < own))
    want = [(a[3], b[3]) for i, a in enumerate(rows) for b in rows[i + 1:]
            if a[:3] == b[:3] and a[4] and a[3] != b[3] and (a[3] ^ b[3]).bit_count() <= 2]
    nodes = {r[3] for r in rows}
    for size in (1, 2, 7, 1000):
        got = [(a, b) for x in simhash.verified(batches_of(rows, size), 2)
               for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
        assert components(got, nodes) == components(want, nodes)


def test_a_long_run_is_not_held(monkeypatch):
    joined = []
    concatenate = np.concatenate

    def counted(parts, *args, **kw):
        out = concatenate(parts, *args, **kw)
        joined.append(len(out))
        return out

    monkeypatch.setattr(simhash.np, "concatenate", counted)
    rows = [(0, 0, 0, (i + 1) << 20 | 0xFF * (i % 2), i < 10) for i in range(5000)]
    for _ in simhash.verified(batches_of(rows, 100), 0):
        pass
    assert max(joined) <= 2 * 110
