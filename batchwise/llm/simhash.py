"""Operator 5, SimHash near-dedup by the generalised pigeonhole principle.

Fingerprint: A-Z lower-cased, words, shingles of 4 words with repeats, each
hashed by XXH64 (seed 42); a bit is set if it is set in over half the hashes.

Search: the 64 bits are cut into m groups of correlated bits, and group i gets
its own threshold t_i with  sum(t_i) = distance - m + 1.  If two fingerprints
differed by more than t_i in every group, they would differ by more than the
distance altogether; so each linked pair differs by at most t_i in some group.
The thresholds (and m) are chosen by dynamic programming on estimated numbers of
probes and candidates, from the share of ones of each bit over all fingerprints.
Every fingerprint enters its value of each group; those with a threshold above 0
also probe the values around their own.  Equal values meet in one sorted run,
where the full distance of the pairs is verified.  A run gives a spanning forest
of its links, not the links, so a dense group costs rows in its size only; runs
with very many entries are cut into blocks that meet in pairs.

Links make components by ``connected_components``; only distinct fingerprints
are searched, however many copies they have.

Defined cases: a null text counts as empty; a text without a word has
fingerprint zero and is linked like any other; fewer words than a shingle are
one shingle.  ``component_id`` is the smallest id of the component, null only if
all its ids are.  Equal rows have equal results.  An empty table gives an empty
result.  Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .common import join_groups, short_batches
from .components import connected_components

BITS = 64
SEED = 42
SHINGLE = 4
DISTANCE = 4
# Shingles hashed at a time, and pairs verified at a time, which bounds memory.
CHUNK = 1 << 15
PAIRS = 1 << 20
# Entries of one value that a run may hold before it is cut into blocks.
BLOCK = 4096
# Relative costs: one probe is a shuffled row, one candidate an XOR in an array.
PROBE_COST, CANDIDATE_COST = 1.0, 0.01
MAX_GROUPS = 5


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    words = (data or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    text = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))  # the place of the space after each word
    span = min(shingle, len(words))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(text[ends[i] + 1:ends[i + span]], SEED)
                           for i in range(at, min(n, at + CHUNK))], np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """id, rid (a hash of id and text, for rows without a usable id) and fp, per row."""
    short_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("rid"),
                       text.cast("binary").alias("data"))
    schema = rows.select("id", "rid", F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.view(np.int64))],
                                             names=["id", "rid", "fp"])

    return rows.mapInArrow(run, schema)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


@dataclass(frozen=True)
class Part:
    """One group of bits with its threshold."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    @property
    def flips(self) -> list[int]:
        """Every change of up to ``threshold`` bits, the empty one first."""
        out = [0]
        last = [(0, -1)]
        for _ in range(self.threshold):
            last = [(f | 1 << b, i) for f, at in last for i, b in enumerate(self.bits) if i > at]
            out += [f for f, _ in last]
        return out


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, over all of them, the 64 x 64 mean products of their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((BITS, BITS))
        for b in batches:
            data = b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            ones = np.unpackbits(data, axis=1, bitorder="little").astype(np.float64)
            gram += ones.T @ ones
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(gram.ravel())], names=["at", "s"])

    sums = fps.select("fp").mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    n = fps.count()
    gram = np.zeros(BITS * BITS)
    for at, s in sums:
        gram[at] = s
    return n, gram.reshape(BITS, BITS) / max(1, n)


def correlated_groups(moments: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """The bits in ``m`` groups of nearly equal size; each group takes the bit most correlated with it next."""
    mean = np.diag(moments)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    close = np.abs(moments - np.outer(mean, mean)) / np.outer(spread, spread)
    left, groups = list(range(BITS)), []
    for size in [BITS // m + (i < BITS % m) for i in range(m)]:
        among = close[np.ix_(left, left)] - 2 * np.eye(len(left))
        group = [left[int(among.max(1).argmax())]]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (close[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(tuple(sorted(group)))
    return groups


def within(differ: np.ndarray) -> np.ndarray:
    """Probability that at most 0, 1, 2, ... of independent bits differ."""
    p = np.zeros(len(differ) + 1)
    p[0] = 1.0
    for d in differ:
        p[1:] = p[1:] * (1 - d) + p[:-1] * d
        p[0] *= 1 - d
    return np.cumsum(p)


def allocate(groups: list[tuple[int, ...]], mean: np.ndarray, n: int, distance: int) -> tuple[float, list[int]]:
    """The thresholds of least estimated cost with sum  distance - len(groups) + 1, and the cost."""
    least = {0: (0.0, [])}  # sum so far, each threshold plus 1 -> (cost, thresholds)
    for bits in groups:
        q = mean[list(bits)]
        near = within(2 * q * (1 - q))
        cost = [0.0]  # threshold -1: the group is not used
        for t in range(distance + 1):
            probes = 1 + sum(math.comb(len(bits), k) for k in range(1, t + 1)) / 2
            cost.append(PROBE_COST * n * probes + CANDIDATE_COST * n * n / 2 * near[t])
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in least.items():
            for t1, extra in enumerate(cost):
                total = used + t1
                if total <= distance + 1 and (total not in after or c + extra < after[total][0]):
                    after[total] = (c + extra, [*ts, t1 - 1])
        least = after
    return least[distance + 1]


def plan_parts(n: int, moments: np.ndarray, distance: int = DISTANCE) -> list[Part]:
    n = max(n, 1)  # without a fingerprint every plan would cost nothing
    options = []
    for m in range(1, min(MAX_GROUPS, distance + 1) + 1):
        groups = correlated_groups(moments, m)
        cost, thresholds = allocate(groups, np.diag(moments), n, distance)
        options.append((cost, [Part(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def probes(fps: DataFrame, parts: list[Part]) -> DataFrame:
    """part, key, fp, own: each fingerprint's value in each part (own), and the values around it that it probes.

    Of two values only the smaller one's side probes.
    """
    table = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(_signed(p.mask)).cast("long").alias("mask"),
                               F.lit(_signed(f)).cast("long").alias("flip")) for i, p in enumerate(parts) for f in p.flips])
    rows = fps.select("fp", F.explode(table).alias("p"))
    value = F.col("fp").bitwiseAND(F.col("p.mask"))
    return (rows.select("p.part", "fp", value.alias("value"), value.bitwiseXOR(F.col("p.flip")).alias("key"))
            .where("key >= value").select("part", "key", "fp", (F.col("key") == F.col("value")).alias("own")))


def in_blocks(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``block``: values with more than BLOCK entries of their own are cut, and probe every block.

    The values that are cut number at most 100,000, whatever the input: that
    bound makes their broadcast safe.
    """
    most = max(BLOCK, MAX_GROUPS * n // 100_000)
    hot = (rows.where("own").groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
           .select("part", "key", F.ceil(F.col("n") / most).cast("int").alias("blocks")))
    hot = materialize(hot, "simhash-hot")
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), blocks.cast("long")).cast("int")
    return (rows.join(F.broadcast(hot), ["part", "key"], "left")
            .select("part", "key", "fp", "own", mine.alias("mine"),
                    F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
            .select("part", "key", "block", "fp", (F.col("own") & (F.col("block") == F.col("mine"))).alias("own")))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) of the components that the links a-b make."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[root[other]], nodes[other]


def verified(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of rows sorted by (part, key, block, own first): each own entry against the rest of its run.

    Of a run that goes on only the own entries are kept, at most a block of them: each batch meets them at once.
    """
    carry: list[np.ndarray] | None = None

    def edges(cols: list[np.ndarray], old: int) -> Iterator[pa.RecordBatch]:
        """The first ``old`` rows have met one another."""
        part, key, block, fp, own = cols
        n = len(fp)
        if n < 2:
            return
        new = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        end = np.repeat(np.append(new, n), np.diff(np.concatenate([[0], new, [n]])))
        start = np.maximum(np.arange(n) + 1, old)
        first = np.flatnonzero(own & (end > start))
        count = end[first] - start[first]
        until = np.cumsum(count)
        at = 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + PAIRS, "right")))
            f, c = first[at:to], count[at:to]
            left = np.repeat(f, c)
            right = np.repeat(start[f], c) + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
            near = np.bitwise_count(fp[left] ^ fp[right]) <= distance
            a, b = fp[left[near]], fp[right[near]]
            different = a != b
            if different.any():
                a, b = forest(a[different], b[different])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
            at = to

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        cols[3] = cols[3].astype(np.int64).view(np.uint64)
        if not len(cols[3]):
            continue
        old = 0
        if carry is not None:
            old = len(carry[3])
            cols = [np.concatenate([x, y]) for x, y in zip(carry, cols, strict=True)]
        yield from edges(cols, old)
        # the last run may go on in the next batch
        part, key, block, _, own = cols
        kept = (part == part[-1]) & (key == key[-1]) & (block == block[-1]) & own.astype(bool)
        carry = [x[kept] for x in cols]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) that connect what links of at most ``distance`` bits connect; ``fps`` has distinct ``fp``."""
    n, moments = bit_moments(fps)
    rows = in_blocks(probes(fps, plan_parts(n, moments, distance)), n)
    dealt = rows.repartition("part", "key", "block").sortWithinPartitions(
        "part", "key", "block", F.col("own").desc())
    return dealt.mapInArrow(lambda batches: verified(batches, distance), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   distance: int = DISTANCE) -> DataFrame:
    """id, rid, fp and ``best`` (no_id, id, rid of the component's first row by id), per row."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("best")
    fps = materialize(rows.groupBy("fp").agg(best, F.count(F.lit(1)).alias("copies")), "simhash-fps")
    edges = materialize(links(fps, distance), "simhash-links")
    roots = connected_components(edges)
    linked = materialize(roots.withColumnRenamed("node", "fp").join(fps, "fp"), "simhash-linked")
    firsts = linked.groupBy("root").agg(F.min("best").alias("first"), F.count(F.lit(1)).alias("members"))
    known = join_groups(linked.select("fp", "root"), materialize(firsts, "simhash-firsts"), ["root"], "members",
                        linked.count()).select("fp", "first")
    groups = materialize(fps.join(known, "fp", "left").select("fp", F.coalesce("first", "best").alias("best"), "copies"),
                         "simhash-groups")
    return join_groups(rows, groups, ["fp"], "copies", rows.count()).select("id", "rid", "fp", "best")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  distance: int = DISTANCE) -> DataFrame:
    """Per row of ``docs``: id, fingerprint (16 hex digits) and component_id."""
    return simhash_groups(docs, id_col, text_col, shingle, distance).select(
        F.col("id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), F.col("best.id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that come first by id in their component; of rows with equal id and text, one."""
    groups = simhash_groups(docs, id_col, text_col, shingle, distance)
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")
    firsts = materialize(groups.where(own == F.col("best")).select(F.col("id").alias("_id"), F.col("rid").alias("_rid")),
                         "simhash-stay")
    stay = firsts.dropDuplicates(["_id", "_rid"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                       F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("rid"))
    kept = rows.join(stay, (F.col("rid") == F.col("_rid")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    if firsts.count() != stay.count():  # rows that repeat id and text
        kept = kept.dropDuplicates(["id", "rid"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
