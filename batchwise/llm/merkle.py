"""Operator 12, Merkle manifest: a content-addressed DAG and proofs by descent from its root.

Each row is a leaf, the SHA-256 of its fields.  The leaves of a group, in the
order of their ids, are folded in runs of FANOUT until one node is left, the
group's subroot; subroots, in the order of the groups, are folded likewise to the
root.  Every node is stored as a record from its digest to its children's
digests, a table for each height.

A proof is found by descent: a request for the leaf at some rank starts at the
root; at each height the records are looked up by digest, the digits of the rank
in base FANOUT say which child goes on, and the other children are collected as a
segment.  Requests with the same digits so far share one row, so a height has at
most as many rows as nodes; segments meet their leaves only in the last step, a
row for each run of FANOUT leaves.  Reversed, the segments lead from the leaf to
the root: folding them over a leaf's digest gives the root, unless its row changed.

Defined cases: a null field is ``-``, any other its UTF-8 byte count, a colon and
its value, so null, empty and very long values stay apart.  Null groups and ids
come first.  Of equal ids the smaller leaf digest comes first; equal rows are
leaves next to each other and each has a proof.  A single leaf is its own
subroot, a single subroot the root.  An empty table has no root and gives an empty
result.  Columns other than those named are not read, so they cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .common import join_groups
from .ranks import ranked

FANOUT = 8
SEGMENTS = "array<struct<digit: int, siblings: array<string>>>"


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else its byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


@dataclass(frozen=True)
class Trees:
    """``nodes`` that were folded (tree, rank, digest, ...), the ``tops`` (tree, digest, height) and the records.

    ``records[h]`` has digest, children and uses (how many nodes of height h have this digest).
    """

    nodes: DataFrame
    tops: DataFrame
    records: dict[int, DataFrame]


@dataclass(frozen=True)
class Manifest:
    """``lower``: a tree of leaves for each group; ``upper``: the tree of their subroots."""

    lower: Trees
    upper: Trees


def fold_up(nodes: DataFrame, name: str) -> Trees:
    """Folds each tree of ``nodes`` (tree, rank, digest) in runs of FANOUT until one node is left."""
    sizes = materialize(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), f"{name}-sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    level = nodes.join(sizes, "tree").select("tree", "rank", "digest", "n")
    tops, records, height = [], {}, 0
    while True:
        tops.append(level.where("n = 1").select("tree", "digest", F.lit(height).alias("height")))
        if most <= 1:
            break
        height, most = height + 1, -(-most // FANOUT)
        runs = level.where("n > 1").groupBy("tree", F.floor(F.col("rank") / FANOUT).alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("run"), F.first("n").alias("n"))
        runs = runs.select("tree", F.col("up").alias("rank"), F.col("run.digest").alias("children"),
                           F.ceil(F.col("n") / FANOUT).alias("n"))
        runs = materialize(runs.withColumn("digest", _digest(F.col("children"))), f"{name}-nodes")
        records[height] = materialize(runs.groupBy("digest").agg(
            F.first("children").alias("children"), F.count(F.lit(1)).alias("uses")), f"{name}-records")
        level = runs.select("tree", "rank", "digest", "n")
    found = tops[0]
    for top in tops[1:]:
        found = found.unionByName(top)
    return Trees(nodes, materialize(found, f"{name}-tops"), records)


def build_manifest(leaves: DataFrame, id_col: str, group_col: str) -> Manifest:
    """The manifest of ``leaves``, a written table with an id, a group and ``leaf``; other columns go along."""
    groups = materialize(leaves.select(F.col(group_col).alias("name")).distinct(), "merkle-groups")
    groups = materialize(ranked(groups, [], ["name"], "merkle-group-order").select(
        "name", F.col("rank").alias("tree")), "merkle-trees")
    rows = leaves.withColumn("_row", F.monotonically_increasing_id())
    rows = ranked(rows, [group_col], [id_col, "leaf", "_row"], "merkle-order").drop("_row")
    rows = rows.join(groups, rows[group_col].eqNullSafe(groups["name"])).drop("name").withColumn("digest", F.col("leaf"))
    lower = fold_up(materialize(rows, "merkle-leaves"), "merkle")
    upper = materialize(lower.tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), "digest"),
                        "merkle-upper-leaves")
    return Manifest(lower, fold_up(upper, "merkle-upper"))


def _segment(children: Column, digit: Column) -> Column:
    digit = digit.cast("int")
    others = F.concat(F.slice(children, F.lit(1), digit), F.slice(children, digit + 2, F.lit(FANOUT)))
    return F.array(F.struct(digit.alias("digit"), others.alias("siblings")))


def descend(front: DataFrame, records: DataFrame, requests: DataFrame | None, height: int, name: str) -> DataFrame:
    """One step down: rows (tree, rank, digest, path) at ``height`` give those of their children that are asked for."""
    total = front.count()
    found = join_groups(front, records, ["digest"], "uses", total)
    below = found.select("tree", "rank", "path", "children", F.posexplode("children").alias("digit", "child"))
    below = below.select("tree", (F.col("rank") * FANOUT + F.col("digit")).alias("rank"), F.col("child").alias("digest"),
                         F.concat("path", _segment(F.col("children"), F.col("digit"))).alias("path"))
    if requests is not None:
        width = FANOUT ** (height - 1)
        below = below.join(requests.select("tree", F.floor(F.col("rank") / width).alias("rank")).distinct(),
                           ["tree", "rank"], "left_semi")
    return materialize(below, name)


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Each leaf row asked for (tree, rank; None: every one) with subroot, root and ``path``, its segments leaf to root."""
    lower, upper = manifest.lower, manifest.upper
    trees = None if requests is None else requests.select(F.lit(0).cast("long").alias("tree"),
                                                          F.col("tree").alias("rank")).distinct()
    front = upper.tops.select("tree", F.lit(0).cast("long").alias("rank"), "digest", F.array().cast(SEGMENTS).alias("path"))
    for height in sorted(upper.records, reverse=True):
        front = descend(front, upper.records[height], trees, height, "merkle-descent-upper")
    # the upper tree's leaves are the subroots
    front = front.select(F.col("rank").alias("tree"), "path").join(lower.tops, "tree").select(
        "tree", F.lit(0).cast("long").alias("rank"), "digest", "path", "height")
    front = materialize(front, "merkle-subroots")
    at_height = {h: front.where(F.col("height") == h).drop("height") for h in (0, *lower.records)}
    below = at_height[max(lower.records, default=0)]
    for height in sorted(lower.records, reverse=True)[:-1]:
        below = descend(below, lower.records[height], requests, height, "merkle-descent")
        below = below.unionByName(at_height[height - 1])
    # the last step, for a run of leaves at a time; a leaf that is a subroot has no run
    runs = at_height[0].select("tree", "rank", "path", F.lit(None).cast("array<string>").alias("children"))
    if lower.records:
        found = join_groups(below, lower.records[1], ["digest"], "uses", below.count())
        runs = runs.unionByName(found.select("tree", "rank", "path", "children"))
    runs = runs.withColumnRenamed("rank", "up")
    leaves = lower.nodes
    if requests is not None:
        leaves = leaves.join(requests.select("tree", "rank").distinct(), ["tree", "rank"], "left_semi")
    leaves = leaves.withColumn("up", F.floor(F.col("rank") / FANOUT)).join(runs, ["tree", "up"])
    own = F.when(F.col("children").isNotNull(), _segment(F.col("children"), F.col("rank") % FANOUT)).otherwise(
        F.array().cast(SEGMENTS))
    # the root is a single digest, or there is none and no leaf either
    root = upper.tops.first()
    tops = lower.tops.select("tree", F.col("digest").alias("subroot"), F.lit(root and root["digest"]).cast("string").alias("root"))
    others = [c for c in lower.nodes.columns if c != "digest"]
    return leaves.join(tops, "tree").select(*others, "subroot", "root", F.reverse(F.concat("path", own)).alias("path"))


def proof_digest(path: Column) -> Column:
    """SHA-256 of the siblings of a path, leaf to root, left to right."""
    return _digest(F.flatten(F.transform(path, lambda s: s["siblings"])))


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path lead to."""
    return F.aggregate(path, leaf, lambda node, s: _digest(F.concat(
        F.slice(s["siblings"], F.lit(1), s["digit"]), F.array(node), F.slice(s["siblings"], s["digit"] + 1, F.lit(FANOUT)))))


def verify(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
           fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
           seen: dict[str, Column] | None = None) -> DataFrame:
    """A proof for each row, folded over the row as it is seen now (``seen``: fields that may have changed).

    Columns: id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    columns = [F.col(f"`{c}`") for c in fields]
    now = [(seen or {}).get(c, F.col(f"`{c}`")) for c in fields]
    leaves = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("name"), leaf_digest(columns).alias("leaf"),
                         leaf_digest(now).alias("seen"))
    manifest = build_manifest(materialize(leaves.withColumnRenamed("name", "group"), "merkle-rows"), "id", "group")
    rows = prove(manifest).withColumn("folded_root", fold_path(F.col("seen"), F.col("path")))
    return rows.select(F.col("id").alias(id_col), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
