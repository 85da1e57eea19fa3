"""Mini-batch k-means with centers in a table, inertia,
silhouettes and cluster-to-label alignment.

State: ``centers (cluster, bucket, c)`` (<= k * n_features rows, broadcast
when that bound fits) and the per-cluster counts n (k scalars).

Distances use d2 = |x|^2 - 2 x.c + |c|^2: the x.c part is one join of the
row's features with the centers on ``bucket`` and a per-row sum per cluster
(see ``scoring``); |c|^2 are k scalars.  Ties (to 1e-9) go to the lowest
cluster id.

One update step on batch B (Sculley's mini-batch k-means, count-weighted):
assign every row to its nearest center, then c' = (c n + sum x) / (n + m),
n' = n + m for each cluster with m > 0 assigned rows.  The labels reported
for a training batch are recomputed with the updated centers.

Re-seeding (off unless ``reseed_ratio`` > 0): after the move, clusters with
n' below that share of the largest n' are tiny.  The tiny ones, smallest first
and at most one for two rows of the batch, become rows of the batch drawn with
probability proportional to d2 (to the centers before the move) by a weighted
race on MD5 numbers; their n' becomes the least n' of the clusters that are not
tiny.  Rows that lie on a center are not drawn.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .features import long_features
from .joins import CHAIN_BROADCAST_BYTES, MODEL_ROW_BYTES, broadcast_if_bounded, join_counted, join_packed, packed_bytes
from .scoring import argmin, dots_array, drop_dots, sparse_class_sums

DIST_DIGITS = 9


@dataclass
class KMeansState:
    centers: DataFrame      # cluster, bucket, c
    counts: list[float]     # n per cluster
    k: int
    n_features: int
    steps: int = 0
    norms: list[float] | None = None   # |c|^2 per cluster, computed once per center version


def _lit_array(values: Sequence[float]):
    return F.array(*[F.lit(float(v)) for v in values])


def kmeans_init_first(rows: DataFrame, k: int, n_features: int, row_id: str = "row_id") -> KMeansState:
    """M7 (deterministic): the k rows with the smallest ids become the centers.

    Fewer than k rows: as many clusters as rows (no center without a row).
    """
    ids = [r[0] for r in rows.select(row_id).orderBy(row_id).limit(k).collect()]
    if not ids:
        raise ValueError("k-means needs at least one row to start from")
    return _centers_from_ids(rows, ids, n_features, row_id, write=True)


def _unit_hash(row_id: str, seed: int, salt: int | str):
    """Deterministic uniform (0, 1) per row: 13 hex digits of the MD5 of "seed|salt|id" (equal in any engine)."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(salt)), F.col(row_id).cast("string"))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / float(1 << 52)


def kmeans_init_plusplus(rows: DataFrame, k: int, n_features: int, seed: int = 42,
                         row_id: str = "row_id") -> KMeansState:
    """M7 (k-means++): first center = row with the smallest seeded hash; each
    next center is drawn with probability proportional to d2 (distance to the
    nearest chosen center) by an exponential race: the smallest -ln(u) / d2,
    a distributed top-1 per step.  Each row keeps its running minimum d2, so
    a step only measures the distance to the newest center.

    Fewer than k distinct rows: as many clusters as distinct rows."""
    first = rows.select(row_id, _unit_hash(row_id, seed, 0).alias("_u")).orderBy("_u", row_id).limit(1)
    top = first.first()
    if top is None:
        raise ValueError("k-means needs at least one row to start from")
    chosen = [top[row_id]]
    dmin = None
    for j in range(1, k):
        newest = _centers_from_ids(rows, chosen[-1:], n_features, row_id)
        d = kmeans_assign(newest, rows, ("sq_x",), row_id).select(row_id, F.col("d2").alias("_d"))
        nxt_min = d if dmin is None else dmin.join(d, row_id).select(
            row_id, F.least(F.col("_dmin"), F.col("_d")).alias("_d"))
        nxt_min = nxt_min.withColumnRenamed("_d", "_dmin").persist()
        if dmin is not None:
            dmin.unpersist()
        dmin = nxt_min
        key = -F.log(_unit_hash(row_id, seed, j)) / F.col("_dmin")
        pick = (dmin.where(F.col("_dmin") > 0).select(row_id, key.alias("_key"))
                .orderBy("_key", row_id).limit(1).collect())
        if not pick:
            break
        chosen.append(pick[0][row_id])
    if dmin is not None:
        dmin.unpersist()
    return _centers_from_ids(rows, chosen, n_features, row_id, write=True)


def _rows_as_centers(rows: DataFrame, ids: list, clusters: Sequence[int], row_id: str) -> DataFrame:
    """(cluster, bucket, c): row ids[i] as the center of clusters[i]."""
    own = F.element_at(F.array(*[F.lit(int(j)) for j in clusters]),
                       F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(row_id)).cast("int"))
    picked = rows.where(F.col(row_id).isin(ids)).withColumn("cluster", own)
    return long_features(picked, ("cluster",), row_id).where(F.col("bucket").isNotNull()).select(
        "cluster", "bucket", F.col("x").alias("c"))


def _centers_from_ids(rows: DataFrame, ids: list, n_features: int, row_id: str, write: bool = False) -> KMeansState:
    centers = _rows_as_centers(rows, ids, range(len(ids)), row_id)
    if write:
        centers = materialize(centers, "kmeans-c0")
    return KMeansState(centers, [0.0] * len(ids), len(ids), n_features)


def center_norms(state: KMeansState) -> list[float]:
    """|c|^2 per cluster (k scalars), computed once per center version."""
    if state.norms is None:
        got = {r["cluster"]: r["cn"] for r in
               state.centers.groupBy("cluster").agg(F.sum(F.col("c") * F.col("c")).alias("cn")).collect()}
        state.norms = [float(got.get(j, 0.0) or 0.0) for j in range(state.k)]
    return state.norms


def kmeans_assign(state: KMeansState, rows: DataFrame, keep: Sequence[str], row_id: str = "row_id",
                  norms: list[float] | None = None) -> DataFrame:
    """M9: (row_id, keep..., d2s array, cluster, d2).  ``keep`` must hold ``sq_x``."""
    cn = norms if norms is not None else center_norms(state)
    weights = state.centers.select(F.col("cluster").alias("label"), "bucket", F.col("c").alias("w"))
    sums = sparse_class_sums(long_features(rows, keep, row_id), weights, state.k, state.n_features, keep, row_id)
    dots = dots_array(state.k)
    d2s = F.array(*[F.round(F.col("sq_x") - 2 * dots[j] + F.lit(cn[j]), DIST_DIGITS) for j in range(state.k)])
    out = drop_dots(sums.withColumn("d2s", d2s), state.k).withColumn("cluster", argmin(F.col("d2s")))
    return out.withColumn("d2", F.element_at("d2s", F.col("cluster") + 1))


def versions_per_join(k: int, n_features: int) -> int:
    """Center versions whose table has a bound that may be broadcast; at least one."""
    return max(1, CHAIN_BROADCAST_BYTES // (MODEL_ROW_BYTES * k * n_features))


def kmeans_assign_versions(versions: Sequence[tuple[KMeansState, Sequence[int]]], rows: DataFrame,
                           keep: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """M9 for many batches in one join: each row with the centers of its batch's version.

    ``versions`` lists (state, batch numbers assigned with it); rows of other
    batches are left out.  ``keep`` must hold ``batch_no`` and ``sq_x``.  The
    centers of all versions form one model table keyed by (version, bucket), at
    most len(versions) * k * n_features rows.
    """
    k, n_features = versions[0][0].k, versions[0][0].n_features
    batches = [b for _, own in versions for b in own]
    version = F.lit(0)
    for v, (_, own) in enumerate(versions[1:], 1):
        version = F.when(F.col("batch_no").isin(list(own)), F.lit(v)).otherwise(version)
    centers = None
    for v, (state, _) in enumerate(versions):
        part = state.centers.select(F.lit(v).alias("_version"), F.col("cluster").alias("label"), "bucket",
                                    F.col("c").alias("w"))
        centers = part if centers is None else centers.unionByName(part)
    feats = long_features(rows.where(F.col("batch_no").isin(batches)).withColumn("_version", version),
                          (*keep, "_version"), row_id)
    sums = sparse_class_sums(feats, centers, k, n_features, keep, row_id, group=("_version",), n_groups=len(versions))
    # versions x clusters scalars
    norms = F.element_at(F.array(*[_lit_array(center_norms(state)) for state, _ in versions]), F.col("_version") + 1)
    dots = dots_array(k)
    d2s = F.array(*[F.round(F.col("sq_x") - 2 * dots[j] + norms[j], DIST_DIGITS) for j in range(k)])
    out = drop_dots(sums.withColumn("d2s", d2s), k).drop("_version").withColumn("cluster", argmin(F.col("d2s")))
    return out.withColumn("d2", F.element_at("d2s", F.col("cluster") + 1))


def tiny_clusters(counts: Sequence[float], ratio: float, n_rows: int) -> list[int]:
    """Clusters to draw anew: below ``ratio`` of the largest count, smallest first, at most one for two rows."""
    small = [j for j, n in enumerate(counts) if n < ratio * max(counts)]
    return sorted(small, key=lambda j: (counts[j], j))[:n_rows // 2]


def _draw(assigned: DataFrame, clusters: list[int], seed: int, step: int, row_id: str) -> dict[int, object]:
    """cluster -> id of a row, rows drawn with probability proportional to d2: the least -ln(u) / d2 win."""
    key = -F.log(_unit_hash(row_id, seed, f"r{step}")) / F.col("d2")
    won = (assigned.where(F.col("d2") > 0).select(row_id, key.alias("_key")).orderBy("_key", row_id)
           .limit(len(clusters)).collect())
    return {j: r[row_id] for j, r in zip(clusters, won)}


def kmeans_update(state: KMeansState, batch_rows: DataFrame, row_id: str = "row_id",
                  path: str | None = None, reseed_ratio: float = 0.0, seed: int = 42) -> KMeansState:
    """M8: one mini-batch step (assign with the current centers, then move); the new centers are written
    to ``path``, by default a fresh folder.  ``reseed_ratio`` > 0 draws tiny clusters anew."""
    # one row per batch row, used two or three times (counts, sums, draws): keep it for this step only
    asg = kmeans_assign(state, batch_rows, ("sq_x",), row_id).select(row_id, "cluster", "d2").persist()
    got = {r["cluster"]: r["m"] for r in asg.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")).collect()}
    m = [float(got.get(j, 0)) for j in range(state.k)]
    n = state.counts
    keep_f = [1.0 if m[j] == 0 else n[j] / (n[j] + m[j]) for j in range(state.k)]
    total = [n[j] + m[j] if m[j] > 0 else 1.0 for j in range(state.k)]
    sums = (
        long_features(batch_rows.join(asg.select(row_id, "cluster"), row_id), ("cluster",), row_id)
        .where(F.col("bucket").isNotNull())
        .groupBy("cluster", "bucket").agg(F.sum("x").alias("s"))
    )
    old = state.centers.select("cluster", "bucket",
                               (F.col("c") * F.element_at(_lit_array(keep_f), F.col("cluster") + 1)).alias("v"))
    moved = sums.select("cluster", "bucket", (F.col("s") / F.element_at(_lit_array(total), F.col("cluster") + 1))
                        .alias("v"))
    centers = old.unionByName(moved).groupBy("cluster", "bucket").agg(F.sum("v").alias("c"))
    counts = [n[j] + m[j] for j in range(state.k)]
    tiny = tiny_clusters(counts, reseed_ratio, int(sum(m)))
    drawn = _draw(asg, tiny, seed, state.steps + 1, row_id) if tiny else {}
    if drawn:
        least = min(c for c in counts if c >= reseed_ratio * max(counts))
        counts = [least if j in drawn else counts[j] for j in range(state.k)]
        fresh = _rows_as_centers(batch_rows, list(drawn.values()), list(drawn), row_id)
        centers = centers.where(~F.col("cluster").isin(list(drawn))).unionByName(fresh)
    centers = materialize(centers, f"kmeans-c{state.steps + 1}", path=path)
    asg.unpersist()
    return KMeansState(centers, counts, state.k, state.n_features, state.steps + 1)


def inertia(assigned: DataFrame, by: Sequence[str] = ("batch_no",)) -> DataFrame:
    """Sum of d2 to the assigned center, per group."""
    return assigned.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("d2").alias("inertia"))


def silhouette_samples(assigned: DataFrame, rows: DataFrame, k: int, n_features: int,
                       by: Sequence[str] = ("batch_no",), row_id: str = "row_id", n_groups: int = 1,
                       limit: int = CHAIN_BROADCAST_BYTES) -> DataFrame:
    """Per-row silhouette with squared Euclidean distance, within each group.

    For cluster C: sum_{j in C} |x_i - x_j|^2 = |C| |x_i|^2 - 2 x_i . S_C + Q_C
    with S_C = sum of the members' vectors and Q_C = sum of their |x|^2, so
    no pair of rows is ever formed.  a(i) excludes i itself (|C| - 1); a
    singleton cluster gives s = 0.  Returns (row_id, by..., cluster, s).
    The cluster sums, one row per (group, bucket), are broadcast (``join_packed``).
    If those of all groups are more than ``limit`` bytes, the groups follow one another:
    only the sums of one are broadcast at a time, and no feature is shuffled for them.
    Sums of one group beyond the limit are joined by ``join_counted``.
    ``n_groups`` (number of distinct ``by`` values) bounds the table of sizes.
    """
    lab = assigned.select(row_id, *by, "cluster")
    # joined once: sizes, sums and dot products read the written rows
    members = materialize(rows.select(row_id, *by, "features", "norm", "sq_x").join(lab, [row_id, *by]),
                          "silhouette-rows", partition_by=by)
    sizes = members.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("sq_x").alias("q"))
    # the cluster sums of a group's bucket in one row, with the number of rows that meet them
    feats = long_features(members, (*by, "cluster", "sq_x"), row_id)
    csum = materialize(feats.where(F.col("bucket").isNotNull()).groupBy(*by, "bucket").agg(
        *[F.sum(F.when(F.col("cluster") == j, F.col("x"))).alias(f"_s{j}") for j in range(k)],
        F.count(F.lit(1)).alias("_rows")), "silhouette-sums", partition_by=by)
    cols = [row_id, *by, "cluster", "sq_x", "x", *[f"_s{j}" for j in range(k)]]
    dots = [F.coalesce(F.sum(F.col("x") * F.col(f"_s{j}")), F.lit(0.0)).alias(f"_dot{j}") for j in range(k)]

    def row_dots(own: Column, sizes_of: list[int]) -> DataFrame:
        """The dot products of the rows of some groups with the cluster sums of their group."""
        mine, sums = feats.where(own), csum.where(own)
        if sum(packed_bytes(n, k, n_features) for n in sizes_of) <= limit:
            met = join_packed(mine, sums, by, [F.col(f"_s{j}") for j in range(k)], [f"_s{j}" for j in range(k)])
        else:
            met = join_counted(mine.where(F.col("bucket").isNotNull()), sums, (*by, "bucket"), "_rows", 48 + 8 * k, limit)
            none = mine.where(F.col("bucket").isNull()).select(
                row_id, *by, "cluster", "sq_x", "x", *[F.lit(None).cast("double").alias(f"_s{j}") for j in range(k)])
            met = met.select(*cols).unionByName(none)
        return met.groupBy(row_id, *by, "cluster", "sq_x").agg(*dots)

    per_group = {tuple(r)[:-1]: r["_n"] for r in csum.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).collect()}
    if len(per_group) > 1 and sum(packed_bytes(n, k, n_features) for n in per_group.values()) > limit:
        groups = sorted(tuple(r) for r in sizes.select(*by).distinct().collect())
        parts = [materialize(row_dots(reduce(and_, [F.col(c) == v for c, v in zip(by, g)]), [per_group.get(g, 0)]),
                             "silhouette-dots") for g in groups]
        per_row = reduce(DataFrame.unionByName, parts)
    else:
        per_row = row_dots(F.lit(True), list(per_group.values()))
    size_arr = sizes.groupBy(*by).agg(
        *[F.coalesce(F.max(F.when(F.col("cluster") == j, F.col("size"))), F.lit(0)).alias(f"_n{j}") for j in range(k)],
        *[F.coalesce(F.max(F.when(F.col("cluster") == j, F.col("q"))), F.lit(0.0)).alias(f"_q{j}") for j in range(k)])
    # one row per group on the right: never shuffle the rows on the few group values
    per_row = per_row.join(broadcast_if_bounded(size_arr, n_groups, 16 * (k + 3)), list(by))
    tot = [F.col(f"_n{j}") * F.col("sq_x") - 2 * F.col(f"_dot{j}") + F.col(f"_q{j}") for j in range(k)]
    own_n = F.element_at(F.array(*[F.col(f"_n{j}") for j in range(k)]), F.col("cluster") + 1)
    own_t = F.element_at(F.array(*tot), F.col("cluster") + 1)
    others = [F.when((F.lit(j) != F.col("cluster")) & (F.col(f"_n{j}") > 0), tot[j] / F.col(f"_n{j}"))
              for j in range(k)]
    per_row = per_row.select(row_id, *by, "cluster", own_n.alias("_own_n"), own_t.alias("_own_t"),
                             F.array_min(F.filter(F.array(*others), lambda v: v.isNotNull())).alias("_b"))
    # a(i) only where the own cluster has another member (no division by zero)
    a = F.col("_own_t") / (F.col("_own_n") - 1)
    b = F.col("_b")
    s = (F.when(b.isNull(), F.lit(None))
         .when(F.col("_own_n") <= 1, F.lit(0.0))
         .when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b))
         .otherwise(F.lit(0.0)))
    return per_row.select(row_id, *by, "cluster", s.cast("double").alias("s"))


def silhouette(samples: DataFrame, by: Sequence[str] = ("batch_no",)) -> DataFrame:
    """Mean silhouette per group (null when a group has one cluster)."""
    return samples.groupBy(*by).agg(F.avg("s").alias("silhouette"))


def cluster_alignment(assigned: DataFrame, label: str = "label") -> DataFrame:
    """Majority label per cluster (ties -> smallest label): (cluster, aligned_label)."""
    counts = assigned.groupBy("cluster", label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("cluster").agg(
        F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label))).alias("aligned_label"))

