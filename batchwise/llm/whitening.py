"""Operator 11, embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Vectors become integer vectors x = floor(SCALE * c); each distinct one is in the
fit list once.  Tasks sum the fit list's vectors, then the products of the centred
ones; only sums of the size of the dimension reach the driver.  There the covariance
V is factored as L L' by Cholesky with pivoting, where L is triangular up to the order
of its rows, and Jacobi rotations make the columns of L orthogonal, without forming a
product of L with itself.  The squared norms of the rotated columns are the
eigenvalues of V, and the columns divided by their norms are its components.

Defined cases: vectors that are null or hold nulls, NaN or infinities are dropped,
and so are those whose length is not the commonest one (of equally common ones the
longest).  Entries beyond a long saturate.  Equal vectors are fitted once and all
returned; rows that repeat are returned as often.  Components of no variance (of a
constant or dependent dimension, or of a single vector) do not exist and give no
rows; an empty table gives an empty result.  ``deviation`` is null where it exceeds a
long.  Columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize

SCALE = 256
COMPONENTS = 4
SWEEPS = 60
EPS = float(np.finfo(float).eps)
HALF = 1 << 32


def integer_vector(vec: Column) -> Column:
    """floor(SCALE * c) for each entry, as longs; null for vectors that are dropped."""
    doubles = F.transform(vec, lambda c: c.cast("double"))
    fine = F.forall(doubles, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(doubles, lambda c: F.floor(F.lit(float(SCALE)) * c) + 0))


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (rows in the order of ``a``, as many columns as its rank) with L L' = a, the largest rest first."""
    size = len(a)
    rest, factor = np.diag(a).copy(), np.zeros_like(a)
    order, least = np.arange(size), size * EPS * max(rest.max(initial=0.0), 0.0)
    for k in range(size):
        at = k + int(np.argmax(rest[order[k:]]))
        if rest[order[at]] <= least:
            return factor[:, :k]
        order[[k, at]] = order[[at, k]]
        own, below = order[k], order[k + 1:]
        factor[own, k] = rest[own] ** 0.5
        factor[below, k] = (a[below, own] - factor[below, :k] @ factor[own, :k]) / factor[own, k]
        rest[below] -= factor[below, k] ** 2
    return factor


def jacobi_columns(factor: np.ndarray) -> np.ndarray:
    """``factor`` with its columns rotated until they are orthogonal, disjoint pairs at a time."""
    cols = factor.T.copy()
    n = len(cols)
    if n < 2:
        return cols.T
    ring = np.arange(n + n % 2)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(ring) - 1):
            p, q = ring[:len(ring) // 2], ring[len(ring) // 2:][::-1]
            both = (p < n) & (q < n)
            p, q = p[both], q[both]
            a, b = cols[p], cols[q]
            aa, bb, ab = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
            off = np.abs(ab) / np.sqrt(np.maximum(aa * bb, np.finfo(float).tiny))
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > EPS
            zeta = np.where(turn, (bb - aa) / (2 * np.where(turn, ab, 1.0)), 0.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            cols[p], cols[q] = c[:, None] * a - s[:, None] * b, s[:, None] * a + c[:, None] * b
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst <= 4 * EPS * n ** 0.5:
            break
    return cols.T


@dataclass(frozen=True)
class Whitening:
    """n and per-dimension sums of the fit list, eigenvalues (falling) and components (as columns), trace of V."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        # entry by entry: a matrix product may round equal rows unlike by their place
        centred = x - self.mean
        products = np.zeros((len(x), self.components.shape[1]))
        for entry, weights in zip(centred.T, self.components):
            products += np.multiply.outer(entry, weights)
        return products / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sums of (n * x - S)^2."""
        most = self.n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, self.sums))
        if most * most * len(self.sums) < 1 << 62:
            return ((self.n * x - np.array(self.sums)) ** 2).sum(1).tolist()
        exact = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def matrix(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _matrices(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    return (matrix(b, dimension) for b in batches if b.num_rows)


def sum_fit(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums; a row for each dimension reaches the driver."""

    def partial(batches):
        n, high, low = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for x in _matrices(batches, dimension):
            n += len(x)
            high += (x // HALF).sum(0)
            low += (x % HALF).sum(0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(dimension), "n": np.full(dimension, n), "high": high, "low": low})

    rows = fit.mapInArrow(partial, "i long, n long, high long, low long").groupBy("i").agg(
        *[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect()
    return rows[0]["n"], [r["high"] * HALF + r["low"] for r in rows]


def scatter(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """The sum of products of the centred vectors; rows of the matrix meet in tasks, and one of each reaches the driver."""
    dimension = len(mean)
    lists = pa.list_(pa.float64())

    def partial(batches):
        total = np.zeros((dimension, dimension))
        for x in _matrices(batches, dimension):
            for at in range(0, len(x), 4096):
                centred = x[at:at + 4096] - mean
                total += centred.T @ centred
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dimension), pa.int64()), "row": pa.array(list(total), lists)})

    def summed(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), _matrices([batch.select([1])], dimension).__next__()):
                totals[i] = totals[i] + row if i in totals else row
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(totals), pa.int64()),
                                          "row": pa.array(list(totals.values()), lists)})

    schema = "i long, row array<double>"
    rows = fit.mapInArrow(partial, schema).repartition("i").mapInArrow(summed, schema).collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def eigen(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` eigenvalues, falling, and their components; the largest entry of a component is positive."""
    rotated = jacobi_columns(pivoted_cholesky(covariance))
    norms = np.sqrt((rotated ** 2).sum(0))
    order = [i for i in np.argsort(-norms, kind="stable") if norms[i] > 0][:most]
    units = rotated[:, order] / norms[order]
    signs = np.sign(units[np.abs(units).argmax(0), np.arange(len(order))]) if len(order) else np.ones(0)
    return norms[order] ** 2, units * signs


def fit_whitening(fit: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``fit``, a written table of distinct integer vectors."""
    n, sums = sum_fit(fit, dimension)
    mean = np.array([s / n for s in sums])
    covariance = scatter(fit, mean) / n
    values, vectors = eigen(covariance, components)
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)))


def identity_error(fit: DataFrame, whitening: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    k, dimension = len(whitening.eigenvalues), len(whitening.sums)

    def partial(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for x in _matrices(batches, dimension):
            white = whitening.project(x)
            total += white.sum(0)
            products += white.T @ white
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "v": np.vstack([products, total]).ravel()})

    rows = fit.mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((k + 1, k))
    for r in rows:
        sums[r["i"], r["j"]] = r["v"] / whitening.n
    # x is centred already, so the means left are rounding errors
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max(initial=0.0))


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    valid = rows.select(F.col(id_col).alias("id"), integer_vector(F.col(vec_col)).alias("x")).where("x is not null")
    lengths = valid.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.col("n").desc(), F.col("size").desc()).first()
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None or not common["size"]:
        return valid.limit(0).select(F.col("id").alias(id_col), *[
            F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema])
    dimension = common["size"]
    valid = valid.where(F.size("x") == dimension)
    fit = materialize(valid.select("x").distinct(), "whitening-fit")
    fitted = fit_whitening(fit, dimension, components)
    error = identity_error(fit, fitted)
    shared = spark.sparkContext.broadcast(fitted)

    @F.pandas_udf("deviation long, whitened array<double>")
    def projected(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for vectors in batches:
            x = np.stack(vectors.to_numpy())
            yield pd.DataFrame({"deviation": pd.Series(own.deviations(x), dtype="Int64"),
                                "whitened": list(own.project(x))})

    explained = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.eigenvalues]).cast("array<double>")
    out = valid.select("id", projected.asNondeterministic()("x").alias("p")).select(
        "id", "p.deviation", F.posexplode("p.whitened").alias("k", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"),
                      F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
