"""Operator 9, mixing sources to target weights by Poisson replication.

Every source s gets a mean repetition rate  rate_s = epochs * N * weight_s / n_s
(weights sum to 1 over the sources at hand).  Each document draws its number of
copies by inverting the Poisson distribution of its source's rate at a uniform
number hashed from the seed and its id, is exploded by that number, and all
copies are dealt out by a hash, which shuffles them globally.  The draw of a row
depends on nothing but its id, its source's rate and the seed, so a lost task
gives the same rows again.

The default target weight of a source is its row count to the power ``alpha``
(0.5 here): large sources are held down, small ones lifted.  ``weights`` gives
weights by name instead; sources it does not name get weight 0, and so no copy.

Defined cases: a null source is a source of its own, and a null id counts as the
text ``null``.  Rows with the same id and source get the same number of copies,
each its own.  Null texts are copied like others.  An empty table, or weights
that name no source at hand, gives an empty result.  Input columns named like
the added ones (copy_no, n_copies) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .common import join_groups

# Largest mean that one inversion handles; larger rates are the sum of several draws.
MAX_MEAN = 16
# Counts beyond this have a probability under 1e-40 at MAX_MEAN.
MAX_COUNT = 100
# Above this number of sources their table is not broadcast.
MAX_BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5, equal in any engine that has MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None,
                 alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """One row per source: source, n, rate, draws (rate = draws * mean, mean <= MAX_MEAN) and cdf.

    ``cdf[k]`` is the probability of k or fewer copies in one draw.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    counts = materialize(counts.withColumn("weight", weight), "mixing-sources")
    # two numbers over all sources
    n, total = counts.agg(F.sum("n"), F.sum("weight")).first()
    if not n or not total:
        return _with_cdf(counts.where("false").withColumn("rate", F.lit(0.0)))
    return _with_cdf(counts.withColumn("rate", F.lit(epochs * n / total) * F.col("weight") / F.col("n")))


def _with_cdf(rates: DataFrame) -> DataFrame:
    mean = F.col("rate") / F.col("draws")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_COUNT - 1)), start,
        lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"), F.array_append(
            acc["cdf"], F.element_at(acc["cdf"], -1) + acc["p"] * F.col("mean") / k).alias("cdf")))
    return (rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int"))
            .withColumn("mean", mean).withColumn("cdf", step["cdf"])
            .select("source", "n", "rate", "draws", "cdf"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0,
                seed: int = 9) -> DataFrame:
    """The input columns of every copy, and copy_no (from 1) and n_copies, in a global random order."""
    rates = materialize(source_rates(docs, source_col, weights, alpha, epochs), "mixing-rates")
    # null sources join by a flag beside the name
    key = {"_null": F.col(source_col).isNull(), "_source": F.coalesce(F.col(source_col), F.lit(""))}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"),
                       *[c.alias(name) for name, c in key.items()])
    sides = rates.select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"),
                         "n", "draws", "cdf")
    n_sources, total = rates.agg(F.count(F.lit(1)), F.sum("n")).first()
    if n_sources <= MAX_BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(sides), ["_null", "_source"])
    else:
        joined = join_groups(rows, sides, ["_null", "_source"], "n", total or 0)

    def draw(i: Column) -> Column:
        u = uniform(F.lit(seed), F.col("_id"), i)
        return F.size(F.filter("cdf", lambda c: c <= u))

    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("draws")), draw), F.lit(0), lambda a, x: a + x)
    added = ("copy_no", "n_copies")
    out = (joined.withColumn("n_copies", copies).where("n_copies > 0")
           .select("row", "_id", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))
           .withColumn("_at", F.xxhash64(F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("null")), "copy_no"))
           .repartition("_at").sortWithinPartitions("_at"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return out.select(*kept, "copy_no", "n_copies")
