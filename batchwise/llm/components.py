"""Connected components by label propagation with pointer jumping, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .common import join_groups


def connected_components(edges: DataFrame) -> DataFrame:
    """For edges (a, b) of numbers: one row (node, root) per node, root the smallest node it reaches.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so paths shorten by half; hubs are joined by ``join_groups``.
    Every round is written, so a lost executor costs one round at most.  Null
    ends are left out.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = materialize(both.select("a", "b").union(both.select("b", "a")).distinct(), "cc-edges")
    total = both.count()
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("root"), F.count(F.lit(1)).alias("degree")), "cc-labels")
    changed = total
    while changed:
        told = join_groups(both, labels.withColumnRenamed("node", "a"), ["a"], "degree", total)
        told = told.groupBy(F.col("b").alias("node")).agg(F.min("root").alias("told"))
        near = materialize(
            labels.join(told, "node").select("node", F.least("root", "told").alias("root"), "degree",
                                             F.col("root").alias("was")), "cc-near")
        sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
        heads = near.select(F.col("node").alias("root"), F.col("root").alias("head")).join(sizes, "root")
        labels = materialize(
            join_groups(near, heads, ["root"], "members", total)
            .select("node", F.col("head").alias("root"), "degree", (F.col("head") < F.col("was")).alias("moved")),
            "cc-labels")
        changed = labels.where("moved").limit(1).count()
        labels = labels.drop("moved")
    return labels.select("node", "root")
