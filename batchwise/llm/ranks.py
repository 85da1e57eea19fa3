"""Places of rows in an order, counted from 0 in each group, without a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize


def ranked(rows: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``rank``: the place in the row's group by ``order`` (nulls first), from 0.

    Rows are dealt by ranges of (groups, order), so a group of any size is
    spread over tasks; ``order`` should end in a column without ties.  Each task
    numbers what it holds, and a table with one row for each task and group in
    it gives where its numbers start.  ``rows`` is read twice: pass a written table.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*groups, *order)]
    dealt = (rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
             .withColumns({"_part": F.spark_partition_id(), "_no": F.monotonically_increasing_id()}))
    dealt = materialize(dealt, name)
    runs = dealt.groupBy("_part", *groups).agg(F.min("_no").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = runs.select(F.col("_part").alias("_of"), "_least", (F.sum("_n").over(before) - F.col("_n")).alias("_start"),
                         *[F.col(c).alias(f"_group{i}") for i, c in enumerate(groups)])
    same = [F.col("_part") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_group{i}")) for i, c in enumerate(groups)]]
    rank = F.col("_start") + F.col("_no") - F.col("_least")
    return dealt.join(starts, reduce(lambda a, b: a & b, same)).select(*rows.columns, rank.alias("rank"))
