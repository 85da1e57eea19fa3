"""S7 ``assign_batches`` and S9 ``batch_row_count``.

Numbering rows 1..N in arrival order must not go through a window without
``partitionBy`` (that moves every row into one task), and must not copy the
wide rows.  Every row carries a unique ``row_id``, so (order key, row_id) is
a total order, and only that narrow projection is numbered:

1. range-partition (order key, row_id) and sort inside each partition; the
   row id splits a hot order value over many partitions;
2. tag each row with its partition id and its position inside the partition
   and write the narrow table as parquet in the shared checkpoint folder: the
   tags become stored values, so every later use (and every recomputation
   after a lost executor) sees the same layout;
3. count rows per partition (one row per partition), turn the counts into
   offsets (a running sum over P rows, P = number of partitions) and
   broadcast that P-row table back;
4. ordinal = offset + position + 1.

The result is a narrow (row_id, ord) table; callers join it to wide rows on
``row_id`` (ideally rows that are already hash-partitioned by ``row_id``,
such as the hashed row table, so only the narrow side shuffles).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phases import cycle, phase
from ..store import materialize


def ordinals(df: DataFrame, order_col: str, row_id: str = "row_id", out: str = "ord") -> DataFrame:
    """Narrow (row_id, ord): 1-based ordinal in (order_col, row_id) order."""
    keys = [order_col] if order_col == row_id else [order_col, row_id]
    narrow = df.select(*keys)
    ranged = (
        narrow.repartitionByRange(*[F.col(c) for c in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    ranged = materialize(ranged, "ordinals")
    per_part = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    # P rows only (one per partition): a single ordered window over them is cheap.
    running = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = per_part.withColumn("_off", F.sum("_n").over(running) - F.col("_n")).select("_pid", "_off", "_m0")
    out_df = ranged.join(F.broadcast(offsets), "_pid")
    return out_df.select(row_id, (F.col("_off") + (F.col("_mid") - F.col("_m0")) + 1).alias(out))


def with_ordinals(df: DataFrame, order_col: str, out: str = "ord", row_id: str = "row_id") -> DataFrame:
    """``df`` plus its ordinal (join of the narrow table back on ``row_id``)."""
    return df.join(ordinals(df, order_col, row_id, out), row_id)


def batch_size_for(n_rows: int, n_batches: int) -> int:
    return max(1, math.ceil(n_rows / n_batches))


def batch_table(df: DataFrame, order_col: str, size: int | None = None, n_batches: int | None = None,
                row_id: str = "row_id", out: str = "batch_no", ordinal: str | None = None) -> DataFrame:
    """S7 narrow: (row_id, batch_no[, ordinal]) with batches of ``size`` rows in order.

    Give either ``size`` or ``n_batches`` (then size = ceil(N / n_batches)).
    """
    if (size is None) == (n_batches is None):
        raise ValueError("give exactly one of size, n_batches")
    if size is None:
        size = batch_size_for(df.count(), n_batches)
    ords = ordinals(df, order_col, row_id, "_ord")
    out_df = ords.withColumn(out, (F.floor((F.col("_ord") - 1) / F.lit(size)) + 1).cast("int"))
    return out_df.withColumnRenamed("_ord", ordinal) if ordinal else out_df.drop("_ord")


def assign_batches(df: DataFrame, order_col: str, size: int | None = None, n_batches: int | None = None,
                   out: str = "batch_no", ordinal: str | None = None, row_id: str = "row_id") -> DataFrame:
    """``df`` with batches 1, 2, 3, ... in ``order_col`` order, ``size`` rows each."""
    return df.join(batch_table(df, order_col, size, n_batches, row_id, out, ordinal), row_id)


def with_schedule(df: DataFrame, n_train: int, n_total: int, batch_col: str = "batch_no") -> DataFrame:
    """E5 + E6 columns: ``phase`` and ``cycle``."""
    return df.withColumns({"phase": phase(batch_col, n_train, n_total), "cycle": cycle(batch_col, n_total)})


def batch_row_count(df: DataFrame, batch_col: str = "batch_no") -> DataFrame:
    """Rows per batch."""
    return df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_rows"))
