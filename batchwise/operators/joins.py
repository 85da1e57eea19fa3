"""Joins against model tables whose size has a proven bound.

A model table keyed by (class or cluster, bucket) can never hold more than
``k * n_features`` rows, whatever the data volume; that bound comes from
parameters, not from a sample.  When the bound times the row width fits under
``MAX_BROADCAST_BYTES`` the model side is broadcast, so the (possibly hugely
skewed) feature side is never shuffled on ``bucket``.  Beyond the bound the
join is left to a shuffle join, where AQE's skew-join handling splits hot
buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper limit for a broadcast model table, in bytes (bound x row width).
MAX_BROADCAST_BYTES = 512 * 1024 * 1024
# The same where many tables follow one another or their number grows with the batches: the driver holds each about three
# times while it builds it (rows, hash relation, blocks).
CHAIN_BROADCAST_BYTES = 64 * 1024 * 1024
# Width of one model row in the broadcast hash relation (ids, a few doubles, overhead).
MODEL_ROW_BYTES = 48


def broadcast_if_bounded(model: DataFrame, max_rows: int, row_bytes: int = MODEL_ROW_BYTES,
                         limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when ``max_rows`` (a proven bound) fits the limit."""
    if max_rows * row_bytes <= limit:
        return F.broadcast(model)
    return model


# Numbers in one row of a packed model table.
PACKED = 32


def packed_width(n_values: int) -> int:
    """Neighbouring buckets that share a row of a packed table."""
    return max(1, PACKED // n_values)


def packed_bytes(n_rows: int, n_values: int, n_buckets: int) -> int:
    """Most bytes of a packed table of so many rows, if its keys have so many buckets in all."""
    width = packed_width(n_values)
    return min(n_rows, -(-n_buckets // width)) * (8 * width * n_values + 64)


def join_packed(rows: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[Column], names: Sequence[str],
                how: str = "left") -> DataFrame:
    """``rows`` with the table's values of their bucket (null where it has none), by a broadcast of the table.

    ``table`` has one row per ``keys``, bucket and value that is not null.  Neighbouring buckets
    share a broadcast row, so that the driver and the executors hold about 8 bytes a value
    instead of a row with its place in the hash relation for each bucket.
    """
    k, width = len(values), packed_width(len(values))
    block, place = F.floor(F.col("bucket") / width).cast("int"), F.pmod(F.col("bucket"), F.lit(width))
    packed = table.groupBy(*keys, block.alias("_block")).agg(
        F.array(*[F.max(F.when(place == o, v)) for o in range(width) for v in values]).alias("_packed"))
    joined = rows.withColumn("_block", block).join(F.broadcast(packed), [*keys, "_block"], how)
    return joined.withColumns({name: F.get("_packed", place * k + j) for j, name in enumerate(names)}).drop(
        "_block", "_packed")


# A key is hot when it holds more than this share (1/HOT_KEYS) of all rows, so there are at most HOT_KEYS hot keys.
HOT_KEYS = 1000


def join_counted(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str, row_bytes: int = MODEL_ROW_BYTES,
                 limit: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with a written table of one row per key that knows its number of rows (``count``).

    A table whose counted size fits ``limit`` is broadcast.  Beyond it the hot
    keys, at most HOT_KEYS, are broadcast and their rows stay where they are;
    the others are joined by shuffle, where no key has a larger share than that.
    """
    n, total = table.agg(F.count(F.lit(1)), F.sum(count)).first()
    if n * row_bytes <= (MAX_BROADCAST_BYTES if limit is None else limit):
        return rows.join(F.broadcast(table.drop(count)), list(keys))
    least = max(1, (total or 0) // HOT_KEYS)
    stay = rows.join(F.broadcast(table.where(F.col(count) > least).drop(count)), list(keys))
    move = rows.join(F.broadcast(table.where(F.col(count) > least).select(*keys)), list(keys), "left_anti").join(
        table.where(F.col(count) <= least).drop(count), list(keys))
    return stay.unionByName(move)
