"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space; a word is a maximal run without it.
SPACE_CLASS = r"[\x20\x09-\x0D]"

# A group is hot when it holds more than this share (1/HOT_GROUPS) of all rows,
# so there are never more than HOT_GROUPS hot groups.
HOT_GROUPS = 1000


# Texts that a Python worker gets at a time, unless the session says otherwise.
BATCH_KEY, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def short_batches(spark: SparkSession) -> None:
    """Whole texts are long: a smaller Arrow batch than Spark's default bounds a worker's memory."""
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def held_out(id_col: str, folds: int = 5) -> Column:
    """True for the rows that no label may be learned from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group, whatever the share of the largest group.

    ``size`` is the group's number of rows and ``total`` the number of all
    rows.  Groups of more than total / HOT_GROUPS rows are at most HOT_GROUPS,
    a proven bound, and are broadcast: their rows stay where they are.  The
    others are joined by shuffle, where no key has more than that share.
    """
    keys = list(keys)
    least = max(1, total // HOT_GROUPS)
    hot, cold = groups.where(F.col(size) > least), groups.where(F.col(size) <= least)
    stay = rows.join(F.broadcast(hot), keys)
    move = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return stay.unionByName(move)
