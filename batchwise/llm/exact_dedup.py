"""Operator 4, exact dedup: a two-pass Bloom filter finds the rows that may be repeated.

Pass 1 reduces every row to (id, length, SHA-256 of the text without ASCII
white space) and sets bits of a bounded filter; only bits that two rows set
remain.  Pass 2 probes every row: a row with a missing bit is surely unique and
passes straight through, without a shuffle.  Only the others are grouped by
their digest, which settles them exactly.

Defined cases: a null text counts as empty, and empty texts are equal to one
another.  Of equal texts the one with the most code points stays, then the
smallest id (null last); of rows alike in both, exactly one.  An empty table
gives an empty result.  Columns of the input other than id and text are not
read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .bloom import MAX_FILTER_BYTES, filter_words, probe, repeated_filter
from .common import SPACE_CLASS, join_groups, text_or_empty

HASHES = 2


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_code_points."""
    text = text_or_empty(text_col)
    base = materialize(docs.select(
        F.col(id_col).alias("id"), F.length(text).cast("long").alias("n"),
        F.unhex(F.sha2(F.regexp_replace(text, f"{SPACE_CLASS}+", ""), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row_no")), "exact-dedup")
    total = base.count()
    words = filter_words(total, max_bytes=max_filter_bytes)
    twice = repeated_filter(base, F.col("digest"), words, HASHES)
    marked = probe(base, F.col("digest"), twice, words, HASHES)

    alone = marked.where("not _maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        "digest", "n")
    maybe = materialize(marked.where("_maybe").drop("_maybe"), "exact-dedup-maybe")
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "row_no")
    groups = materialize(
        maybe.groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size")),
        "exact-dedup-groups")
    settled = join_groups(maybe, groups, ["digest"], "group_size", maybe.count()).select(
        "id", F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"), "digest", "n")
    return alone.unionByName(settled).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("n").alias("n_code_points"))
