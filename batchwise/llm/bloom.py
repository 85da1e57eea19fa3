"""Bloom filters of DataFrame expressions only.

A filter is a table of 64-bit words (word, bits).  A key picks one word by one
hash and ``hashes`` bits in it by another (a blocked Bloom filter), so that a
probe reads a single word.  The number of words is bounded by a parameter:
beyond it a filter only lets more rows through, it never loses one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize

BITS_PER_KEY = 16
MAX_FILTER_BYTES = 8 << 20


def filter_words(n_keys: int, bits_per_key: int = BITS_PER_KEY, max_bytes: int = MAX_FILTER_BYTES) -> int:
    """Number of 64-bit words for ``n_keys``: a power of two, at most ``max_bytes`` in all."""
    need = max(1, -(-n_keys * bits_per_key // 64))
    return min(1 << (need - 1).bit_length(), max(1, max_bytes // 8))


def word_of(key: Column, words: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(words).cast("long"))


def bits_of(key: Column, hashes: int, seed: int) -> list[Column]:
    """The bit numbers (0 to 63) of a key in its word."""
    h = F.xxhash64(key, F.lit(seed), F.lit("bits"))
    return [F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63).cast("long")).cast("int") for j in range(hashes)]


def mask_of(key: Column, hashes: int, seed: int) -> Column:
    mask = F.lit(0).cast("long")
    for bit in bits_of(key, hashes, seed):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def filter_of(keys: DataFrame, key: Column, words: int, hashes: int = 3, seed: int = 0) -> DataFrame:
    """The filter that holds every key of ``keys``."""
    return (keys.select(word_of(key, words, seed).alias("word"), mask_of(key, hashes, seed).alias("mask"))
            .groupBy("word").agg(F.bit_or("mask").alias("bits")))


def repeated_filter(keys: DataFrame, key: Column, words: int, hashes: int = 2, seed: int = 0) -> DataFrame:
    """The filter of bits that two or more rows set: a key that occurs twice has all its bits in it.

    The counts are combined before the shuffle, which moves one small number a bit.
    """
    cells = keys.select(word_of(key, words, seed).alias("word"),
                        F.explode(F.array_distinct(F.array(*bits_of(key, hashes, seed)))).alias("bit"))
    twice = cells.groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))


def probe(rows: DataFrame, key: Column, words_table: DataFrame, words: int, hashes: int, seed: int = 0,
          flag: str = "_maybe") -> DataFrame:
    """``rows`` with a boolean ``flag``: false only where the key is surely not in the filter.

    The words are broadcast; their number is at most ``words``, which
    ``filter_words`` bounds by a parameter.
    """
    found = F.coalesce(F.col("_bits"), F.lit(0).cast("long"))
    mask = mask_of(key, hashes, seed)
    side = F.broadcast(words_table.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    kept = [F.col(c) for c in rows.columns]
    return (rows.withColumns({"_at": word_of(key, words, seed), "_mask": mask})
            .join(side, F.col("_at") == F.col("_word"), "left")
            .select(*kept, (found.bitwiseAND(F.col("_mask")) == F.col("_mask")).alias(flag)))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """A written table of the values of ``key`` that two or more rows have; only the keys are counted by shuffle."""
    return materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated-keys")


def only_repeated(rows: DataFrame, key: str, twice: DataFrame | None = None, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The rows whose ``key`` occurs in two or more rows, and few others, without moving the rows.

    ``twice`` (``repeated_keys``, worked out if not given) becomes a filter.
    """
    twice = repeated_keys(rows, key) if twice is None else twice
    words = filter_words(twice.count(), max_bytes=max_bytes)
    marked = probe(rows, F.col(key), filter_of(twice, F.col(key), words), words, 3)
    return marked.where("_maybe").drop("_maybe")
