"""T1-T3 with a stop list of any size, as a table.

``functions.text`` tests each token against a literal list, which suits some
thousand words.  A longer list (every rare word of a corpus, a gazetteer) stays a
table: the tokens meet it in a join and are put together again in their order.

Words are counted first, so the join knows what it moves.  The texts are shuffled
once, by their row, before they are cut: their tokens are put together again in the
task that cuts them.  A list whose words that occur fit ``limit`` is broadcast.  Beyond
it the hot words, at most HOT_KEYS whether listed or not, are broadcast with the
answer.  Of the others a bounded filter spares most tokens that are not listed; those
it lets through meet the list by shuffle, where no word has a larger share than a hot
one, and the places of the listed ones go to their row.  No token and no list reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNICODE_WHITESPACE
from ..store import materialize
from .joins import HOT_KEYS, MAX_BROADCAST_BYTES

# Width of a word in the broadcast hash relation.
WORD_BYTES = 96
# 64-bit words of the filter, at most: beyond it more tokens are let through, and none is lost.
FILTER_WORDS = 1 << 20


def _every(cols: Sequence[str], split_pattern: str) -> Column:
    """The tokens of all columns of a row as one array of (part, pos, word)."""
    def words(part: int, col: str):
        parts = F.split(F.coalesce(F.col(col), F.lit("")), split_pattern)
        return F.transform(F.filter(parts, lambda w: w != F.lit("")), lambda w, i: F.struct(
            F.lit(part).alias("part"), i.cast("int").alias("pos"), w.alias("word")))

    return F.concat(*[words(part, col) for part, col in enumerate(cols)])


def token_rows(df: DataFrame, cols: Sequence[str], row_id: str = "row_id",
               split_pattern: str = UNICODE_WHITESPACE) -> DataFrame:
    """(row_id, part, pos, word): the white-space separated tokens of the columns; ``part`` is the column's place."""
    return df.select(row_id, F.explode(_every(cols, split_pattern)).alias("_t")).select(row_id, "_t.part", "_t.pos", "_t.word")


def word_counts(tokens: DataFrame) -> DataFrame:
    """(key, n): tokens of each lower-case form."""
    return tokens.groupBy(F.lower("word").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def _may_be_listed(tokens: DataFrame, listed: DataFrame, n_listed: int) -> DataFrame:
    """The tokens whose ``key`` is in ``listed``, and few others, where they are.

    Each listed key sets two bits of one of the filter's words, which are broadcast.
    """
    words = min(FILTER_WORDS, 1 << (n_listed // 4).bit_length())
    slot, bits = F.pmod(F.xxhash64("key"), F.lit(words).cast("long")), F.xxhash64("key", F.lit(1))

    def bit(number: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63).cast("long")).cast("int"))

    mask = bit(bits).bitwiseOR(bit(F.shiftrightunsigned(bits, 6)))
    table = listed.select(slot.alias("_slot"), mask.alias("_mask")).groupBy("_slot").agg(F.bit_or("_mask").alias("_bits"))
    return tokens.join(F.broadcast(table), slot == F.col("_slot")).where(F.col("_bits").bitwiseAND(mask) == mask).select(
        *tokens.columns)


def _without(rows: DataFrame, dropped: DataFrame, row_id: str) -> DataFrame:
    """``rows`` (row_id, _every) without the tokens that ``dropped`` (row_id, place, key) names.

    Rows may repeat an id: a row loses a place only where it has that word.
    """
    places = dropped.groupBy(row_id).agg(F.collect_set(F.struct("place", "key")).alias("_dropped"))
    own = F.transform(F.filter("_dropped", lambda d: F.lower(F.get("_every", d["place"])["word"]) == d["key"]),
                      lambda d: d["place"])
    stay = F.array_except(F.sequence(F.lit(0), F.size("_every") - 1), own)
    every = F.when(F.col("_dropped").isNull() | (F.size("_every") == 0), F.col("_every")).otherwise(
        F.transform(stay, lambda i: F.get("_every", i)))
    return rows.join(places, row_id, "left").select(row_id, every.alias("_every"))


def strip_listed_words(df: DataFrame, cols: Sequence[str], listed: DataFrame, row_id: str = "row_id",
                       split_pattern: str = UNICODE_WHITESPACE, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """T3 with T2 as a table: ``df`` with the columns' listed words gone.

    ``listed`` has a column ``word``; case, repeats and nulls in it do not matter.
    Kept tokens keep their case and order and are joined by one space; a null text
    or one without a kept token becomes the empty string.  ``row_id`` must be unique.
    """
    stop = listed.where(F.col("word").isNotNull()).select(F.lower("word").alias("key")).distinct().withColumn(
        "_stop", F.lit(True))
    vocabulary = materialize(word_counts(token_rows(df, cols, row_id, split_pattern)).join(stop, "key", "left").select(
        "key", "n", F.coalesce("_stop", F.lit(False)).alias("_stop")), "stoplist-words")
    n_listed, total = vocabulary.agg(F.count_if("_stop"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # the texts move, not their tokens; a null id has no texts to put together
    texts = df.where(F.col(row_id).isNotNull()).select(row_id, *cols).repartition(row_id).select(
        row_id, _every(cols, split_pattern).alias("_every"))
    if n_listed * WORD_BYTES <= limit:
        gone = vocabulary.where("_stop")
    else:
        hot = F.col("n") > max(1, total // HOT_KEYS)
        gone, listed_cold = vocabulary.where(hot & F.col("_stop")), vocabulary.where(~hot & F.col("_stop")).select("key")
        placed = df.where(F.col(row_id).isNotNull()).select(row_id, F.posexplode(_every(cols, split_pattern)).alias(
            "place", "_t")).select(row_id, "place", F.lower("_t.word").alias("key"))
        cold = placed.join(F.broadcast(vocabulary.where(hot).select("key")), "key", "left_anti")
        # an inner join, whose keys are distinct: a semi join would be moved before the filter
        dropped = _may_be_listed(cold, listed_cold, n_listed).join(listed_cold, "key")
        texts = _without(texts, dropped, row_id)
    kept = texts.select(row_id, F.explode("_every").alias("_t")).select(row_id, "_t.part", "_t.pos", "_t.word")
    kept = kept.join(F.broadcast(gone.select("key")), F.lower("word") == F.col("key"), "left_anti")
    together = kept.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("part", "pos", "word"))).alias("_kept"))

    def text(part: int):
        own = F.transform(F.filter("_kept", lambda t: t["part"] == part), lambda t: t["word"])
        return F.coalesce(F.array_join(own, " "), F.lit(""))

    joined = df.join(together, row_id, "left")
    return joined.withColumns({col: text(part) for part, col in enumerate(cols)}).drop("_kept").select(*df.columns)
