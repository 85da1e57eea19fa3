"""The imported-but-unused pieces of the reference, Spark-native.

X1 ``holdout_split``: a repeatable hash split on the row id (no randomSplit,
so a re-run or a lost executor yields the same split).
X2 ``vocabulary``: CountVectorizer-style vocabulary, tokens by document
frequency (ties by token), indexed from 0; all of them or the top ``size``.
X3 ``idf``: ln((N + 1) / (df + 1)) per token (MLlib's IDF formula).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.batches import ordinals
from ..store import materialize


def hash_unit(c: Column) -> Column:
    """A value in [0, 1) from the first 8 hex digits of md5(str(c)) (portable)."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def holdout_split(df: DataFrame, test_fraction: float = 0.33, row_id: str = "row_id", out: str = "split") -> DataFrame:
    """X1: 'test' for a hash fraction of the rows, 'train' for the rest."""
    return df.withColumn(out, F.when(hash_unit(F.col(row_id)) < F.lit(test_fraction), F.lit("test"))
                         .otherwise(F.lit("train")))


def document_frequency(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, df): documents containing each token (partial aggregation first)."""
    return (df.select(F.explode(F.array_distinct(tokens)).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("df")))


def vocabulary(df: DataFrame, tokens: str = "tokens", size: int | None = None) -> DataFrame:
    """(token, df, index), index 0 for the most frequent token (ties: smallest token).

    All tokens by default, numbered by range partitions.  ``size`` keeps the
    most frequent ones (CountVectorizer's vocabSize): a per-partition top-k
    and a merge of ``size`` rows.
    """
    if size is None:
        counted = materialize(document_frequency(df, tokens).withColumn("_rank", -F.col("df")), "document-frequency")
        return counted.join(ordinals(counted, "_rank", "token"), "token").select(
            "token", "df", (F.col("ord") - 1).cast("int").alias("index"))
    top = document_frequency(df, tokens).orderBy(F.desc("df"), "token").limit(size)
    return top.withColumn("index", (F.row_number().over(Window.orderBy(F.desc("df"), "token")) - 1).cast("int"))


def count_vectors(df: DataFrame, vocab: DataFrame, tokens: str = "tokens", row_id: str = "row_id") -> DataFrame:
    """(row_id, index, cnt) term counts over the vocabulary.

    A token may be of any length, so no size bound is claimed for the
    vocabulary: Spark joins by its measured size.  A row's tokens are counted
    before the shuffle (partial aggregation: its lines are in one task).
    """
    per_row = (df.select(row_id, F.explode(tokens).alias("token")).groupBy(row_id, "token")
               .agg(F.count(F.lit(1)).alias("cnt")))
    return per_row.join(vocab.select("token", "index"), "token").select(row_id, "index", "cnt")


def idf(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, df, idf)."""
    n_docs = df.count()
    return document_frequency(df, tokens).withColumn(
        "idf", F.log(F.lit(float(n_docs + 1)) / (F.col("df") + 1)))
