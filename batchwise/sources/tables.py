"""Reading the input tables and mapping them onto the email-row model.

The wire record of the reference has three nullable strings: ``feature0``
(first text part), ``feature1`` (second text part) and ``feature2`` (label).
Here the driver's ``documents`` table plays the email stream:
``feature0 = source``, ``feature1 = text`` and the label is derived from
``lang``.  Only the columns a task needs are selected, so the parquet scan
reads nothing else (column pruning reaches ``ReadSchema``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def language_label(lang: Column | str = "lang", mode: str = "binary") -> Column:
    """``binary``: 'en' vs 'other' (the main task); ``lang``: the language itself."""
    c = F.col(lang) if isinstance(lang, str) else lang
    if mode == "binary":
        return F.when(c == F.lit("en"), F.lit("en")).otherwise(F.lit("other"))
    if mode == "lang":
        return c
    raise ValueError(f"unknown label mode {mode!r}")


def email_rows(spark: SparkSession, sf_dir: str, label_mode: str = "binary") -> DataFrame:
    """``documents`` as email rows: (row_id, feature0, feature1, feature2)."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("feature0"),
        F.col("text").alias("feature1"),
        language_label("lang", label_mode).alias("feature2"),
    )


def labelled_email_rows(spark: SparkSession, sf_dir: str, target: str = "quality") -> DataFrame:
    """Second, unbalanced task: documents joined with ``labels`` on doc_id.

    ``labels`` covers a subset of the documents; the join is a plain equi-join
    (Catalyst broadcasts the label side when its measured size allows, and
    shuffles both sides on doc_id otherwise).
    """
    if target not in ("quality", "toxic"):
        raise ValueError(f"unknown target {target!r}")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", target)
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("feature0"),
        F.col("text").alias("feature1"),
        F.col(target).cast("string").alias("feature2"),
    )


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as dense rows: (row_id, vec array<double>, label int)."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("row_id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("vec"),
        F.col("label").cast("int").alias("label"),
    )
