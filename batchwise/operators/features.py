"""Feature rows (T6, T7, T10) and the label dictionary.

Layout
------
*Row table*: one row per email, ``(row_id, <keep cols>, features, n_tokens,
nnz, norm)`` where ``features`` is the sorted ``array<struct<bucket, cnt>>``
of the row's hashed token counts.

*Long table*: ``(row_id, <keep cols>, bucket, x)`` with ``x = cnt / norm``
(unit Euclidean length per row).  It comes from the row table by an
``explode_outer``, which is partition-local, so a later group-by on
``row_id`` aggregates inside the task before any shuffle.  A row without
tokens keeps one line with a null bucket, so it is still scored (prior only)
and still counted as a document.

Building the row table moves nothing: a row's tokens are in one task already,
and its buckets are sorted and counted inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_N_FEATURES, bucket_of, tokenize

FEATURE_TYPE = "array<struct<bucket:int,cnt:bigint>>"


def hashed_rows(df: DataFrame, text: Column | str, keep: Sequence[str] = (), row_id: str = "row_id",
                n_features: int = DEFAULT_N_FEATURES, hash_name: str = "md5") -> DataFrame:
    """T5 + T6 + T7 inputs: per-row sorted (bucket, count) pairs and the L2 norm."""
    text_col = F.col(text) if isinstance(text, str) else text
    keys = [row_id, *keep]
    # a row's tokens are in one task already: its buckets are sorted there and each run becomes a (bucket, count)
    buckets = F.sort_array(F.transform(F.coalesce(tokenize(text_col), F.array().cast("array<string>")),
                                       lambda t: bucket_of(t, n_features, hash_name)))
    rows = df.select(*keys, buckets.alias("_b")).withColumn("n_tokens", F.size("_b").cast("long"))
    places = F.when(F.col("n_tokens") > 0, F.sequence(F.lit(0), F.size("_b") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(F.col("_b"), i) != F.get(F.col("_b"), i - 1)))
    rows = rows.withColumn("_s", starts)
    ends = F.concat(F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), F.array(F.size("_b")))
    runs = F.zip_with("_s", F.slice(ends, 1, F.size("_s")), lambda s, e: F.struct(
        F.get(F.col("_b"), s).alias("bucket"), (e - s).alias("cnt")))
    rows = rows.withColumn("features", runs.cast(FEATURE_TYPE))
    rows = rows.select(
        *keys, "features", "n_tokens", F.size("features").cast("long").alias("nnz"),
        F.aggregate("features", F.lit(0).cast("long"), lambda a, f: a + f["cnt"] * f["cnt"]).cast("double").alias("_ss"))
    # sum_x = sum of the scaled values, sq_x = their squared length (1, or 0 for an empty row)
    return rows.withColumns({
        "norm": F.sqrt("_ss"),
        "sum_x": F.when(F.col("nnz") > 0, F.col("n_tokens") / F.sqrt("_ss")).otherwise(F.lit(0.0)),
        "sq_x": F.when(F.col("nnz") > 0, F.col("_ss") / F.col("_ss")).otherwise(F.lit(0.0)),
    }).drop("_ss")


def dense_rows(df: DataFrame, vec: str = "vec", keep: Sequence[str] = (), row_id: str = "row_id") -> DataFrame:
    """Dense vectors (embeddings) in the row-table layout; ``bucket`` = array position.

    Values are used as they are (not re-scaled): ``norm`` is set to 1 so that
    ``x = cnt / norm`` is the raw value.
    """
    feats = F.transform(F.col(vec), lambda v, i: F.struct(i.cast("int").alias("bucket"), v.alias("cnt")))
    return df.select(row_id, *keep, feats.alias("features"), F.size(vec).cast("long").alias("nnz"),
                     F.lit(1.0).alias("norm"),
                     F.aggregate(vec, F.lit(0.0), lambda a, v: a + v).alias("sum_x"),
                     F.aggregate(vec, F.lit(0.0), lambda a, v: a + v * v).alias("sq_x"))


def long_features(rows: DataFrame, keep: Sequence[str] = (), row_id: str = "row_id") -> DataFrame:
    """(row_id, keep..., bucket, x) with x = cnt / norm; empty rows keep a null bucket."""
    return rows.select(row_id, *keep, "norm", F.explode_outer("features").alias("_f")).select(
        row_id, *keep, F.col("_f.bucket").alias("bucket"),
        (F.col("_f.cnt").cast("double") / F.col("norm")).alias("x"))


# --------------------------------------------------------------------------- labels

def class_values(df: DataFrame, col: str = "feature2") -> list[str]:
    """T9 on the driver: the sorted distinct labels (a class list, k values)."""
    return [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]


def class_list(df: DataFrame, col: str = "feature2") -> DataFrame:
    """Distinct labels present."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def label_dictionary(df: DataFrame, col: str = "feature2") -> DataFrame:
    """T8 as a table: sorted distinct label -> 0..k-1 (k rows)."""
    from pyspark.sql import Window

    distinct = class_list(df, col)
    return distinct.withColumn("label", (F.row_number().over(Window.orderBy(col)) - 1).cast("int"))


def encode_labels(df: DataFrame, classes: Sequence[str], col: str = "feature2", out: str = "label") -> DataFrame:
    """Map each label to its index in the (sorted) class list; unknown -> null.

    The dictionary is tiny (k entries), so it is a literal CASE expression:
    no join, no shuffle.
    """
    expr = None
    for i, value in enumerate(classes):
        cond = F.col(col) == F.lit(value)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    if expr is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    return df.withColumn(out, expr.otherwise(F.lit(None)).cast("int"))


# --------------------------------------------------------------------------- vectors

def assemble_vectors(rows: DataFrame, n_features: int = DEFAULT_N_FEATURES, row_id: str = "row_id",
                     keep: Sequence[str] = ()) -> DataFrame:
    """The row table as sparse vectors in native columns: (row_id, keep..., size,
    indices array<int>, values array<double>), values scaled to unit length.

    An empty row has two empty arrays.
    """
    return rows.select(
        row_id, *keep, F.lit(n_features).alias("size"),
        F.transform("features", lambda f: f["bucket"]).alias("indices"),
        F.transform("features", lambda f: f["cnt"].cast("double") / F.col("norm")).alias("values"))


def hashing_tf_vectors(df: DataFrame, tokens: str, n_features: int = DEFAULT_N_FEATURES,
                       keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """X4 / T10 twin: MLlib ``HashingTF`` (Murmur3 on UTF-8) + ``Normalizer(p=2)``, JVM-side."""
    from pyspark.ml.feature import HashingTF, Normalizer

    tf = HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=n_features)
    norm = Normalizer(inputCol="_tf", outputCol="features", p=2.0)
    return norm.transform(tf.transform(df.select(*keep, tokens))).select(*keep, "features")
