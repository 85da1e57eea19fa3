"""T8 over a stream of batches: a label dictionary that grows and never renumbers.

Labels that a batch brings for the first time get the next ids, in the order of
their names; ids given before stay.  The dictionary is a table in folders by version
(the batch that brought a label), at most as many rows as classes.  A replayed batch
reads only the versions before its own and overwrites its folder, so it changes
nothing.  ``dictionary_of_batches`` gives the same table for all batches in one
aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import write_table

SCHEMA = "name string, label int, version int"


def dictionary_of_batches(rows: DataFrame, col: str = "feature2", batch_col: str = "batch_no") -> DataFrame:
    """(name, label, version) of all labels; null labels are none."""
    first = rows.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("name")).agg(F.min(batch_col).alias("version"))
    # one row per class
    label = (F.row_number().over(Window.orderBy("version", "name")) - 1).cast("int")
    return first.select("name", label.alias("label"), F.col("version").cast("int").alias("version"))


def known_labels(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The dictionary at ``path``, or its versions before one."""
    table = spark.read.schema(SCHEMA).parquet(path)
    return table if before is None else table.where(F.col("version") < before)


def learn_labels(batch: DataFrame, path: str, version: int, col: str = "feature2") -> None:
    """Adds the new labels of a batch as a version; versions must come in order, or again."""
    spark = batch.sparkSession
    # the folder of an empty version makes the table readable before the first label
    write_table(spark.createDataFrame([], "name string, label int"), f"{path}/version=0")
    known = known_labels(spark, path, version)
    n_known = known.count()
    new = batch.select(F.col(col).alias("name")).where("name is not null").distinct().join(known, "name", "left_anti")
    label = F.row_number().over(Window.orderBy("name")) - 1 + n_known
    write_table(new.select("name", label.cast("int").alias("label")), f"{path}/version={version}")
