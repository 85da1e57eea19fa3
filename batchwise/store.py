"""Written tables in the shared checkpoint folder.

Long job chains (one model version per batch) must not grow their lineage,
and executors may be lost at any time.  Every intermediate that later stages
re-read is therefore written as parquet under ``spark.checkpoint.dir`` and
read back: the re-read plan starts at a file scan, recomputation after a lost
executor re-reads files instead of replaying the chain, and partitioned
tables give partition pruning on ``batch_no``.

Once a table is written nobody reads the shuffles that led to it, so Spark is
told to delete their files as each write ends; else they would lie on the
executors' disks until the driver happens to collect its garbage, and a chain of
writes would hold the shuffles of all its steps.
"""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .session import scratch_path

CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes: Counter = Counter()        # writes under way, by session
_before: dict[str, str] = {}
_lock = threading.Lock()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files as they end; the session's own setting is put back with the last of them."""
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        if not _writes[session]:
            _before[session] = spark.conf.get(CLEANUP_KEY, "false")
            spark.conf.set(CLEANUP_KEY, "true")
        _writes[session] += 1
    try:
        yield
    finally:
        with _lock:
            _writes[session] -= 1
            if not _writes[session]:
                del _writes[session]
                spark.conf.set(CLEANUP_KEY, _before.pop(session))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Write ``df`` to ``path``, by default a fresh one in the checkpoint folder, and read it back."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    write_table(df, path, partition_by)
    # the schema is known: no inference pass over the written files
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize``, once all that was made from them is itself written."""
    for table in tables:
        drop_path(table.sparkSession, table.scratch)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more (a missing one is no error)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
