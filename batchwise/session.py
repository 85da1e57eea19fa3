"""Session helpers: building a local session for tests and finding the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

On a cluster the checkpoint folder is configured by the operator and must be
shared storage (HDFS, object store).  We only ever create our own folder when
the setting is unset, which is the case in local tests.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "batchwise") -> SparkSession:
    """A local session with the settings our tests and bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a private one only when unset.

    The value of ``spark.checkpoint.dir`` wins.  If the SparkContext already
    has a checkpoint folder (set by the application) that one is used.  Only
    when neither is present and the master is local (tests) a fresh folder is
    made; on a cluster an unset folder is an error, because executors would
    write to their own disks and read back a part.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get(CHECKPOINT_KEY, None)
    if not configured:
        try:
            configured = spark.conf.get(CHECKPOINT_KEY)
        except Exception:  # noqa: BLE001 - unset key raises in some versions
            configured = None
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="batchwise-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder.

    Used for written tables that cut lineage (model versions, replay tables,
    stream inputs).  Never a machine-local folder unless the session itself
    points there (tests).
    """
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/batchwise/{name}-{uuid.uuid4().hex[:12]}"
