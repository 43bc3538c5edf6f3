"""Session helpers: one place that configures Spark for this library.

On a cluster the session is created by the platform; :func:`prepare` only
fills in settings that are still unset (checkpoint folder, Arrow batch size),
so cluster-wide values always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Python workers receive whole source files; keep Arrow batches small so one
# batch of large files cannot exhaust a worker.
ARROW_BATCH_ROWS = "256"


def build_local(app: str = "codestrata", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Fill in settings this library relies on, only where they are unset."""
    conf = spark.conf
    if conf.get("spark.sql.session.timeZone", None) is None:
        conf.set("spark.sql.session.timeZone", "UTC")
    # Arrow batches feed whole source files to Python workers: the stock
    # 10 000 rows per batch can hold gigabytes of text, so lower it unless the
    # session chose its own value.
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's value is used as is. Only in a local session without one
    (tests) a scratch folder is made: on a cluster it would be the driver's
    own, so there it is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="codestrata-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
