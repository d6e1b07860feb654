"""Session helpers: local session for tests and benches, durable materialisation.

A note for all modules: arrays that cost something to make are unnested with ``explode_outer`` and a
null filter. From a plain ``explode`` the optimizer infers ``size(array) > 0`` and pushes it below
shuffles into the scan, where the whole array would be made a second time.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, app: str = "wayweft") -> SparkSession:
    """A single-machine session; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Call-site tracking costs several driver round trips per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="wayweft-ckpt-")
    sc.setCheckpointDir(shared)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage in reliable storage, so losing an executor does not replay the loop so far.

    The checkpoint keeps the partitioning of ``df``: checkpoint after ``repartition(key)`` and
    later joins on ``key`` shuffle only their other side.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a scan has fewer splits than the session has cores, else unchanged.

    For the inputs of heavy per-row text work: a few large row groups would leave most cores idle.
    On a large table the scan has splits enough and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


SMALL_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Mark a stored, narrow frame for broadcast when it has at most ``rows`` rows, else leave it.

    Beyond the bound the join shuffles, with skewed keys split at run time.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
