"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A frame whose optimiser size estimate is below this is small enough to ship
# to every executor; anything larger takes a shuffle join.
BROADCAST_LIMIT = 64 * 1024 * 1024


def build_session(app: str = "candlewick", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    ``master`` and ``shuffle_partitions`` are only set when given, so that a
    cluster keeps the values of its own deployment.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # panels are small in bytes and heavy in computation: when AQE merges
        # partitions it should still leave a task per core
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, from ``spark.checkpoint.dir``.

    Where the deployment has not named one and Spark runs in one process
    (tests), a scratch folder is used; on a cluster that would be wrong, so it
    is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="candlewick-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Compute a frame once: written to the shared folder as Parquet, read back.

    For frames several branches of a plan need.  The files survive the loss of
    executors, and each branch reads only its columns.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame, without running it."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``broadcast(df)`` if its estimate is under ``limit``, else ``df`` as is.

    Beyond the limit the join is left to the optimiser (shuffle join, with AQE
    splitting skewed partitions).
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if estimated_bytes(df) <= limit else df

