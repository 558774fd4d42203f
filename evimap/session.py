"""Session settings and the two physical helpers every plan may need."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "evimap", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Nothing here is needed for right results; adaptive execution splits skewed
    joins and coalesces small shuffle partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the cluster names none (tests on one machine) a temporary
    folder is made and set.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    folder = configured or tempfile.mkdtemp(prefix="evimap-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


# An input below one file split is read by one task.
ONE_SPLIT = 128 * 1024 * 1024
UNKNOWN = 1 << 60  # the estimate of a source that has none


def estimated_bytes(df: DataFrame) -> int:
    """Size by the optimizer's statistics; plans the query, runs nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Give a narrow, CPU-heavy stage enough partitions.

    Only an input that would be a single task is redistributed, and a stream, whose
    micro-batches may be one file each; a large one already has many splits and is returned as it is.
    """
    if not df.isStreaming and estimated_bytes(df) > ONE_SPLIT:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


# What comes of a document in a task that sorts or groups its pairs takes hundreds of times the estimate of its packed source.
DEALT = 256 * 1024


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key``, into as many tasks as keep what comes of each small.

    Their number is fixed, since adaptive execution judges by the size of the rows alone.
    """
    if df.isStreaming:
        return spread(df)
    session, size = df.sparkSession, estimated_bytes(df)
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return df.repartition(tasks if size >= UNKNOWN else max(tasks, min(size // DEALT, 4096)), key)
