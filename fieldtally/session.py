"""Session settings shared by the jobs, the benchmark and the tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that hold on a cluster as well as on one machine. Sizes of partitions and
# broadcast sides are left to adaptive execution, which sees the real sizes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # a stack capture per column expression costs more than building most plans
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "fieldtally", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the library's defaults; `master` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and return it with a fresh plan.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A folder of our
    own is set only in a local session without one; on a cluster executors could not see it,
    so that the setting is required there.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="fieldtally-ckpt-"))
    return df.checkpoint(eager=True)
