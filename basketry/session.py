"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "basketry", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the plans count on.

    Skewed joins are split at run time even where that costs an extra shuffle; broadcasts stay
    under the optimizer's own size check, so no plan here carries a broadcast hint.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Recording a call site per expression costs more than building the plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="basketry-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path beside the checkpoints, which every executor can read and write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """Write a table several later steps read, and read it back.

    The copy lies in the shared checkpoint folder, so it survives lost executors, cuts the lineage of
    iterative jobs, lets later scans prune columns and tells the optimizer its true size.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Partitions of a table that ``repartition`` deals out; run-time coalescing leaves a given number alone."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
