"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app_name: str = "querylens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with a UTC session zone and adaptive execution; everything else is the cluster's choice."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to this machine's temporary folder: on a
    cluster the executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="querylens-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back, so that several results can share the work.

    A written table survives lost executors and lets every reader prune columns.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_if_small(staged: DataFrame, row_bytes: int, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a staged table whose counted rows stay below the limit; otherwise leave the join to Spark.

    Past the limit the big side is shuffled, and adaptive execution splits the partitions of hot keys.
    """
    return F.broadcast(staged) if staged.count() * row_bytes <= limit_bytes else staged
