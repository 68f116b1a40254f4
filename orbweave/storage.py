"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest counted build side, in bytes, that is broadcast; beyond it a join is shuffled.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    at = "file://" + tempfile.mkdtemp(prefix="orbweave-")
    spark.conf.set("spark.checkpoint.dir", at)
    spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/orbweave/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a step of an iteration and read it back, so that lineage stays short and a lost executor costs no earlier step."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """The frame with a broadcast hint if its counted rows fit the limit, else as it is. Give it a cheap-to-count frame."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
