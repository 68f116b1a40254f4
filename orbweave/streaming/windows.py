"""Event-time windows and as-of joins; the same plans run on batch and streaming frames where Spark allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, lateness: str) -> DataFrame:
    return df.withWatermark(time, lateness) if df.isStreaming else df


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], value: str, lateness: str = "10 minutes", slide: str | None = None) -> DataFrame:
    return _late(df, time, lateness).groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("v"))


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], lateness: str = "10 minutes") -> DataFrame:
    return _late(df, time, lateness).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the last right row at or before its time.

    Both sides are interleaved in one window per key, so work is one sort, not a range join. Ties: the right row counts as before.
    """
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_s"), F.struct(*columns).alias("_r"))
    l = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_s"), F.struct(*left.columns).alias("_l"))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    last = F.last("_r", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_t", "_s").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("_m", last).filter("_s = 1").select("_l.*", *(F.col(f"_m.{c}").alias(c) for c in columns))
