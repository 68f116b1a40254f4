"""Choice of views, ranks and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import checked, materialize


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """The frame with its 0-based rank in a total order, without gathering it in one task: a range-partitioned sort numbers the rows
    within its partitions, and the partitions' counts give their bases by prefix sums (one row per partition)."""
    numbered = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_m", 33)
    counts = numbered.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    base = counts.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return numbered.withColumn("_p", part).join(checked(base), "_p").withColumn(name, F.col("_base") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_base")


def best_per(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def caption_views(views: DataFrame, obj: list[str], image: str, order: str, idx: str, quality: str, k: int = 4) -> DataFrame:
    """The best view of each image, images split into ``k`` bins in time (the first bins take the rest), the best of each bin."""
    one = best_per(views, [*obj, image], F.desc(quality), F.asc(idx))
    binned = one.withColumn("bin", F.ntile(k).over(W.partitionBy(*obj).orderBy(order, idx)))
    return best_per(binned, [*obj, "bin"], F.desc(quality), F.asc(order), F.asc(idx))


def uniform_positions(df: DataFrame, keys: list[str], order: list[str], m: int) -> DataFrame:
    """``m`` rows per key (all, if fewer) at positions round-half-even(i * (n - 1) / (m - 1)); repeats count once."""
    w = W.partitionBy(*keys)
    d = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    hit = F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max(1, m - 1)))).cast("long")), F.col("_i").cast("long"))
    return d.filter((F.col("_n") <= m) | hit).drop("_i", "_n")


def mask_index(df: DataFrame, frame: list[str], obj: str) -> DataFrame:
    return df.withColumn("mask_index", F.dense_rank().over(W.partitionBy(*frame).orderBy(obj)) - 1)


def class_index(df: DataFrame, name: str) -> DataFrame:
    """(name, class_id): rank among the sorted distinct names. The window holds the vocabulary, not the data."""
    return df.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("class_id", F.dense_rank().over(W.orderBy(name)) - 1)


def minmax_softmax(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Min-max scaled value and softmax over each key."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    d = df.withColumns({"scaled": F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0), "_e": F.exp(F.col(value) - hi)})
    return d.withColumn("probability", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def path_length(df: DataFrame, keys: list[str], order: str, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Length of the line through consecutive positions."""
    w = W.partitionBy(*keys).orderBy(order)
    d = [F.lead(c).over(w) - F.col(c) for c in xyz]
    return df.withColumn("_s", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).groupBy(*keys).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("length"))


def newest(df: DataFrame, keys: list[str], path: str, time: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(path, F.struct(time, path)).alias(path))


def frame_slice(frames: DataFrame, keys: list[str], order: str, start: int, end: int, stride: int = 1) -> DataFrame:
    """[start:end:stride] of each scene's frames (end -1: all), with their index."""
    if start < 0 or (end != -1 and end <= start):
        raise ValueError("need start >= 0 and end > start (or -1)")
    i = F.col("frame_idx")
    d = frames.withColumn("frame_idx", F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1)
    return d.filter((i >= start) & (F.lit(end == -1) | (i < end)) & ((i - start) % stride == 0))
