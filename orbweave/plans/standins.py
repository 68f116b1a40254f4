"""Detections, points, tracks and features read from the relational tables. The CTEs of the registry say the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def detections(spark: SparkSession, d: str, scenes: int = 0) -> DataFrame:
    """``scenes``: so many, a column more; the rows of a scene's frame are put in one task, so that no grouping or joining by both shuffles them again."""
    li, more = table(spark, d, "lineitem"), []
    if scenes:
        li, more = li.withColumn("scene", F.col("l_orderkey") % scenes).repartition("scene", "l_orderkey"), ["scene"]
    g = li.groupBy(*more, "l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("obj"), F.min("l_quantity").alias("q"), F.min(100 * F.col("l_discount")).alias("y1"), F.min(100 * F.col("l_tax")).alias("t"), F.min("l_discount").alias("dc"))
    part = F.col("l_partkey")
    return g.select(
        *more, F.col("l_orderkey").alias("frame"), (F.col("l_linenumber") * 1000000 + part).alias("idx"), (part % 20).alias("class_id"), "obj", F.col("q").alias("x1"), "y1",
        (F.col("q") + 1 + F.col("t")).alias("x2"), (F.col("y1") + 1 + part % 7).alias("y2"), (1 - F.col("dc")).alias("conf"),
    )


def points(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    y, z = F.round(100 * F.col("l_discount")), F.round(100 * F.col("l_tax"))
    return li.select(F.col("l_suppkey").alias("obj"), (F.col("l_quantity") * 10000 + y * 100 + z).cast("bigint").alias("pid"), F.col("l_quantity").alias("x"), y.alias("y"), z.alias("z")).distinct()


def object_boxes(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("obj")
    g = points(spark, d).groupBy("obj").agg(*(f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"), F.count("*").alias("n"))
    return g.select("obj", (F.col("min_x") + o % 7).alias("min_x"), (F.col("min_y") + o % 5).alias("min_y"), "min_z", (F.col("max_x") - o % 9).alias("max_x"), "max_y", (F.col("max_z") - o % 3).alias("max_z"), "n")


def days(spark: SparkSession, d: str) -> DataFrame:
    """Tracks: a user's values on a day as an interval [lo, hi)."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("track"), F.day("ts").cast("bigint").alias("frame")).agg(
        F.floor(F.min("value")).cast("double").alias("lo"), (F.floor(F.max("value")) + 1).cast("double").alias("hi"), F.count("*").alias("n"), F.max("value").alias("best")
    )


def day_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = days(spark, d)
    a = x.select(F.col("track").alias("a"), "frame", F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = x.select(F.col("track").alias("b"), "frame", F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    inter = F.greatest(F.lit(0.0), F.least("ahi", "bhi") - F.greatest("alo", "blo"))
    return a.join(b, "frame").filter("a < b").select(F.lit(0).alias("scene"), "a", "b", "frame", (F.col("ahi") - F.col("alo")).alias("area_a"), (F.col("bhi") - F.col("blo")).alias("area_b"), inter.alias("inter"))


def tracks(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.tracks import area_stats

    x = days(spark, d).select(F.lit(0).alias("scene"), "track", (F.col("hi") - F.col("lo")).alias("area"))
    return area_stats(x, ["scene", "track"]).withColumn("label", F.col("track") % 3)


def centroids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("x")).select("label", F.col("x.m").alias("c"))
