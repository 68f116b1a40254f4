"""Segmentation evaluation: confusion matrices and their metrics, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, gt: str, pred: str, scene: str | None = None) -> DataFrame:
    """(scene, gt, pred, n); with a scene also the totals over all, as scene 'all', in one pass of grouping sets."""
    if scene is None:
        return df.groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    d = df.select(F.col(scene).cast("string").alias("scene"), F.col(gt).alias("gt"), F.col(pred).alias("pred"))
    sets = d.groupingSets([["scene", "gt", "pred"], ["gt", "pred"]], "scene", "gt", "pred").agg(F.count("*").alias("n"), F.grouping("scene").alias("_g"))
    return sets.withColumn("scene", F.when(F.col("_g") == 1, "all").otherwise(F.col("scene"))).drop("_g")


def class_metrics(conf: DataFrame, keys: list[str] = [], standard_f1: bool = False) -> DataFrame:  # noqa: B006
    """Per class of the ground truth: IoU, precision, recall with denominators of at least 1; F1 = 2PR / max(1, P + R),
    or the usual one where ``standard_f1``."""
    gt = conf.groupBy(*keys, F.col("gt").alias("class")).agg(F.sum("n").alias("_gt"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    pr = conf.groupBy(*keys, F.col("pred").alias("class")).agg(F.sum("n").alias("_pr"))
    m = gt.join(pr, [*keys, "class"], "left").na.fill({"_pr": 0})
    at_least_1 = lambda c: F.greatest(c.cast("double"), F.lit(1.0))
    m = m.withColumns({
        "iou": F.col("tp") / at_least_1(F.col("_gt") + F.col("_pr") - F.col("tp")), "precision": F.col("tp") / at_least_1(F.col("_pr")), "recall": F.col("tp") / at_least_1(F.col("_gt")),
    })
    s = F.col("precision") + F.col("recall")
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(s, F.lit(0.0)), F.lit(0.0)) if standard_f1 else 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1.0), s)
    return m.withColumns({"f1": f1, "support": F.col("_gt")}).drop("_gt", "_pr")


def summary(metrics: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean IoU, IoU weighted by frequency, and how many classes exceed 0.15, 0.25, 0.5 and 0.75."""
    over = lambda t: F.sum(F.when(F.col("iou") > t, 1).otherwise(0))
    return metrics.groupBy(*keys).agg(
        F.avg("iou").alias("miou"), (F.sum(F.col("iou") * F.col("support")) / F.sum("support")).alias("fmiou"), F.count("*").alias("classes"),
        over(0.15).alias("acc_15"), over(0.25).alias("acc_25"), over(0.5).alias("acc_50"), over(0.75).alias("acc_75"), F.avg("recall").alias("macc"),
    )


def zero_shot(features: DataFrame, classes: DataFrame, row: str, cls: str, feature: str, class_feature: str, ignored: list[int] = []) -> DataFrame:  # noqa: B006
    """(row, class, similarity): the most similar class, the smaller of equals; ignored classes can't win.
    The class matrix is broadcast after its size is checked."""
    from ..functions.vectors import cosine
    from ..storage import checked

    c = checked(classes.filter(~F.col(cls).isin(ignored)) if ignored else classes, 8192)
    s = features.crossJoin(c).select(row, cls, cosine(F.col(feature), F.col(class_feature)).alias("similarity"))
    return s.groupBy(row).agg(F.max(F.struct("similarity", (-F.col(cls)).alias("_c"))).alias("_m")).select(row, (-F.col("_m._c")).alias(cls), F.col("_m.similarity").alias("similarity"))
