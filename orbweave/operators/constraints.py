"""Validation as counted violations, keys of caches and manifests, joins that must be complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Violation(ValueError):
    """A table breaks a rule."""


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule (false or null), all in one pass."""
    bad = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()))
    return bad.select(F.explode(F.map_from_arrays(F.array(*(F.lit(n) for n in rules)), F.array(*rules))).alias("rule", "n"))


def enforce(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The frame itself, or Violation naming broken rules and their counts."""
    broken = violations(df, rules).filter("n > 0").collect()
    if broken:
        raise Violation(", ".join(f"{r.rule}: {r.n}" for r in broken))
    return df


def exclusive(df: DataFrame, item: str) -> DataFrame:
    """The frame, or Violation if an item has several owners."""
    if not df.groupBy(item).count().filter("count > 1").isEmpty():
        raise Violation(f"{item} is not mutually exclusive")
    return df


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side alone: (key, side)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def join_complete(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join by explicit key whose two sides must have the same, unique keys."""
    if not missing(left, right, key).isEmpty():
        raise Violation(f"{key} differs between the two sides")
    for side in (left, right):
        if not side.groupBy(key).count().filter("count > 1").isEmpty():
            raise Violation(f"{key} is repeated")
    return left.join(right, key)


def cache_hits(requests: DataFrame, cache: DataFrame, key: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses) of requests that equal a cached one in every key column; nulls are equal."""
    digest = F.sha2(F.to_json(F.struct(*sorted(key)), {"ignoreNullFields": "false"}), 256)
    r = requests.withColumn("_sha", digest)
    c = cache.withColumn("_sha", digest).dropDuplicates(["_sha"]).select("_sha", *columns)
    return r.join(c, "_sha").drop("_sha"), r.join(c, "_sha", "left_anti").drop("_sha")


def stale_stages(wanted: DataFrame, markers: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Stages without a complete marker of the same fingerprint."""
    return wanted.join(markers.filter("status = 'complete'").select(key, fingerprint), [key, fingerprint], "left_anti")


def window_matches(frames: DataFrame, expected: list[int], column: str) -> bool:
    """Whether the sorted values are exactly those expected."""
    got = frames.agg(F.array_sort(F.collect_list(column)).alias("x")).first()["x"]
    return list(got or []) == list(expected)


def progress(requests: DataFrame, state: str) -> DataFrame:
    """Counts of a request table by state, and whether all are done."""
    return requests.agg(F.count("*").alias("requests"), F.count_if(F.col(state) == "hit").alias("hits"), F.count_if(F.col(state) == "pending").alias("pending")).withColumn("status", F.when(F.col("pending") == 0, "complete").otherwise("running"))


def probabilities(df: DataFrame) -> dict[str, Column]:
    """Rules of a probability sidecar (mean, max, observations)."""
    unit = lambda c: (F.col(c) >= 0) & (F.col(c) <= 1)
    return {"mean_in_unit": unit("mean"), "max_in_unit": unit("max"), "mean_below_max": F.col("mean") <= F.col("max"), "observations": F.col("observations") >= 0}


def map_rules() -> dict[str, Column]:
    """Rules of an object table with geometry_type, point_count and bbox (null where there is none)."""
    solid = F.col("geometry_type") == "colmap_3d"
    return {
        "geometry_type": F.col("geometry_type").isin("colmap_3d", "multiview_2d"),
        "points_match_type": F.when(solid, F.col("point_count") > 0).otherwise(F.col("point_count") == 0),
        "bbox_matches_type": F.when(solid, F.col("bbox").isNotNull()).otherwise(F.col("bbox").isNull()),
        "object_id": F.col("object_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"),
    }


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def saved_map_rules(dimension: int = 512) -> dict[str, Column]:
    """Rules of a saved map's objects: points and colors (arrays of triples), bbox_points, geometry_type (null: told by the points), clip_ft,
    text_ft, num_detections and as many color_path, mask_area, xyxy, conf, class_name and class_id."""
    kind = F.coalesce("geometry_type", F.when(F.size("points") > 0, "colmap_3d").otherwise("multiview_2d"))
    triples = lambda c: F.col(c).isNotNull() & F.forall(c, lambda p: (F.size(p) == 3) & F.forall(p, finite))
    feature = lambda c: F.col(c).isNotNull() & (F.size(c) == dimension) & F.forall(c, lambda v: finite(v.cast("double"))) & F.exists(c, lambda v: F.abs(v) > 1e-12)
    n = F.col("num_detections")
    lists = ("color_path", "mask_area", "xyxy", "conf", "class_name", "class_id")
    return {
        "points": triples("points"), "geometry_type": kind.isin("colmap_3d", "multiview_2d"), "points_match_type": (kind == "colmap_3d") == (F.size("points") > 0),
        "colors": triples("colors") & (F.size("colors") == F.size("points")) & F.forall("colors", lambda p: F.forall(p, lambda v: (v >= 0) & (v <= 1))),
        "bbox": triples("bbox_points") & (F.size("bbox_points") == F.when(kind == "colmap_3d", 8).otherwise(0)),
        "clip_ft": feature("clip_ft"), "text_ft": feature("text_ft"), "num_detections": n > 0, **{f"{c}_length": F.size(c) == n for c in lists},
        "mask_filled": F.forall("mask_area", lambda a: a > 0), "boxes": F.forall("xyxy", lambda b: (F.size(b) == 4) & F.forall(b, finite) & (b[2] > b[0]) & (b[3] > b[1])),
        "confidence": F.forall("conf", finite), "class_name_filled": F.forall("class_name", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""),
    }


def conversion_pair_rules() -> dict[str, Column]:
    """Rules of a map joined with its conversion report (report_... columns; a map without a report has nulls there)."""
    same = lambda a, b: F.col(a).isNotNull() & (F.col(a) == F.col(b))
    return {
        "report": F.col("report_status").isNotNull(), "converted": F.col("report_status") == "converted", "map_path": same("report_map", "map_path"), "report_path": same("report_self", "report_path"),
        "sha256": same("report_sha256", "sha256"), "fingerprint": F.col("report_fingerprint").eqNullSafe(F.col("fingerprint")), "input_sha256": F.col("report_input_sha256").eqNullSafe(F.col("input_sha256")),
    }


def frame_score_problems(scores: DataFrame, aliases: DataFrame, root: str) -> DataFrame:
    """(object_id, raw_frame_id, problem) of frame scores (object_id, raw_frame_id, mask, mask_area, projected_points, visible_points, hit_points): frames that
    no alias (alias, frame_id) names or that two do, negative counts, masks at another path than ``root/masks/2d/object/frame.png``. Absent fields are fine."""
    s = scores.join(aliases.withColumnRenamed("alias", "raw_frame_id"), "raw_frame_id", "left")
    s = s.withColumn("_n", F.count("*").over(W.partitionBy("object_id", "frame_id")))
    checks = [F.when(F.col("frame_id").isNull(), "unknown_frame"), F.when(F.col("frame_id").isNotNull() & (F.col("_n") > 1), "duplicate_frame")]
    checks += [F.when(F.col(c) < 0, f"negative_{c}") for c in ("mask_area", "projected_points", "visible_points", "hit_points")]
    checks.append(F.when(F.col("mask") != F.concat(F.lit(f"{root}/masks/2d/"), "object_id", F.lit("/"), "frame_id", F.lit(".png")), "other_mask"))
    return s.select("object_id", "raw_frame_id", F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("problem"))


def project_problems(objects: DataFrame, owned: DataFrame, labels: DataFrame, masks: DataFrame, points: int) -> DataFrame:
    """(object_id, problem) of a project: objects (object_id, num_points, num_masks), owned points (object_id, point_id), labels and masks (object_id, frame_id)."""
    n = owned.groupBy("object_id").agg(F.count("*").alias("_n"), F.count_distinct("point_id").alias("_u"), F.count_if((F.col("point_id") < 0) | (F.col("point_id") >= points)).alias("_out"))
    shared = owned.select("object_id", "point_id").distinct().withColumn("_c", F.count("*").over(W.partitionBy("point_id"))).filter("_c > 1").select("object_id").distinct().withColumn("_s", F.lit(True))
    m = masks.groupBy("object_id").agg(F.count_distinct("frame_id").alias("_m"))
    o = objects.join(n, "object_id", "left").join(m, "object_id", "left").join(shared, "object_id", "left").join(labels.select("object_id").distinct().withColumn("_l", F.lit(True)), "object_id", "left").na.fill(0, ["_n", "_u", "_out", "_m"])
    checks = {"no_label": F.col("_l").isNull(), "point_count": F.col("num_points") != F.col("_n"), "repeated_points": F.col("_n") != F.col("_u"), "points_out_of_range": F.col("_out") > 0, "shared_points": F.col("_s").isNotNull(), "mask_count": F.col("num_masks") != F.col("_m")}
    found = o.select("object_id", F.explode(F.filter(F.array(*(F.when(c, n) for n, c in checks.items())), lambda c: c.isNotNull())).alias("problem"))
    strange = masks.select("object_id").distinct().join(objects, "object_id", "left_anti").withColumn("problem", F.lit("masks_of_no_object"))
    return found.unionByName(strange)


def frame_rules() -> dict[str, Column]:
    """Rules of a frames manifest once ``previous`` holds the source index before."""
    return {"digits": F.col("frame_id").rlike(r"^\d+$"), "size": (F.col("width") > 0) & (F.col("height") > 0), "increasing": F.coalesce(F.col("source_frame_index") > F.col("previous"), F.lit(True))}
