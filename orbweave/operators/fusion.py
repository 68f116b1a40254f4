"""Sparse-cloud fusion: points gather votes from masks in frames, each point goes to one owner; distributed density clusters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import poses as P
from . import blocks
from . import points as PT


def project_visible(points: DataFrame, cameras: DataFrame, scene: list[str], tolerance: float = 0.05, relative: float = 0.03) -> DataFrame:
    """(scene, frame_id, point_id, u, v, z): points that fall into the image and are no further than the nearest point of
    their pixel by more than max(tolerance, relative * nearest). Cameras of a scene are broadcast after a size check."""
    from ..storage import checked

    c = checked(cameras, 512)
    j = points.join(c, scene) if scene else points.crossJoin(c)
    xyz = P.apply(F.col("extrinsic"), F.col("x"), F.col("y"), F.col("z"))
    j = j.select(*scene, "frame_id", "point_id", "w", "h", "fx", "fy", "cx", "cy", *(v.alias(n) for v, n in zip(xyz, ("_x", "_y", "_z")))).filter("_z > 0")
    u, v = F.floor(F.col("_x") * F.col("fx") / F.col("_z") + F.col("cx")), F.floor(F.col("_y") * F.col("fy") / F.col("_z") + F.col("cy"))
    inside = j.withColumns({"u": u.cast("int"), "v": v.cast("int")}).filter((F.col("u") >= 0) & (F.col("u") < F.col("w")) & (F.col("v") >= 0) & (F.col("v") < F.col("h")))
    near = F.min("_z").over(W.partitionBy(*scene, "frame_id", "u", "v"))
    return inside.withColumn("_n", near).filter(F.col("_z") <= F.col("_n") + F.greatest(F.lit(tolerance), F.col("_n") * relative)).select(*scene, "frame_id", "point_id", "u", "v", F.col("_z").alias("z"))


def votes(visible: DataFrame, runs: DataFrame, scene: list[str]) -> DataFrame:
    """(scene, object_id, point_id, votes, seen): frames in which a point lies in an object's mask, of those that see it and the mask."""
    r = runs.select(*scene, "frame_id", F.col("y").alias("v"), "x0", "x1", "object_id")
    hit = visible.join(r, [*scene, "frame_id", "v"]).filter((F.col("u") >= F.col("x0")) & (F.col("u") < F.col("x1"))).groupBy(*scene, "object_id", "point_id").agg(F.count_distinct("frame_id").alias("votes"))
    shown = visible.join(runs.select(*scene, "frame_id", "object_id").distinct(), [*scene, "frame_id"]).groupBy(*scene, "object_id", "point_id").agg(F.count("*").alias("seen"))
    return hit.join(shown, [*scene, "object_id", "point_id"])


def exclusive_owners(voted: DataFrame, objects: DataFrame, scene: list[str], min_votes: int = 1) -> DataFrame:
    """(scene, point_id, object_id): each point's owner by priority, share of votes, votes, fewer points of the object, id."""
    enough = voted.filter(F.col("votes") >= min_votes)
    size = enough.groupBy(*scene, "object_id").agg(F.count("*").alias("_n"))
    d = enough.join(size, [*scene, "object_id"]).join(objects.select(*scene, "object_id", "priority"), [*scene, "object_id"]).withColumn("_p", F.col("votes") / F.col("seen"))
    order = [F.desc("priority"), F.desc("_p"), F.desc("votes"), F.asc("_n"), F.asc("object_id")]
    return d.withColumn("_r", F.row_number().over(W.partitionBy(*scene, "point_id").orderBy(*order))).filter("_r = 1").select(*scene, "point_id", "object_id", "votes")


def density_clusters(points: DataFrame, obj: str, point: str, eps: float, min_points: int) -> DataFrame:
    """(obj, point, cluster): density clusters; noise is left out.

    Points with enough others within eps (themselves included) are cores; cores within eps of each other are connected; other points join the
    smallest cluster of a core near them. An object's points lie in one task, those of many objects together; no pair leaves the kernel.
    """
    d = points.select(obj, point, *PT.AXES)

    def clusters(t: pa.Table, head) -> pa.Table:
        label = PT._labels(t, head, eps, min_points)
        some = label >= 0
        ids = t[point].combine_chunks()
        return pa.Table.from_arrays([t[obj].filter(pa.array(some)), ids.filter(pa.array(some)), ids.take(pa.array(label[some]))], names=[obj, point, "cluster"])

    kind = {f.name: f.dataType.simpleString() for f in d.schema}
    return blocks.by_key(d, [obj], [point], clusters, f"{obj} {kind[obj]}, {point} {kind[point]}, cluster {kind[point]}")
