"""Filters and projections of detections, objects and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BACKGROUND, DetectionFilter, ObjectFilter
from ..functions.text import normalize_label


def filter_detections(dets: DataFrame, area: Column, box_area: Column, image_area: Column, background: Column, conf: Column | None, cfg: DetectionFilter = DetectionFilter()) -> DataFrame:
    """Drop small masks, background (if asked), oversized foreground boxes and low confidence; thresholds themselves pass."""
    keep = area >= max(cfg.mask_area, cfg.mask_area_floor)
    if cfg.skip_background:
        keep = keep & ~background
    keep = keep & (background | (box_area <= image_area * cfg.max_box_ratio))
    if conf is not None:
        keep = keep & (conf.isNull() | (conf >= cfg.confidence))
    return dets.filter(keep)


def resize_boxes(dets: DataFrame, sx: Column, sy: Column) -> DataFrame:
    """Boxes scaled to the image, rounded half to even; every row is kept."""
    return dets.withColumns({c: F.bround(F.col(c) * k).cast("int") for c, k in (("x1", sx), ("y1", sy), ("x2", sx), ("y2", sy))})


def filter_objects(objects: DataFrame, points: Column, detections: Column, cfg: ObjectFilter = ObjectFilter()) -> DataFrame:
    return objects.filter((points >= cfg.min_points) & (detections >= cfg.min_detections))


def has_support(points: Column, volume: Column, cfg: DetectionFilter = DetectionFilter()) -> Column:
    """Enough points and a box of some volume."""
    return (points >= max(cfg.min_points, cfg.min_points_floor)) & (volume >= cfg.min_volume)


def is_background(*labels: Column, names: tuple[str, ...] = BACKGROUND) -> Column:
    """Whether any of the normalised labels is a background class."""
    return F.arrays_overlap(F.array(*(normalize_label(c) for c in labels)), F.array(*(F.lit(n) for n in names)))


def acceptance_reasons(views: Column, caption_views: Column, background: Column, flat: Column) -> Column:
    """Why an object is rejected: an empty array accepts it."""
    need = F.when(background, 1).otherwise(2)
    return F.filter(
        F.array(
            F.when(views <= 0, F.lit("no_nonempty_2d_masks")),
            F.when(flat & (views < 3) & (views > 0), F.lit("too_few_views_for_multiview_2d")),
            F.when((views > 0) & (caption_views < need), F.lit("too_few_caption_views")),
        ),
        lambda x: x.isNotNull(),
    )


def prune_nodes(nodes: DataFrame, responses: DataFrame, key: str, tag: str, views: str, min_views: int = 2) -> DataFrame:
    """Nodes with a usable response and enough views; ids stay as they are."""
    ok = F.col(tag).isNotNull() & ~F.lower(F.trim(F.col(tag))).isin("fail", "invalid") & (F.col(views) >= min_views)
    return nodes.join(responses, key, "left").filter(ok)


def removable(pickable: Column, movable: Column, is_receptacle: Column, level: int) -> Column:
    """Level 1: what can be picked up; 2: movable objects too; 3: but receptacles as well."""
    rule = F.when(F.lit(level == 1), pickable).when(F.lit(level == 2), pickable | (movable & ~is_receptacle)).otherwise(pickable | movable)
    return F.coalesce(rule, F.lit(False))


def bernoulli(df: DataFrame, key: Column, ratio: float, seed: int = 0) -> DataFrame:
    """A sample by a hash of the key: the same rows at any partitioning, and in any engine that knows MD5."""
    return df.filter(hash32(key, seed) < int(ratio * 2**32))


def hash32(key: Column, seed: int = 0) -> Column:
    """The first 32 bits of the MD5 of 'seed:key'."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def gather(df: DataFrame, order: Column, index: list[int]) -> DataFrame:
    """Rows by their rank in ``order``; order and repeats of ``index`` are kept in column ``pos``."""
    from .views import global_rank

    wanted = df.sparkSession.createDataFrame([(p, i) for p, i in enumerate(index)], "pos int, _rank bigint")
    return global_rank(df, order, name="_rank").join(F.broadcast(wanted), "_rank").drop("_rank")
