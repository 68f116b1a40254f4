"""Box expressions: 3-D axis-aligned boxes as structs min/max, 2-D boxes as (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


class Box:
    """A 3-D axis-aligned box over columns ``{prefix}min_x`` ... ``{prefix}max_z``."""

    def __init__(self, prefix: str = "", padding: float = 0.0):
        self.lo = [F.col(f"{prefix}min_{a}") - padding for a in AXES]
        self.hi = [F.col(f"{prefix}max_{a}") + padding for a in AXES]

    def volume(self) -> Column:
        return _product([h - low for low, h in zip(self.lo, self.hi)])


def _product(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out * c
    return out


def intersection(a: Box, b: Box) -> Column:
    return _product([F.greatest(F.lit(0.0), F.least(p, q) - F.greatest(m, n)) for m, n, p, q in zip(a.lo, b.lo, a.hi, b.hi)])


def enclosing(a: Box, b: Box) -> Column:
    return _product([F.greatest(p, q) - F.least(m, n) for m, n, p, q in zip(a.lo, b.lo, a.hi, b.hi)])


def iou(a: Box, b: Box, eps: float = 0.0) -> Column:
    """Intersection over union; ``eps`` is added to the union. Zero unions give 0."""
    i = intersection(a, b)
    union = a.volume() + b.volume() - i + eps
    return F.when(union > 0, i / union).otherwise(0.0)


def overlap_ratio(a: Box, b: Box) -> Column:
    """The larger of the two shares of a box that lie in the other."""
    i = intersection(a, b)
    part = lambda v: F.when(v > 0, i / v).otherwise(0.0)
    return F.greatest(part(a.volume()), part(b.volume()))


def giou(a: Box, b: Box, eps: float = 0.0) -> Column:
    i = intersection(a, b)
    union = a.volume() + b.volume() - i
    hull = enclosing(a, b)
    return i / (union + eps) - (hull - union) / (hull + eps)


def overlaps_strictly(a: Box, b: Box) -> Column:
    """Positive extent of the intersection along every axis."""
    out = F.lit(True)
    for m, n, p, q in zip(a.lo, b.lo, a.hi, b.hi):
        out = out & ((F.least(p, q) - F.greatest(m, n)) > 0)
    return out


def contain_ratio(a: Box, b: Box) -> Column:
    """The share of ``a`` that lies in ``b``, in [0, 1]."""
    v = a.volume()
    return F.when(v > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), intersection(a, b) / v))).otherwise(0.0)


def corner_volume(corners: Column) -> Column:
    """Volume of a box given by 8 corners of which 1, 2 and 3 are neighbours of 0: absolute triple product of the edges."""
    edge = lambda k: [corners[k][i] - corners[0][i] for i in range(3)]
    u, v, w = edge(1), edge(2), edge(3)
    cross = [v[1] * w[2] - v[2] * w[1], v[2] * w[0] - v[0] * w[2], v[0] * w[1] - v[1] * w[0]]
    return F.abs(u[0] * cross[0] + u[1] * cross[1] + u[2] * cross[2])


def widen(lo: Column, hi: Column, eps: float = 0.02) -> tuple[Column, Column]:
    """A side shorter than ``eps`` grown to it about its centre."""
    mid, short = (lo + hi) / 2, (hi - lo) < eps
    return F.when(short, mid - eps / 2).otherwise(lo), F.when(short, mid + eps / 2).otherwise(hi)


class Rect:
    """A 2-D box over columns ``{prefix}x1`` ... ``{prefix}y2``."""

    def __init__(self, prefix: str = ""):
        self.x1, self.y1, self.x2, self.y2 = (F.col(prefix + n) for n in ("x1", "y1", "x2", "y2"))
        self.w, self.h = self.x2 - self.x1, self.y2 - self.y1

    def area(self) -> Column:
        return self.w * self.h


def rect_intersection(a: Rect, b: Rect) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def rect_iou(a: Rect, b: Rect) -> Column:
    """0 for missing or empty boxes."""
    i = rect_intersection(a, b)
    union = a.area() + b.area() - i
    return F.coalesce(F.when((a.w > 0) & (a.h > 0) & (b.w > 0) & (b.h > 0) & (union > 0), i / union), F.lit(0.0))


def rect_share(a: Rect, b: Rect) -> Column:
    """Intersection over the first box; 0 if that is empty."""
    return F.coalesce(F.when(a.area() > 0, rect_intersection(a, b) / a.area()), F.lit(0.0))


def crop(r: Rect, padding: Column, width: Column, height: Column) -> dict[str, Column]:
    """The box grown by ``padding`` and clipped to the image."""
    return {
        "x1": F.greatest(F.lit(0), r.x1 - padding), "y1": F.greatest(F.lit(0), r.y1 - padding),
        "x2": F.least(width, r.x2 + padding), "y2": F.least(height, r.y2 + padding),
    }


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x, y, x + w, y + h]


def caption_view_reason(r: Rect, area: Column, width: Column, height: Column) -> Column:
    """Why a view cannot be captioned; null if it can."""
    longest = F.greatest(r.w, r.h)
    pad = F.least(F.lit(50), F.greatest(F.lit(20), F.bround(longest * 0.2))).cast("int")
    c = crop(r, pad, width, height)
    w, h = c["x2"] - c["x1"], c["y2"] - c["y1"]
    return (
        F.when(r.x1.isNull() | F.coalesce(area <= 0, F.lit(True)), "empty_mask")
        .when(r.area() <= 0, "invalid_bbox")
        .when(area < 100, "mask_area_below_100")
        .when(area / r.area() < 0.1, "mask_fill_ratio_below_0.1")
        .when(F.least(w, h) < 48, "caption_crop_dimension_below_48")
        .when(w * h < 4900, "caption_crop_area_below_4900")
    )


def on_evidence(s: Rect, t: Rect, min_x: float, min_gap: float, max_gap: float) -> dict[str, Column]:
    """Whether ``s`` stands on ``t`` in one frame; all null if a box is missing or ``s`` is empty."""
    ok = (s.w > 0) & (s.h > 0) & t.x1.isNotNull()
    x_support = F.when(ok, F.greatest(F.lit(0.0), F.least(s.x2, t.x2) - F.greatest(s.x1, t.x1)) / s.w)
    gap = F.when(ok, (t.y1 - s.y2) / s.h)
    above = F.when(ok, (s.y1 + s.y2) * 0.5 < (t.y1 + t.y2) * 0.5)
    support = (x_support >= min_x) & (gap >= min_gap) & (gap <= max_gap)
    return {"x_support": x_support, "gap": gap, "above": above, "support": support, "vote": above & support}


def similarity(spatial: Column, visual: Column, bias: float = 0.0, method: str = "sim_sum") -> Column:
    """Weighted sum of spatial and visual similarity."""
    if method != "sim_sum":
        raise ValueError(f"unknown similarity aggregation: {method}")
    return (1 + bias) * spatial + (1 - bias) * visual


def spatial(method: str, a: Box, b: Box) -> Column:
    """Dispatch by name. The exact forms for oriented boxes are in :mod:`orbweave.operators.obb`."""
    if method == "iou":
        return iou(a, b, 1e-10)
    if method == "giou":
        return giou(a, b, 1e-10)
    raise ValueError(f"invalid spatial similarity: {method}")


def footprint(b: Box, scene_lo: list[Column], scene_hi: list[Column], width: float, up: str = "y") -> dict[str, Column]:
    """The box seen from above, scaled so that the scene's wider side is ``width``: x, y of the corner, w, h."""
    i, j = [k for k, a in enumerate(AXES) if a != up]
    scale = width / F.greatest(scene_hi[i] - scene_lo[i], scene_hi[j] - scene_lo[j])
    return {"px": (b.lo[i] - scene_lo[i]) * scale, "py": (b.lo[j] - scene_lo[j]) * scale, "pw": (b.hi[i] - b.lo[i]) * scale, "ph": (b.hi[j] - b.lo[j]) * scale}
