"""Thresholds of the operators, as frozen dataclasses whose values become literals in plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectionFilter:
    mask_area: int = 25
    mask_area_floor: int = 10
    confidence: float = 0.2
    max_box_ratio: float = 1.0
    skip_background: bool = True
    min_points: int = 16
    min_points_floor: int = 5
    min_volume: float = 1e-6


@dataclass(frozen=True)
class Association:
    spatial: str = "iou"
    physical_bias: float = 0.0
    threshold: float = 0.0
    containment_area: float = 0.95
    containment_penalty: float = 0.5
    use_containment: bool = False


@dataclass(frozen=True)
class Cloud:
    voxel: float = 0.025
    eps: float = 0.05
    min_points: int = 10
    min_cluster: int = 5


@dataclass(frozen=True)
class ObjectFilter:
    min_points: int = 0
    min_detections: int = 3


@dataclass(frozen=True)
class OverlapMerge:
    overlap: float = 0.7
    visual: float = 0.7
    text: float = 0.7


@dataclass(frozen=True)
class TrackMerge:
    min_shared: int = 5
    min_coverage: float = 0.60
    min_median_iou: float = 0.85
    frame_iou: float = 0.75
    frame_iou_share: float = 0.80
    cross_label: bool = True
    duplicate_median_iou: float = 0.90
    duplicate_frame_iou: float = 0.85
    duplicate_share: float = 0.80
    fragment_median: float = 0.95
    fragment_frame: float = 0.90
    fragment_share: float = 0.75
    fragment_area: float = 0.75

    def __post_init__(self):
        for name, v in vars(self).items():
            if name not in ("min_shared", "cross_label") and not 0 <= v <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        if self.min_shared < 1:
            raise ValueError("min_shared must be positive")


@dataclass(frozen=True)
class IdentityQuality:
    min_frames: int = 3
    min_coverage: float = 0.70
    max_cv: float = 1.0
    max_step: float = 4.0


@dataclass(frozen=True)
class Relations:
    pose_degrees: float = 5.0
    pose_share: float = 0.03
    min_clusters: int = 3
    background_clusters: int = 5
    min_above: float = 0.75
    min_support: float = 0.50
    background_support: float = 0.60
    min_x_support: float = 0.25
    min_gap: float = -0.25
    max_gap: float = 0.10
    box_containment: float = 0.90
    hull_containment: float = 0.80
    max_area_ratio: float = 0.50
    containment_support: float = 0.60
    radius_multiplier: float = 2.5
    min_fraction: float = 0.02
    max_points: int = 5000


@dataclass(frozen=True)
class Carve:
    min_containment: float = 0.80
    max_area_ratio: float = 0.35


@dataclass(frozen=True)
class Graph:
    min_overlap: float = 0.01
    min_views: int = 2
    caption_views: int = 4
    max_candidates: int = 100


BACKGROUND = ("wall", "floor", "ceiling")
