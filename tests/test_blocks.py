"""Pairs that meet in blocks instead of being rows: the same values as by rows, and no query goes back to rows."""

import random

import pytest
from pyspark.sql import functions as F

from orbweave.config import TrackMerge
from orbweave.operators import graphs as G
from orbweave.operators import masks as K
from orbweave.operators import tracks as T
from orbweave.plans import catalog
from orbweave.plans import standins as S

#: Queries that must not make a row per pair of tracks and frame.
BLOCKS = ["track_pair_metrics", "best_parent", "carve_decision", "fragment_candidates", "forbidden_conflicts", "duplicate_flags", "complete_link", "identity_resolution", "track_normalization"]


@pytest.mark.parametrize("name", BLOCKS)
def test_no_rows_of_frame_pairs(spark, sf, monkeypatch, name):
    def no(*a, **k):
        raise AssertionError("a row per pair and frame")

    monkeypatch.setattr(S, "day_pairs", no)
    monkeypatch.setattr(T, "pair_metrics", no)
    assert catalog.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("lines", [1, 3])
def test_metrics_of_masks_equal_those_of_rows(spark, monkeypatch, lines):
    r = random.Random(lines)
    runs = [(s, f"t{t}", f, y, (x := r.randrange(20)), x + r.randrange(1, 9)) for s in "ab" for t in range(40) for f in range(12) if r.random() < 0.6 for y in range(lines) if r.random() < 0.8]
    df = spark.createDataFrame(runs, "scene string, track string, frame int, y int, x0 int, x1 int")
    area = K.areas(df, ["scene", "track", "frame"])
    inter = K.intersections(df.withColumnRenamed("track", "a"), df.withColumnRenamed("track", "b"), ["scene", "frame"], "a", "b").filter("a < b")
    a, b = area.withColumnsRenamed({"track": "a", "area": "area_a"}), area.withColumnsRenamed({"track": "b", "area": "area_b"})
    over = a.join(b, ["scene", "frame"]).filter("a < b").join(inter, ["scene", "frame", "a", "b"], "left").na.fill(0, ["inter"])
    cfg = TrackMerge(min_shared=2, min_coverage=0.2, min_median_iou=0.1, frame_iou=0.1, frame_iou_share=0.3, duplicate_median_iou=0.2, duplicate_frame_iou=0.2, duplicate_share=0.3, fragment_median=0.5, fragment_frame=0.5, fragment_share=0.4, fragment_area=0.9)
    rows = T.pair_metrics(over, area.groupBy("scene", "track").agg(F.count("*").alias("n")), cfg=cfg)
    monkeypatch.setattr(T, "BLOCK", (7, 7))
    monkeypatch.setattr(T, "CELLS", 300)
    cols = [c for c in rows.columns if c != "forbidden"]
    flat = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in d.select(*cols).collect())
    assert flat(T.run_metrics(df, cfg=cfg)) == flat(rows)
    few = T.run_metrics(df, cfg=cfg, keep=("duplicates", "fragments"))
    flags = lambda d: T.duplicate_flags(d, F.col("a") < "t2", cfg).filter("merge_kind is not null").select(*cols)
    assert few.count() < rows.count() and flat(flags(few)) == flat(flags(rows)) != []
    parents = lambda d: sorted(map(tuple, T.fragment_candidates(d, cfg).select("scene", "child", "parent").collect()))
    assert parents(few) == parents(rows) != []


def test_run_metrics_of_nothing(spark):
    assert T.run_metrics(spark.createDataFrame([], "scene int, track int, frame int, y int, x0 int, x1 int")).isEmpty()


def test_complete_link_grows_with_the_pairs(spark):
    import time

    n = 30_000
    tracks = spark.range(n).select(F.lit(0).alias("scene"), F.col("id").alias("track"))
    began = time.time()
    out = G.complete_link(tracks, tracks.filter("track % 2 = 0").select("scene", F.col("track").alias("a"), (F.col("track") + 1).alias("b")), "scene", "track")
    assert out.groupBy("cluster").count().filter("count = 2").count() == n // 2
    assert time.time() - began < 60  # all tracks against all clusters are 3 x 10^8 steps
