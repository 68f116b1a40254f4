"""Map-level compositions end to end on small scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.config import Cloud, DetectionFilter
from orbweave.operators.constraints import Violation
from orbweave.operators.fusion import density_clusters
from orbweave.operators.points import dbscan_labels
from orbweave.plans import pipelines as PL


def box_runs(rows):
    return [(*k, y, x1, x2) for *k, x1, y1, x2, y2 in rows for y in range(y1, y2)]


def test_detections_become_points(spark):
    dets = [("s", "0", 0, 2.0, 2.0, 22.0, 22.0, 0.9, False), ("s", "0", 1, 0.0, 0.0, 3.0, 3.0, 0.9, False), ("s", "0", 2, 2.0, 2.0, 22.0, 22.0, 0.1, False), ("s", "0", 3, 2.0, 2.0, 22.0, 22.0, 0.9, True)]
    d = spark.createDataFrame(dets, "scene string, frame string, idx int, x1 double, y1 double, x2 double, y2 double, conf double, background boolean").withColumn("image_area", F.lit(1600.0))
    runs = spark.createDataFrame(box_runs([(*r[:3], *map(int, r[3:7])) for r in dets]), "scene string, frame string, idx int, y int, x0 int, x1 int")
    depth = spark.createDataFrame([("s", "0", v, u, 2.0) for v in range(40) for u in range(40)], "scene string, frame string, v int, u int, depth double")
    cams = spark.createDataFrame([("s", "0", 20.0, 20.0, 20.0, 20.0, [1.0, 0.0, 0.0, 5.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0])], "scene string, frame string, fx double, fy double, cx double, cy double, pose array<double>")
    pts, box = PL.detections_to_points(d, runs, depth, cams, DetectionFilter(), Cloud(voxel=0.01, eps=0.3, min_points=4))
    got = box.collect()
    assert [r.idx for r in got] == [0] and got[0].n_points == 400
    assert abs(got[0].min_x - 3.2) < 1e-6 and abs(got[0].max_x - 5.1) < 1e-6 and pts.count() == 400


def test_project_conversion(spark):
    objects = spark.createDataFrame([("s", "lamp_1", "lamp"), ("s", "wall", "Wall"), ("s", "ghost", "chair"), ("s", "flat", "poster")], "scene string, object_id string, label string")
    masks = [("s", o, f"{f:06d}", 20, 20, 80, 80) for o, n in (("lamp_1", 3), ("wall", 1), ("flat", 3)) for f in range(n)]
    runs = spark.createDataFrame(box_runs(masks), "scene string, object_id string, frame_id string, y int, x0 int, x1 int")
    points = spark.createDataFrame([("s", "lamp_1", i, float(i), 0.0, 1.0) for i in range(8)] + [("s", "wall", 10 + i, 0.0, float(i), 1.0) for i in range(8)], "scene string, object_id string, point_id int, x double, y double, z double")
    feats = spark.createDataFrame([("s", o, "0", [1.0, 0.0]) for o in ("lamp_1", "wall", "flat")] + [("s", "lamp_1", "1", [0.0, 2.0])], "scene string, object_id string, frame_id string, feature array<double>")
    ok, bad = PL.convert_project(objects, runs, points, feats, 128, 128)
    got = {r.object_id: r for r in ok.collect()}
    assert set(got) == {"lamp_1", "wall", "flat"} and got["wall"].is_background and got["flat"].geometry_type == "multiview_2d"
    assert np.allclose(got["lamp_1"].feature, [2**-0.5] * 2) and {r.class_id for r in got.values()} == {0, 1, 2}
    assert [(r.object_id, r.reasons) for r in bad.collect()] == [("ghost", ["no_nonempty_2d_masks"])]


def test_scene_graph(spark):
    boxes = [("s", o, f"{f:06d}", *b) for f in range(5) for o, b in (("lamp", (40.0, 10.0, 60.0, 50.0)), ("stand", (30.0, 51.0, 70.0, 90.0)), ("far", (200.0, 10.0, 220.0, 30.0)), ("wall", (30.0, 92.0, 70.0, 120.0)))]
    b = spark.createDataFrame(boxes, "scene string, object_id string, frame_id string, x1 double, y1 double, x2 double, y2 double")
    o = spark.createDataFrame([("s", x, x == "wall") for x in ("lamp", "stand", "far", "wall")], "scene string, object_id string, is_background boolean")
    c = spark.createDataFrame([("s", f"{f:06d}", f) for f in range(5)], "scene string, frame_id string, cluster int")
    pairs, edges = PL.scene_graph(o, b, c)
    assert {(r.source, r.relation, r.target) for r in edges.collect()} == {("lamp", "on", "stand"), ("stand", "on", "wall")}
    none, _ = PL.scene_graph(o, b.filter("frame_id < '000002'"), c)
    assert none.isEmpty()


def test_identities_and_gate(spark):
    rows = [("s", t, f"{f:06d}", *b) for f in range(6) for t, b in (("a", (0, 0, 20, 20)), ("b", (0, 0, 20, 20)), ("c", (50, 50, 60, 60)))]
    runs = spark.createDataFrame(box_runs(rows), "scene string, track string, frame string, y int, x0 int, x1 int")
    tracks = spark.createDataFrame([("s", t, "cup", 0.5) for t in "abc"], "scene string, track string, label string, confidence double")
    ids, masks = PL.normalize_tracks(tracks, runs)
    assert {r.track: r.root for r in ids.collect()} == {"a": "a", "b": "a", "c": "c"}
    q = PL.identity_gate(masks, 6)
    assert {r.track: r.issues for r in q.collect()} == {"a": [], "c": []}
    with pytest.raises(Violation):
        PL.identity_gate(masks.unionByName(spark.createDataFrame([("s", "e", "0", 0, 1, 1)], masks.schema)), 6)


def test_density_clusters_agree(spark):
    rng = np.random.default_rng(2)
    xyz = np.concatenate([rng.random((40, 3)), rng.random((25, 3)) + 4, rng.random((3, 3)) + 20])
    d = spark.createDataFrame([("o", i, *p) for i, p in enumerate(xyz.tolist())], "obj string, pid int, x double, y double, z double")
    got = {r.pid: r.cluster for r in density_clusters(d, "obj", "pid", 0.5, 4).collect()}
    want = dbscan_labels(xyz, 0.5, 4)
    assert set(got) == set(np.flatnonzero(want >= 0).tolist())
    near = ((xyz[:, None] - xyz[None]) ** 2).sum(2) <= 0.25
    core = near.sum(1) >= 4
    for i in np.flatnonzero(core):
        for j in np.flatnonzero(core):
            assert (got[i] == got[j]) == (want[i] == want[j])


def test_stages_resume(tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("1")
    runs = []
    stages = [PL.Stage("copy", call=lambda: (runs.append(1), b.write_text(a.read_text())), inputs=[str(a)], outputs=[str(b)]), PL.Stage("echo", argv=["true"])]
    assert PL.run_stages(stages, str(tmp_path / "m")) == ["copy", "echo"]
    assert PL.run_stages(stages, str(tmp_path / "m")) == []
    b.write_text("changed")
    assert PL.run_stages(stages, str(tmp_path / "m")) == ["copy"]
    a.write_text("2")
    assert PL.run_stages(stages, str(tmp_path / "m")) == ["copy"] and b.read_text() == "2" and len(runs) == 3
    with pytest.raises(Violation):
        PL.run_stages([PL.Stage("none", argv=["true"], outputs=[str(tmp_path / "x")])], str(tmp_path / "m"))
