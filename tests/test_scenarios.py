"""Scenarios of identity resolution, relations, graphs and point sets with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.config import Relations, TrackMerge
from orbweave.operators import constraints as C
from orbweave.operators import graphs as G
from orbweave.operators import mapping as M
from orbweave.operators import masks as K
from orbweave.operators import obb
from orbweave.operators import points as P
from orbweave.operators import relations as R
from orbweave.operators import tracks as T

FRAMES = [f"{i:06d}" for i in range(6)]


def rect(track, frame, top, left, bottom, right):
    return [("s", track, frame, y, left, right) for y in range(top, bottom)]


def runs_of(spark, tracks, frames=FRAMES):
    rows = [r for t, box in tracks.items() for f in frames for r in rect(t, f, *box)]
    return spark.createDataFrame(rows, "scene string, track string, frame string, y int, x0 int, x1 int")


def resolved(spark, tracks, labels, forbidden=None, confidence=None):
    runs = runs_of(spark, tracks)
    areas = K.areas(runs, ["scene", "track", "frame"])
    inter = K.intersections(runs.withColumnRenamed("track", "a"), runs.withColumnRenamed("track", "b"), ["scene", "frame"], "a", "b").filter("a < b")
    a, b = areas.withColumnsRenamed({"track": "a", "area": "area_a"}), areas.withColumnsRenamed({"track": "b", "area": "area_b"})
    over = a.join(b, ["scene", "frame"]).filter("a < b").join(inter, ["scene", "frame", "a", "b"], "left").na.fill(0, ["inter"])
    stats = T.area_stats(areas, ["scene", "track"])
    lab = spark.createDataFrame([(t, labels[t], float((confidence or {}).get(t, 0.5))) for t in tracks], "track string, label string, confidence double")
    tr = stats.join(lab, "track")
    n = areas.groupBy("scene", "track").agg(F.count("*").alias("n"))
    bad = spark.createDataFrame([("s", x, y) for x, y in forbidden], "scene string, a string, b string") if forbidden else None
    return T.resolve(tr, over, n, bad), over, n, runs


def groups(df, key):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r["track"])
    return sorted(map(sorted, out.values()))


def test_four_lamps_two_places(spark):
    t = {"l1": (10, 10, 30, 30), "l2": (10, 10, 30, 30), "l3": (60, 60, 80, 80), "l4": (60, 60, 80, 80)}
    r, *_ = resolved(spark, t, dict.fromkeys(t, "lamp"), confidence={"l2": 0.9, "l3": 0.8})
    assert groups(r, "cluster") == [["l1", "l2"], ["l3", "l4"]]
    assert {x["canonical"] for x in r.collect()} == {"l2", "l3"}


def test_no_chain_merge(spark):
    t = {"a": (0, 0, 20, 20), "b": (0, 2, 20, 22), "c": (0, 4, 20, 24)}
    cfg = TrackMerge(min_median_iou=0.8, frame_iou=0.75)
    _, over, n, _ = resolved(spark, t, dict.fromkeys(t, "x"))
    m = T.duplicate_flags(T.pair_metrics(over, n, cfg=cfg), F.lit(True), cfg).filter("merge_kind is not null")
    tr = spark.createDataFrame([("s", k) for k in t], "scene string, track string")
    assert sorted(map(len, groups(G.complete_link(tr, m, "scene", "track"), "cluster"))) == [1, 2]


def test_cross_label_duplicate(spark):
    t = {"a": (0, 0, 20, 20), "b": (0, 0, 20, 20), "c": (50, 50, 70, 70)}
    _, over, n, _ = resolved(spark, t, {"a": "sofa", "b": "couch", "c": "lamp"})
    m = T.duplicate_flags(T.pair_metrics(over, n), F.lit(False)).filter("merge_kind is not null").collect()
    assert [(r.a, r.b, r.merge_kind) for r in m] == [("a", "b", "cross_label_duplicate")]


def test_fragments_attach_to_full_track(spark):
    t = {"full": (0, 0, 40, 40), "left": (0, 0, 40, 12), "right": (0, 28, 40, 40), "other": (60, 60, 80, 80)}
    r, _, _, runs = resolved(spark, t, {"full": "Bed", "left": "bed", "right": " BED", "other": "bed"})
    assert groups(r, "root") == [["full", "left", "right"], ["other"]]
    merged = T.merged_masks(runs, r, keep_canonical=True)
    own = runs.filter("track in ('full', 'other')").select("scene", "track", "frame", "y", "x0", "x1")
    assert merged.select(*own.columns).exceptAll(own).isEmpty() and merged.count() == own.count()


def test_forbidden_identical_tracks_stay_apart(spark):
    t = {"a": (0, 0, 20, 20), "b": (0, 0, 20, 20)}
    r, over, n, _ = resolved(spark, t, dict.fromkeys(t, "pillow"), forbidden=[("b", "a")])
    assert groups(r, "cluster") == [["a"], ["b"]]
    bad = spark.createDataFrame([("s", "b", "a")], "scene string, a string, b string")
    m = T.duplicate_flags(T.pair_metrics(over, n, bad), F.lit(True)).filter("forbidden_conflict").collect()
    assert len(m) == 1 and m[0].median_iou == 1.0 and m[0].shared == 6


def test_empty_masks_give_no_iou(spark):
    e = spark.createDataFrame([("s", "a", "b", "0", 0, 0, 0)], "scene string, a string, b string, frame string, area_a long, area_b long, inter long")
    n = spark.createDataFrame([("s", "a", 1), ("s", "b", 1)], "scene string, track string, n long")
    assert T.pair_metrics(e, n).isEmpty()


def test_roots_reject_cycles(spark):
    t = spark.createDataFrame([("s", "a"), ("s", "b")], "scene string, track string")
    up = spark.createDataFrame([("s", "a", "b"), ("s", "b", "a")], "scene string, child string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        T.roots(up, t, "scene", "track")


def test_carve_shrinks_parent_only(spark):
    runs = runs_of(spark, {"p": (0, 0, 40, 40), "c": (10, 10, 20, 20)})
    child = K.dilate(runs.filter("track = 'c'").drop("track"), ["scene", "frame"], 1, 100, 100)
    left = K.areas(K.subtract(runs.filter("track = 'p'").drop("track"), child, ["scene", "frame"]), ["scene", "frame"])
    assert {r.area for r in left.collect()} == {1600 - 140}  # the square and its cross-shaped border


def test_manifest_seeds(spark):
    rows = [("s", "0", "bed", 0, 0.5), ("s", "0", "mattress", 1, 0.9), *[("s", f"{f}", "pillow", 10 * f + i, 0.3 + f / 10) for f in range(3) for i in range(3)]]
    d = spark.createDataFrame(rows, "scene string, frame string, label string, idx int, score double")
    out = T.normalize_manifest(d).collect()
    assert [(r.object_id, r.score) for r in out if r.object_label == "bed"] == [("bed-1", 0.9)]
    assert {r.frame for r in out if r.object_label == "pillow"} == {"1", "2"}


def test_lamp_on_nightstand(spark):
    rows = [(f, c, 40.0, 10.0, 60.0, 50.0, 30.0, 51.0, 70.0, 90.0) for c, f in enumerate(FRAMES[:5])]
    d = spark.createDataFrame(rows, "frame string, cluster int, s_x1 double, s_y1 double, s_x2 double, s_y2 double, t_x1 double, t_y1 double, t_x2 double, t_y2 double").withColumns({"a": F.lit("lamp"), "b": F.lit("stand")})
    assert R.on_summary(R.frame_on(d), ["a", "b"]).first().candidate
    flip = d.withColumnsRenamed({**{f"s_{c}": f"q_{c}" for c in ("x1", "y1", "x2", "y2")}, **{f"t_{c}": f"s_{c}" for c in ("x1", "y1", "x2", "y2")}}).withColumnsRenamed({f"q_{c}": f"t_{c}" for c in ("x1", "y1", "x2", "y2")})
    assert not R.on_summary(R.frame_on(flip), ["a", "b"]).first().candidate
    bg = d.withColumn("bg", F.lit(True))
    assert R.on_summary(R.frame_on(bg), ["a", "b"], background="bg").first().candidate
    assert not R.on_summary(R.frame_on(bg.filter("cluster < 4")), ["a", "b"], background="bg").first().candidate


def test_pillow_in_bed(spark):
    runs = runs_of(spark, {"pillow": (20, 20, 30, 35), "bed": (10, 10, 60, 90)}, FRAMES[:3])
    ev = R.hull_evidence(runs.filter("track = 'pillow'"), runs.filter("track = 'bed'"), ["frame"])
    assert all(r.hull_containment == 1.0 and r.center_inside for r in ev.collect())
    box = K.boxes(runs, ["track", "frame"])
    s = box.filter("track = 'pillow'").select("frame", *(F.col(a).alias("s_" + b) for a, b in (("bx0", "x1"), ("by0", "y1"), ("bx1", "x2"), ("by1", "y2"), ("area", "area"))))
    t = box.filter("track = 'bed'").select("frame", *(F.col(a).alias("t_" + b) for a, b in (("bx0", "x1"), ("by0", "y1"), ("bx1", "x2"), ("by1", "y2"), ("area", "area"))))
    f = R.frame_containment(s.join(t, "frame").join(ev, "frame")).withColumns({"a": F.lit("pillow"), "b": F.lit("bed"), "cluster": F.col("frame")})
    assert R.containment_summary(f, ["a", "b"]).first().candidate


def test_background_pair_is_no_candidate(spark):
    d = spark.createDataFrame([(True, True), (True, False)], "background_a boolean, background_b boolean").withColumns({"on_ab": F.lit(True), **{c: F.lit(None).cast("boolean") for c in ("on_ba", "in_ab", "in_ba", "near_3d", "parent_hint")}})
    assert [r.reasons for r in R.candidate_reasons(d).collect()] == [["multiview_first_on_second"]]


def cloud(n, at, seed):
    return np.random.default_rng(seed).random((n, 3)) + np.array(at)


def test_near_and_far_points(spark):
    rows = [(o, i, *p) for o, at in (("a", (0, 0, 0)), ("b", (0.5, 0, 0)), ("c", (30, 0, 0))) for i, p in enumerate(cloud(60, at, ord(o)).tolist())]
    d = spark.createDataFrame(rows, "obj string, pid int, x double, y double, z double")
    got = {(r.a, r.b): r.candidate for r in R.near_3d(d, "obj", "pid", 0.1).collect()}
    assert got == {("a", "b"): True}


def test_nearest_is_exact(spark):
    a, b = cloud(80, (0, 0, 0), 1) * 7, cloud(90, (0, 0, 0), 2) * 9
    da = spark.createDataFrame([(i, *p) for i, p in enumerate(a.tolist())], "p int, x double, y double, z double")
    db = spark.createDataFrame([(i, *p) for i, p in enumerate(b.tolist())], "q int, x double, y double, z double")
    got = {r.p: r.q for r in P.nearest(da, db, "p", "q", 0.5).collect()}
    d = ((a[:, None] - b[None]) ** 2).sum(2)
    assert got == {i: int(d[i].argmin()) for i in range(80)}


def test_overlap_without_geometry(spark):
    d = spark.createDataFrame([], "obj int, pid int, x double, y double, z double")
    assert P.overlap_ratios(d, "obj", "pid", 0.1).isEmpty()


def test_dbscan_against_brute_force():
    xyz = np.concatenate([cloud(40, (0, 0, 0), 1), cloud(30, (5, 5, 5), 2), np.array([[20.0, 20, 20]])])
    got = P.dbscan_labels(xyz, 0.6, 4)
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2)) <= 0.6
    core = d.sum(1) >= 4
    for i in range(len(xyz)):
        for j in range(len(xyz)):
            if core[i] and core[j] and d[i, j]:
                assert got[i] == got[j] >= 0
    assert all((got[i] >= 0) == bool((d[i] & core).any()) for i in range(len(xyz)))


def test_spanning_forest_is_minimal(spark):
    rng = np.random.default_rng(5)
    e = [(int(i), int(j), float(rng.random())) for i in range(20) for j in range(i + 1, 20) if rng.random() < 0.3]
    got = G.spanning_forest(spark.createDataFrame(e, "a int, b int, weight double")).collect()
    parent = list(range(20))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = []
    for a, b, w in sorted(e, key=lambda r: (r[2], r[0], r[1])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.append((a, b))
    assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_leader_clusters_against_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    reps = []
    for i in range(40):
        t, c = float(rng.random() * 12), rng.random(3)
        f = [np.cos(np.radians(t)), np.sin(np.radians(t)), 0.0]
        rows.append(("s", i, *c.tolist(), *map(float, f)))
        for k, (rc, rf) in enumerate(reps):
            if np.degrees(np.arccos(np.clip(np.dot(f, rf), -1, 1))) <= 5 and np.linalg.norm(c - rc) <= 0.5:
                want.append(k)
                break
        else:
            want.append(len(reps))
            reps.append((c, f))
    d = spark.createDataFrame(rows, "s string, i int, cx double, cy double, cz double, fx double, fy double, fz double")
    got = {r.i: r.cluster for r in G.leaders(d, ["s"], ["i"], ["cx", "cy", "cz"], ["fx", "fy", "fz"], 5.0, 0.5, "i").collect()}
    assert [got[i] for i in range(40)] == want


def test_nms_keeps_best(spark):
    d = spark.createDataFrame([(0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 1, 0.8, 1.0, 1.0, 11.0, 11.0), (0, 2, 0.7, 20.0, 20.0, 30.0, 30.0)], "frame int, idx int, conf double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.idx for r in G.nms(d, ["frame"], "idx", "conf").collect()) == [0, 2]


def test_box_solids_against_sampling():
    rng = np.random.default_rng(0)
    for _ in range(5):
        q1, q2 = (np.linalg.qr(rng.standard_normal((3, 3)))[0] for _ in range(2))
        xa, xb = q1 * rng.uniform(0.5, 1, 3)[:, None], q2 * rng.uniform(0.5, 1, 3)[:, None]
        ca, cb = np.zeros(3), rng.uniform(-0.5, 0.5, 3)
        got = obb.intersection(ca, xa, cb, xb)
        s = rng.uniform(-1, 1, (200_000, 3))
        p = s @ xa
        inside = (np.abs((p - cb) @ np.linalg.inv(xb)) <= 1).all(1).mean() * obb.volume(xa)
        assert abs(got - inside) < 0.03
        assert abs(obb.hull_volume(obb.corners(ca, xa)) - obb.volume(xa)) < 1e-9
    same = obb.measures([0, 0, 0], np.eye(3), [0, 0, 0], np.eye(3))
    assert abs(same["iou"] - 1) < 1e-9 and abs(same["giou"] - 1) < 1e-9 and same["contained"] == 1.0


def test_overlap_merge_guard(spark):
    d = spark.createDataFrame([("s", 1, 2, 0.9), ("s", 1, 3, 0.8), ("s", 2, 4, 0.75)], "s string, a int, b int, ratio double").withColumns({"visual": F.lit(0.9), "text": F.lit(0.9)})
    assert sorted((r.source, r.target) for r in M.overlap_merge(d, "s").collect()) == [(1, 2), (2, 4)]
    assert sorted((r.source, r.target) for r in M.overlap_merge(d, "s", compat=True).collect()) == [(1, 2), (1, 3), (2, 4)]


def test_merge_forms_agree_on_weights(spark):
    d = spark.createDataFrame([("k", 0, [1.0, 0.0], 1.0), ("k", 1, [0.0, 1.0], 3.0)], "k string, o int, f array<double>, w double")
    a = M.merge_objects_by_key(d, ["k"], "f", "w").first()
    b = M.fold_feature(d, ["k"], "o", "f", "w").first()
    assert a.w == b.w == 4.0 and np.allclose(a.f, b.f) and np.allclose(a.f, np.array([1, 3]) / np.sqrt(10))


def test_exclusive_points(spark):
    d = spark.createDataFrame([("a", 0), ("b", 0)], "o string, point_id int")
    with pytest.raises(C.Violation, match="not mutually exclusive"):
        C.exclusive(d, "point_id")


def test_enforced_rules(spark):
    d = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    with pytest.raises(C.Violation, match="positive: 2"):
        C.enforce(d, {"positive": F.col("v") > 0})
    assert C.enforce(d.filter("v > 0"), {"positive": F.col("v") > 0}).count() == 1


def test_cache_needs_equal_requests(spark):
    r = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, p string")
    c = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "d", "z")], "k int, p string, answer string")
    hit, miss = C.cache_hits(r, c, ["k", "p"], ["answer"])
    assert {(x.k, x.answer) for x in hit.collect()} == {(1, "x"), (2, "y")} and [x.k for x in miss.collect()] == [3]


def test_relations_config_defaults():
    assert Relations().min_clusters == 3
    with pytest.raises(ValueError):
        TrackMerge(min_median_iou=1.5)
