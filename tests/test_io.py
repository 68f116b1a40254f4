"""Sources, sinks, models and streaming."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import mapping as M
from orbweave.operators import models as MD
from orbweave.operators.constraints import Violation
from orbweave.sinks import files as K
from orbweave.sources import files as S
from orbweave.sources import poses as P
from orbweave.streaming import mapping as SM


def pose(t):
    m = np.eye(4)
    m[:3, 3] = t
    return m


def test_pose_layouts(spark, tmp_path):
    rows = [pose((i, 2 * i, 3 * i)) for i in range(4)]
    d = tmp_path / "scene"
    (d / "pose").mkdir(parents=True)
    (d / "poses").mkdir()
    (d / "traj.txt").write_text("\n".join(" ".join(map(str, m.ravel())) for m in rows))
    (d / "traj.gt.sim").write_text("\n\n".join("\n".join(" ".join(map(str, r)) for r in m[:3]) for m in rows))
    (d / "poses.log").write_text("\n".join(f"{i} {i} {i + 1}\n" + "\n".join(" ".join(map(str, r)) for r in m) for i, m in enumerate(rows)))
    for i, m in enumerate(rows):
        (d / "pose" / f"{i * 5}.txt").write_text("\n".join(" ".join(map(str, r)) for r in m))
        np.save(d / "poses" / f"{i}.npy", m)
    (d / "poses.jsonl").write_text("\n".join(json.dumps({"transform": m.T.ravel().tolist()}) for m in rows for _ in range(2)))
    for layout, o in (("Replica", {}), ("icl", {}), ("azure", {"poses": "poses.log"}), ("scannet", {})):
        got = P.read_frames(spark, layout, str(d), **o).orderBy("frame_idx").collect()
        assert [r.pose for r in got] == [m.ravel().tolist() for m in rows], layout
        assert got[0].scene_id == "scene"
    rs = P.read_frames(spark, "realsense", str(d)).orderBy("frame_idx").collect()
    assert rs[1].pose[3] == 1.0 and rs[1].pose[7] == -2.0 and rs[1].pose[11] == -3.0
    ms = P.read_frames(spark, "multiscan", str(d), frames=4).orderBy("frame_idx").collect()
    assert [r.pose[3] for r in ms] == [0, 1, 2, 3] and ms[0].pose[5] == -1.0
    assert P.read_frames(spark, "icl", str(d), compat=True).first().pose[15] == 3.0
    cut = P.read_frames(spark, "replica", str(d), start=1, end=4, stride=2, relative=True).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in cut] == [1, 3] and cut[0].pose == np.eye(4).ravel().tolist() and cut[1].pose[3] == 2.0
    assert P.azure(spark, str(d), poses=None, frames=2).count() == 2
    with pytest.raises(ValueError):
        P.read_frames(spark, "nothing", str(d))
    with pytest.raises(ValueError):
        P.read_frames(spark, "replica", str(d), start=3, end=2)
    files = P.list_files(spark, f"{d}/pose/*.txt").orderBy("frame_idx").collect()
    assert [r.path.rpartition("/")[2] for r in files] == ["0.txt", "5.txt", "10.txt", "15.txt"]


def test_strict_json(spark, tmp_path):
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "[1]"):
        with pytest.raises(ValueError):
            S.strict_json(bad)
    f = tmp_path / "frames.json"
    frames = [{"frame_id": f"{i:06d}", "source_frame_index": 2709 + 24 * i, "source_time_sec": 1.0, "path": f"{i}.png"} for i in range(3)]
    doc = {"written_frame_count": 3, "source_width": 128, "source_height": 128, "frames": frames}
    f.write_text(json.dumps(doc))
    m = S.read_frames_manifest(spark, str(f))
    assert m.count() == 3
    assert {r.alias for r in S.frame_aliases(m).collect()} >= {"000001", "1"}
    frames[2]["source_frame_index"] = 1
    f.write_text(json.dumps(doc))
    with pytest.raises(Violation, match="increasing"):
        S.read_frames_manifest(spark, str(f))


def test_camera_info(spark, tmp_path):
    f = tmp_path / "c.json"
    doc = {"extrinsic_type": "world_to_camera", "intrinsic": {"w": 4, "h": 3, "fx": 1.0, "fy": 1.0, "cx": 2.0, "cy": 1.0}, "extrinsic": {"000000": pose((1, 2, 3)).tolist()}}
    f.write_text(json.dumps(doc))
    assert S.read_camera_info(spark, str(f)).first().extrinsic[3] == 1.0
    doc["extrinsic"]["000001"] = np.zeros((4, 4)).tolist()
    f.write_text(json.dumps(doc))
    with pytest.raises(Violation, match="pose"):
        S.read_camera_info(spark, str(f))


def test_masks_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    masks = {("o1", "000000"): rng.random((12, 16)) < 0.4, ("o2", "000001"): rng.random((12, 16)) < 0.4}
    rows = [(o, f, *r) for (o, f), m in masks.items() for r in S.mask_runs(m)]
    runs = spark.createDataFrame(rows, "object_id string, frame_id string, y int, x0 int, x1 int")
    out = K.export_masks(runs, str(tmp_path / "m"), 16, 12).collect()
    assert {(r.object_id, r.area) for r in out} == {(o, int(m.sum())) for (o, _), m in masks.items()}
    back = S.read_masks(spark, str(tmp_path / "m"), 16, 12)
    assert back.exceptAll(runs).isEmpty() and runs.exceptAll(back).isEmpty()
    assert S.read_masks(spark, str(tmp_path / "none")).isEmpty()


def test_png_filters():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 255, (5, 7, 3), dtype=np.uint8)
    assert (MD.read_png(MD.png(a)) == a).all()


def ply(kind, xyz, rgb):
    head = f"ply\nformat {kind} 1.0\nelement vertex {len(xyz)}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    if kind == "ascii":
        return (head + "\n".join(" ".join(map(str, [*p, *c])) for p, c in zip(xyz, rgb))).encode()
    e = "<" if "little" in kind else ">"
    return head.encode() + b"".join(struct.pack(e + "fffBBB", *p, *c) for p, c in zip(xyz, rgb))


def test_ply(spark, tmp_path):
    xyz, rgb = [(0.5, 1.0, 2.0), (3.0, 4.0, 5.0)], [(255, 0, 0), (0, 51, 255)]
    S.register(spark)
    for kind in ("ascii", "binary_little_endian", "binary_big_endian"):
        (tmp_path / f"{kind}.ply").write_bytes(ply(kind, xyz, rgb))
    got = spark.read.format("ply").load(f"{tmp_path}/*.ply")
    assert got.count() == 6
    assert {(r.x, r.r, r.g) for r in got.collect()} == {(0.5, 1.0, 0.0), (3.0, 0.0, 0.2)}
    with pytest.raises(ValueError):
        S.parse_ply(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n1\n")


def test_sens(spark, tmp_path):
    depth = np.arange(6, dtype="<u2").reshape(2, 3)
    head = struct.pack("<IQ", 4, 3) + b"cam" + b"\0" * 256 + struct.pack("<ii", 2, 1) + struct.pack("<IIIIf", 4, 4, 3, 2, 1000.0) + struct.pack("<Q", 3)
    z = zlib.compress(depth.tobytes())
    body = b"".join(pose((i, 0, 0)).astype("<f4").tobytes() + struct.pack("<QQQQ", i, i, 4, len(z)) + b"jpeg" + z for i in range(3))
    (tmp_path / "a.sens").write_bytes(head + body)
    S.register(spark)
    f = spark.read.format("sens").load(f"{tmp_path}/*.sens")
    assert [r.pose[3] for r in f.orderBy("frame_idx").collect()] == [0.0, 1.0, 2.0]
    assert K.export_sens(f, str(tmp_path / "out"), 2) == 2
    assert (tmp_path / "out/pose/2.txt").read_text().startswith("1 0 0 2")


def test_config(tmp_path):
    (tmp_path / "a.json").write_text('{"x": {"p": 1, "q": 2}, "y": 3}')
    (tmp_path / "b.json").write_text('{"inherit_from": "a.json", "x": {"q": 5}}')
    assert S.load_config(str(tmp_path / "b.json")) == {"x": {"p": 1, "q": 5}, "y": 3}
    assert S.expand_variables({"a": ["${R}/x"]}, {"R": "/r"}) == {"a": ["/r/x"]}
    with pytest.raises(ValueError):
        S.expand_variables("${NO}", {})
    assert len(S.uniform_indices(2709, 3429, 24)) == 31
    assert S.uniform_indices(0, 10, 1, 3) == [0, 5, 10]


def test_atomic_files(tmp_path):
    p = str(tmp_path / "m.json")
    K.save_json(p, {"a": 1}, replace=False)
    with pytest.raises(FileExistsError):
        K.save_json(p, {"a": 2}, replace=False)
    K.save_json(p, {"a": 3})
    assert json.loads(open(p).read()) == {"a": 3}
    assert [f.name for f in tmp_path.iterdir()] == ["m.json"]


def test_map_round_trip(spark, tmp_path):
    o = spark.sql("select 'a' as object_id, 'colmap_3d' as geometry_type, 5 as point_count, struct(0.0 as min_x) as bbox, false as is_background union all select 'b', 'multiview_2d', 0, null, true")
    K.save_map({"objects": o}, str(tmp_path / "m"), {"v": 1})
    assert K.load_map(spark, str(tmp_path / "m"), background=False)["objects"].count() == 1
    with pytest.raises(Violation):
        K.save_map({"objects": o.withColumn("point_count", F.lit(0))}, str(tmp_path / "n"))


def test_graph_and_reports(spark, tmp_path):
    g = spark.createDataFrame([("lamp_1", '{"relation":["on desk_2"]}'), ('a"b', "{}")], "key string, value string")
    K.save_graph(g, str(tmp_path / "g"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert {"lamp_1": {"relation": ["on desk_2"]}} in got
    o = spark.createDataFrame([(False, []), (True, []), (False, ["no_nonempty_2d_masks"])], "is_background boolean, reasons array<string>")
    assert K.conversion_report(o, str(tmp_path / "r.json")) == {"total": 3, "accepted": 2, "background": 1, "foreground": 1, "rejections": {"no_nonempty_2d_masks": 1}}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x").write_text("1")
    assert len(K.tree_sha(spark, str(tmp_path / "t"))) == 64
    with pytest.raises(Violation):
        K.save_evidence(g, str(tmp_path / "e"), 1)


def test_models(spark):
    d = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    e = MD.embed_texts(d, "t", lambda: MD.HashEmbedder(8)).collect()
    assert len(e) == 4 and len({tuple(r.embedding) for r in e if r.t == "a"}) == 1

    def flaky(r):
        if r["t"] == "b":
            raise RuntimeError("key sk-0123456789abcdef0123")
        return {"answer": r["t"] * 2}

    got = {r.t: (r.answer, r.error) for r in MD.call_model(d.filter("t is not null").distinct(), "answer string", flaky).collect()}
    assert got == {"a": ("aa", None), "b": (None, "RuntimeError")}
    assert "0123456789" not in MD.scrub("sk-0123456789abcdef0123 failed")
    assert d.select(MD.nfkc(F.lit("ﬁ")).alias("x")).first().x == "fi"
    assert MD.rule_judge({"on_ba": True}) == {"answer": "b on a"}
    assert len(d.select(MD.prompt("s", [("q", "a")], F.col("t")).alias("p")).first().p) == 4
    m = np.zeros((6, 6), bool)
    m[2:4, 2:4] = True
    i = np.full((6, 6, 3), 9, np.uint8)
    assert (MD.outline(i, m)[1, 2] == (255, 0, 0)).all() and MD.blackout(i, m).sum() == 4 * 27 and MD.crop_both(i, m, (2, 2, 4, 4), 1)[0].shape == (4, 4, 3)
    assert MD.data_url(b"x").startswith("data:image/png;base64,")


def detections(spark, frames):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((3, 4))
    rows = []
    for s in ("s", "t"):
        for f in range(frames):
            for k in range(3):
                v = base[k] + 0.05 * rng.standard_normal(4)
                rows.append((s, f, k, (v / np.linalg.norm(v)).tolist(), *[float(5 * k + x) for x in (0, 0, 0, 1, 1, 1)]))
    return spark.createDataFrame(rows, "scene string, frame int, det int, f array<double>, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")


def test_stream_equals_batch(spark, tmp_path):
    d = detections(spark, 6)
    batch = {(r.scene, r.frame, r.det): r.object for r in M.map_scenes(d, "scene", "frame", "det", "f", 1.2).collect()}
    assert {v for v in batch.values()} == {0, 1, 2}
    land = str(tmp_path / "land")
    for f in range(6):
        d.filter(F.col("frame") == f).coalesce(1).write.mode("append").parquet(land)
    s = SM.landed_frames(spark, land, d.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), per_batch=2)
    q = SM.capture(SM.map_stream(s, "scene", "frame", "det", "f", 1.2), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r.scene, r.frame, r.det): r.object for r in SM.replay(spark, str(tmp_path / "out"), ["scene", "frame", "det"]).collect()}
    assert got == batch


def test_late_frames_stop_the_stream(spark, tmp_path):
    d = detections(spark, 4)
    land = str(tmp_path / "land")
    schema = d.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    for step, frames in enumerate(("frame < 2", "frame = 1 and det = 2")):
        d.filter(frames).coalesce(1).write.mode("append").parquet(land)
        q = SM.capture(SM.map_stream(SM.landed_frames(spark, land, schema), "scene", "frame", "det", "f", 1.2), str(tmp_path / "out"), str(tmp_path / "cp"))
        if step:
            with pytest.raises(Exception, match="came after"):
                q.awaitTermination(120)
        else:
            q.awaitTermination(120)


def test_maintenance_drops_weak_objects(spark):
    d = detections(spark, 4).filter("scene = 's' and (det < 2 or frame = 0)")
    out = M.map_scenes(d, "scene", "frame", "det", "f", 1.2, maintain=2, min_detections=2).collect()
    assert {r.object for r in out if r.frame == 3} == {0, 1}


def test_images(spark, tmp_path):
    from orbweave.sources import images as I

    a = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (I.resize_linear(a.astype(float), 4, 4) == a).all() and I.resize_nearest(a, 2, 2).tolist() == a[::2, ::2].tolist()
    assert np.allclose(I.resize_linear(np.array([[0.0, 2.0]]), 1, 1), 1.0)
    assert np.allclose(I.undistort(a, 2, 2, 1.5, 1.5, ()), a)
    (tmp_path / "c.png").write_bytes(MD.png(a))
    np.save(tmp_path / "d.npy", np.array([[1000, 2000]]))
    f = spark.read.format("binaryFile").load(str(tmp_path))
    c = I.read_images(f.filter("path like '%png'"), 2, 2).first()
    assert (c.width, c.height, c.channels, len(c.pixels)) == (2, 2, 3, 12)
    assert I.read_images(f.filter("path like '%npy'"), depth_scale=1000.0).first().pixels == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        I.decode("x.exr", b"")
