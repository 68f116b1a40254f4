"""Queries over files: each writes files from the tables into the shared folder and runs a reader, a sink, a validator or a stream on them."""

from __future__ import annotations

import io
import json
import struct
import zlib

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints as C
from ..operators import models as MD
from ..session import table
from ..sinks import files as K
from ..sources import files as S
from ..sources import images as I
from ..sources import poses as P
from ..storage import scratch
from . import standins as ST
from .registry import query
from .relational import _FOLD, _frames


def _put(folder: str, files: dict[str, bytes]) -> None:
    """Write a few small files from the driver."""
    at, root = fs.FileSystem.from_uri(folder)
    for name, data in files.items():
        at.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
        with at.open_output_stream(f"{root}/{name}") as f:
            f.write(data)


def _nations(s: SparkSession, d: str) -> list:
    return table(s, d, "nation").orderBy("n_nationkey").collect()  # 25 rows at every scale


def _pose(r) -> np.ndarray:
    """A quarter turn about z at (key, region, 1)."""
    return np.array([[0, -1, 0, r.n_nationkey], [1, 0, 0, r.n_regionkey], [0, 0, 1, 1], [0, 0, 0, 1]], float)


def _rows(m: np.ndarray) -> str:
    return "\n".join(" ".join(map(str, r)) for r in m)


def _npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


_TURNED = ("realsense", "record3d", "multiscan", "hm3d", "hm3d-openeqa")


@query("pose_layouts", "S4 S5 S6 S8 S9 S10 S11 S12 S13", "layout:s frame_idx:i tx:f ty:f tz:f m01:f m10:f corner:f", """SELECT layout, n_nationkey AS frame_idx, n_nationkey AS tx, n_regionkey * turn AS ty, turn AS tz, -turn AS m01, turn AS m10, corner FROM nation,
  (VALUES ('icl', 1, 1), ('icl-compat', 1, 3), ('replica', 1, 1), ('scannet', 1, 1), ('ai2thor', 1, 1), ('azure', 1, 1), ('azurekinect', 1, 1), ('realsense', -1, 1), ('record3d', -1, 1), ('hm3d', -1, 1), ('hm3d-openeqa', -1, 1)) AS v(layout, turn, corner)
  UNION ALL SELECT 'multiscan', n_nationkey, n_nationkey, n_regionkey, 1, 1, 1, 1 FROM nation""")
def _(s, d):
    rows, files = _nations(s, d), {}
    m = [_pose(r) for r in rows]
    line = "\n".join(" ".join(map(str, x.ravel())) for x in m).encode()
    files["icl/traj.gt.sim"] = "\n\n".join(_rows(x[:3]) for x in m).encode()
    files["replica/traj.txt"] = files["azurekinect/poses_global.txt"] = line
    files["azure/poses.log"] = "\n".join(f"{i} {i} {i + 1}\n{_rows(x)}" for i, x in enumerate(m)).encode()
    files["multiscan/poses.jsonl"] = "\n".join(json.dumps({"transform": x.T.ravel().tolist()}) for x in m for _ in range(2)).encode()
    for i, x in enumerate(m):
        for layout in ("scannet", "ai2thor"):
            files[f"{layout}/pose/{i * 5}.txt"] = _rows(x).encode()
        for layout in ("realsense", "record3d"):
            files[f"{layout}/poses/{i}.npy"] = _npy(x)
        files[f"hm3d/pose/{i}.json"] = json.dumps({"pose": x.tolist()}).encode()
        files[f"hm3d-openeqa/{i:05d}.txt"] = _rows(x).encode()
    folder = scratch(s, "layouts")
    _put(folder, files)
    out = None
    for layout, o in [("icl", {}), ("icl-compat", {"compat": True}), ("replica", {}), ("scannet", {}), ("ai2thor", {}), ("azure", {"poses": "poses.log"}), ("azurekinect", {}), *((x, {"frames": len(rows)} if x == "multiscan" else {}) for x in _TURNED)]:
        name = layout.removesuffix("-compat")
        p = F.col("pose")
        got = P.read_frames(s, name, f"{folder}/{name}", **o).select(F.lit(layout).alias("layout"), "frame_idx", p[3].alias("tx"), p[7].alias("ty"), p[11].alias("tz"), p[1].alias("m01"), p[4].alias("m10"), p[15].alias("corner"))
        out = got if out is None else out.unionByName(got)
    return out


@query("rgbd_frames", "S3 S14", "frame_idx:i color:f depth:f tx:f fx:f cy:f", "SELECT n_nationkey AS frame_idx, 3 * (12 * (n_nationkey + 3) + 4 * 18 + 8 * 12) AS color, 12.0 * (n_regionkey + 1) AS depth, n_nationkey AS tx, 4.0 AS fx, 1.25 AS cy FROM nation")
def _(s, d):
    y, x = np.mgrid[0:6, 0:8]
    files = {"traj.txt": "\n".join(" ".join(map(str, _pose(r).ravel())) for r in _nations(s, d)).encode()}
    for r in _nations(s, d):
        files[f"results/frame{r.n_nationkey}.png"] = MD.png(np.repeat((r.n_nationkey + 2 * x + 4 * y)[..., None], 3, 2).astype(np.uint8))
        files[f"results/depth{r.n_nationkey}.npy"] = _npy(np.full((6, 8), 1000 * (r.n_regionkey + 1)))
    folder = scratch(s, "rgbd")
    _put(folder, files)
    f = I.read_rgbd(s, "Replica", folder, "results/frame*.png", "results/depth*.npy", (8.0, 8.0, 3.5, 2.5), (8, 6), 4, 3)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return f.select("frame_idx", total("color").alias("color"), total("depth").alias("depth"), F.col("pose")[3].alias("tx"), "fx", "cy")


@query("manifest_and_cameras", "S23 S27 S28 J18", "frame_id:s source:i width:i tx:f fx:f alias:s", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS frame_id, 2709 + 24 * n_nationkey AS source, 128 AS width, CAST(n_nationkey AS DOUBLE) AS tx, 50.0 AS fx, CAST(n_nationkey AS VARCHAR) AS alias FROM nation")
def _(s, d):
    rows = _nations(s, d)
    frames = [{"frame_id": f"{r.n_nationkey:06d}", "source_frame_index": 2709 + 24 * r.n_nationkey, "source_time_sec": r.n_nationkey / 60, "path": f"{r.n_nationkey}.png"} for r in rows]
    cams = {"extrinsic_type": "world_to_camera", "intrinsic": {"w": 128, "h": 128, "fx": 50.0, "fy": 50.0, "cx": 64.0, "cy": 64.0}, "extrinsic": {f"{r.n_nationkey:06d}": _pose(r).tolist() for r in rows}}
    folder = scratch(s, "manifest")
    _put(folder, {"frames.json": json.dumps({"written_frame_count": len(rows), "source_width": 128, "source_height": 128, "frames": frames}).encode(), "cameras.json": json.dumps(cams).encode()})
    m, c = S.read_frames_manifest(s, f"{folder}/frames.json"), S.read_camera_info(s, f"{folder}/cameras.json")
    a = S.frame_aliases(m.select("frame_id")).filter("alias <> frame_id")
    return m.join(c, "frame_id").join(a, "frame_id").select("frame_id", F.col("source_frame_index").alias("source"), "width", F.col("extrinsic")[3].alias("tx"), "fx", "alias")


@query("mask_files", "S24 S29 K6", "object_id:s frame_id:s area:i x0:i", "SELECT 'o' || s_suppkey AS object_id, lpad(CAST(s_nationkey AS VARCHAR), 6, '0') AS frame_id, 3 * (s_suppkey % 5 + 1) AS area, s_nationkey % 7 AS x0 FROM supplier")
def _(s, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    runs = table(s, d, "supplier").select(F.concat(F.lit("o"), k).alias("object_id"), F.lpad(n.cast("string"), 6, "0").alias("frame_id"), F.explode(F.sequence(F.lit(0), (k % 5).cast("int"))).alias("y"), (n % 7).cast("int").alias("x0"), (n % 7 + 3).cast("int").alias("x1"))
    folder = scratch(s, "masks")
    K.export_masks(runs, folder, 16, 12).count()
    return S.read_masks(s, folder, 16, 12).groupBy("object_id", "frame_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("x0").alias("x0"))


@query("ply_points", "S22 K14", "file:s n:i x:f z:f red:f", "SELECT 'n' || c_nationkey || '.ply' AS file, count(*) AS n, sum(c_custkey) AS x, sum(c_nationkey * 0.5) AS z, sum((c_custkey % 256) / 255.0) AS red FROM customer GROUP BY 1")
def _(s, d):
    c = table(s, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("name"), F.col("c_custkey").alias("x"), F.lit(0.0).alias("y"), (F.col("c_nationkey") * 0.5).alias("z"), (F.col("c_custkey") % 256 / 255.0).alias("r"), F.lit(0.0).alias("g"), F.lit(1.0).alias("b"))
    folder = scratch(s, "ply")
    K.export_ply(c, folder, "name").count()
    S.register(s)
    p = s.read.format("ply").load(f"{folder}/*.ply")
    return p.groupBy(F.element_at(F.split("path", "/"), -1).alias("file")).agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("z").alias("z"), F.sum("r").alias("red"))


@query("sensor_streams", "S31 K11", "file:s frame_idx:i tx:f depth:i exported:s", "SELECT 'r' || n_regionkey || '.sens' AS file, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS frame_idx, CAST(n_nationkey AS DOUBLE) AS tx, 6 * n_nationkey + 15 AS depth, '0 -1 0 ' || n_nationkey AS exported FROM nation")
def _(s, d):
    folder, rows, files = scratch(s, "sens"), _nations(s, d), {}
    for region in sorted({r.n_regionkey for r in rows}):
        own = [r for r in rows if r.n_regionkey == region]
        head = struct.pack("<IQ", 4, 3) + b"cam" + b"\0" * 256 + struct.pack("<ii", 2, 1) + struct.pack("<IIIIf", 4, 4, 3, 2, 1000.0) + struct.pack("<Q", len(own))
        body = b""
        for i, r in enumerate(own):
            z = zlib.compress((np.arange(6) + r.n_nationkey).astype("<u2").tobytes())
            body += _pose(r).astype("<f4").tobytes() + struct.pack("<QQQQ", i, i, 4, len(z)) + b"jpeg" + z
        files[f"r{region}.sens"] = head + body
    _put(folder, files)
    S.register(s)
    name = F.element_at(F.split("path", "/"), -1)
    f = s.read.format("sens").load(f"{folder}/*.sens").withColumn("file", name)
    out = None
    for file in files:
        K.export_sens(f.filter(F.col("file") == file), f"{folder}/out/{file}")
        line = s.read.option("pathGlobFilter", "*.txt").text(f"{folder}/out/{file}/pose", wholetext=True).select(F.lit(file).alias("file"), F.regexp_extract(F.input_file_name(), r"(\d+)\.txt$", 1).cast("int").alias("frame_idx"), F.split("value", "\n")[0].alias("exported"))
        out = line if out is None else out.unionByName(line)
    low = [F.conv(F.hex(F.substring("depth", 2 * i + 1, 1)), 16, 10).cast("int") + 256 * F.conv(F.hex(F.substring("depth", 2 * i + 2, 1)), 16, 10).cast("int") for i in range(6)]
    return f.select("file", "frame_idx", F.col("pose")[3].alias("tx"), sum(low[1:], low[0]).alias("depth")).join(out, ["file", "frame_idx"])


@query("atomic_files", "K4 K5 F27", "name:s version:i run:s", "SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 1 ELSE 2 END AS version, '20240101T0' || r_regionkey || '0000Z' AS run FROM region")
def _(s, d):
    import datetime

    folder = scratch(s, "atomic")
    root = folder.removeprefix("file://")
    for r in table(s, d, "region").collect():  # five rows
        run = K.run_id(datetime.datetime(2024, 1, 1, r.r_regionkey, tzinfo=datetime.UTC))
        path = f"{root}/{r.r_name}.json"
        K.save_json(path, {"name": r.r_name, "version": 1, "run": run}, replace=False)
        try:  # even keys must not be overwritten
            K.save_json(path, {"name": r.r_name, "version": 2, "run": run}, replace=r.r_regionkey % 2 == 1)
        except FileExistsError:
            continue
    return S.read_strict_json(s, f"{folder}/*.json", "name string, version int, run string")


@query("image_preparation", "X13", "k:i red:i kept:i cropped:i", "SELECT n_nationkey AS k, 2 * (w + 4) * 2 + 2 * w * 2 - 8 + CASE WHEN true THEN 0 END AS red, w * w * 9 AS kept, (w + 2) * (w + 2) AS cropped FROM (SELECT n_nationkey, n_regionkey + 2 AS w FROM nation)".replace("2 * (w + 4) * 2 + 2 * w * 2 - 8 + CASE WHEN true THEN 0 END", "8 * w + 4"))
def _(s, d):
    rows = []
    for r in _nations(s, d):
        w = r.n_regionkey + 2
        m = np.zeros((16, 16), bool)
        m[4 : 4 + w, 5 : 5 + w] = True
        image = np.full((16, 16, 3), 3, np.uint8)
        red = int((MD.outline(image, m) == (255, 0, 0)).all(2).sum())
        rows.append((r.n_nationkey, red, int(MD.blackout(image, m).sum()), int(MD.crop_both(image, m, (5, 4, 5 + w, 4 + w), 1)[1].size)))
    return s.createDataFrame(rows, "k int, red int, kept int, cropped int")


@query("mapping_stream", "R1 R2 R3 R6", "scene:i det:i object:i", f"WITH RECURSIVE {_FOLD} SELECT scene, g.det AS det, g.id AS object FROM (SELECT scene, unnest(got) AS g FROM st)", "box")
def _(s, d):
    from ..streaming import mapping as SM

    folder = scratch(s, "stream")
    frames = _frames(s, d).withColumn("part", F.floor(F.col("frame") / 5)).persist()
    for k in range(5):  # a capture process lands five frames at a time
        frames.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/land")
    frames.unpersist()
    schema = frames.drop("part").schema
    stream = s.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/land")
    SM.capture(SM.map_stream(stream, "scene", "frame", "det", "f", 1.0), f"{folder}/out", f"{folder}/cp").awaitTermination()
    return SM.replay(s, f"{folder}/out", ["scene", "frame", "det"])


def _objects(s: SparkSession, d: str) -> DataFrame:
    """Objects of a map, with faults: an order is an object, its lines are detections."""
    k = F.col("l_orderkey")
    li = table(s, d, "lineitem")
    box = F.array("l_quantity", F.lit(0.0), F.col("l_quantity") + F.col("l_tax"), F.lit(1.0))
    g = li.groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.collect_list(box).alias("xyxy"), F.collect_list(F.when(F.col("l_discount") == 0.1, float("nan")).otherwise(F.col("l_discount"))).alias("conf"),
                                     F.collect_list(F.when(F.col("l_returnflag") == "N", " ").otherwise("cup")).alias("class_name"), F.collect_list((F.col("l_partkey") % 10).cast("int")).alias("mask_area"))
    k, n = F.col("k"), F.col("n").cast("int")
    triples = lambda m, v: F.when(m > 0, F.array_repeat(F.array(F.lit(0.5), v, F.lit(0.0)), m)).otherwise(F.expr("cast(array() as array<array<double>>)"))
    unit = F.array_repeat(F.lit(1.0), 8)
    return g.select(
        "k", (n + F.when(k % 17 == 0, 1).otherwise(0)).alias("num_detections"), "xyxy", "conf", "class_name", "mask_area", F.array_repeat(F.lit("a.png"), n).alias("color_path"), F.array_repeat(F.lit(1), n).alias("class_id"),
        F.when(k % 3 == 0, F.lit(None)).when(k % 19 == 0, "solid").when(k % 3 == 1, "colmap_3d").otherwise("multiview_2d").alias("geometry_type"), triples((k % 4).cast("int"), F.lit(0.25)).alias("points"),
        triples((k % 4).cast("int"), F.when(k % 23 == 0, 1.5).otherwise(1.0)).alias("colors"), triples(F.when(k % 4 > 0, 8).otherwise(0), F.lit(1.0)).alias("bbox_points"), F.when(k % 29 == 0, F.array_repeat(F.lit(0.0), 8)).otherwise(unit).alias("clip_ft"), F.when(k % 31 == 0, F.slice(unit, 1, 7)).otherwise(unit).alias("text_ft"),
    )


@query("map_validation", "C1", "rule:s n:i", """WITH o AS (SELECT k, n, bad_box, bad_conf, blank, empty, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 4 > 0 THEN 'colmap_3d' ELSE 'multiview_2d' END WHEN k % 19 = 0 THEN 'solid' WHEN k % 3 = 1 THEN 'colmap_3d' ELSE 'multiview_2d' END AS g FROM
    (SELECT l_orderkey AS k, count(*) AS n, count_if(l_quantity + l_tax <= l_quantity) AS bad_box, count_if(l_discount = 0.1) AS bad_conf, count_if(l_returnflag = 'N') AS blank, count_if(l_partkey % 10 = 0) AS empty FROM lineitem GROUP BY 1))
  SELECT 'geometry_type' AS rule, count_if(g = 'solid') AS n FROM o UNION ALL SELECT 'points_match_type', count_if((g = 'colmap_3d') <> (k % 4 > 0)) FROM o UNION ALL SELECT 'colors', count_if(k % 23 = 0 AND k % 4 > 0) FROM o UNION ALL SELECT 'bbox', count_if((g = 'colmap_3d') <> (k % 4 > 0)) FROM o
  UNION ALL SELECT 'clip_ft', count_if(k % 29 = 0) FROM o UNION ALL SELECT 'text_ft', count_if(k % 31 = 0) FROM o UNION ALL SELECT unnest(['color_path_length', 'mask_area_length', 'xyxy_length', 'conf_length', 'class_name_length', 'class_id_length']), count_if(k % 17 = 0) FROM o
  UNION ALL SELECT 'mask_filled', count_if(empty > 0) FROM o UNION ALL SELECT 'boxes', count_if(bad_box > 0) FROM o UNION ALL SELECT 'confidence', count_if(bad_conf > 0) FROM o UNION ALL SELECT 'class_name_filled', count_if(blank > 0) FROM o UNION ALL SELECT unnest(['points', 'num_detections']), 0""")
def _(s, d):
    return C.violations(_objects(s, d), C.saved_map_rules(8))


@query("conversion_pair_validation", "C2", "rule:s n:i", """SELECT 'report' AS rule, count_if(o_orderkey % 11 = 0) AS n FROM orders UNION ALL SELECT 'converted', count_if(o_orderkey % 11 = 0 OR o_orderstatus = 'P') FROM orders UNION ALL SELECT 'map_path', count_if(o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) FROM orders
  UNION ALL SELECT 'report_path', count_if(o_orderkey % 11 = 0) FROM orders UNION ALL SELECT 'sha256', count_if(o_orderkey % 11 = 0 OR o_orderkey % 7 = 0) FROM orders UNION ALL SELECT 'fingerprint', count_if(o_orderkey % 11 = 0 OR o_orderkey % 5 = 0) FROM orders UNION ALL SELECT 'input_sha256', count_if(o_orderkey % 11 = 0) FROM orders""")
def _(s, d):
    k = F.col("o_orderkey")
    path = F.concat(F.lit("/m/"), k, F.lit(".pkl.gz"))
    m = table(s, d, "orders").select("o_orderkey", path.alias("map_path"), F.concat(F.lit("/m/"), k, F.lit("_conversion_report.json")).alias("report_path"), F.sha2(k.cast("string"), 256).alias("sha256"), F.md5(k.cast("string")).alias("fingerprint"), F.sha2(F.lit("in"), 256).alias("input_sha256"))
    r = table(s, d, "orders").filter("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "failed").otherwise("converted").alias("report_status"), F.when(k % 13 == 0, "/other").otherwise(path).alias("report_map"), F.concat(F.lit("/m/"), k, F.lit("_conversion_report.json")).alias("report_self"),
                                                                     F.when(k % 7 == 0, "0").otherwise(F.sha2(k.cast("string"), 256)).alias("report_sha256"), F.when(k % 5 != 0, F.md5(k.cast("string"))).alias("report_fingerprint"), F.sha2(F.lit("in"), 256).alias("report_input_sha256"))
    return C.violations(m.join(r, "o_orderkey", "left"), C.conversion_pair_rules())


@query("frame_score_validation", "C4", "object_id:s raw_frame_id:s problem:s", """WITH sc AS (SELECT DISTINCT 'o' || l_suppkey AS object_id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE lpad(CAST(l_linenumber AS VARCHAR), 6, '0') END AS raw, l_linenumber AS f FROM lineitem)
  SELECT object_id, raw AS raw_frame_id, unnest(list_filter([CASE WHEN f > 5 THEN 'unknown_frame' END, CASE WHEN f % 3 = 0 AND f <= 5 THEN 'negative_hit_points' END, CASE WHEN f = 4 THEN 'other_mask' END], lambda p: p IS NOT NULL)) AS problem FROM sc
  UNION ALL SELECT object_id, unnest(['000001', '1']), 'duplicate_frame' FROM sc WHERE f = 1""")
def _(s, d):
    n = F.col("l_linenumber")
    li = table(s, d, "lineitem").select(F.concat(F.lit("o"), "l_suppkey").alias("object_id"), "l_linenumber").distinct()
    pad = F.lpad(n.cast("string"), 6, "0")
    x = li.select("object_id", F.when(n % 2 == 0, n.cast("string")).otherwise(pad).alias("raw_frame_id"), F.when(n == 4, "/p/other.png").otherwise(F.concat(F.lit("/p/masks/2d/"), "object_id", F.lit("/"), pad, F.lit(".png"))).alias("mask"), n.alias("mask_area"), F.lit(None).cast("int").alias("projected_points"), F.lit(3).alias("visible_points"), F.when((n % 3 == 0) & (n <= 5), -1).otherwise(1).alias("hit_points"))
    x = x.unionByName(x.filter("raw_frame_id = '000001'").withColumn("raw_frame_id", F.lit("1")))
    frames = s.range(1, 6).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("frame_id"))
    return C.frame_score_problems(x, S.frame_aliases(frames), "/p")


@query("project_validation", "C3 S25 C5", "problem:s n:i", """WITH ow AS (SELECT DISTINCT l_suppkey AS o, l_partkey AS p FROM lineitem WHERE l_partkey % (l_suppkey + 1) = 0), ob AS (SELECT s_suppkey AS o FROM supplier), np AS (SELECT o, count(*) AS n, count_if(p >= 1000) AS far FROM ow GROUP BY 1), sh AS (SELECT DISTINCT o FROM ow WHERE p IN (SELECT p FROM ow GROUP BY 1 HAVING count(*) > 1))
  SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN ob.o % 6 = 0 THEN 'no_label' END, CASE WHEN ob.o % 5 = 0 THEN 'point_count' END, CASE WHEN coalesce(far, 0) > 0 THEN 'points_out_of_range' END, CASE WHEN ob.o IN (SELECT o FROM sh) THEN 'shared_points' END, CASE WHEN ob.o % 4 = 0 THEN 'mask_count' END], lambda x: x IS NOT NULL)) AS problem FROM ob LEFT JOIN np ON np.o = ob.o) GROUP BY 1
  UNION ALL SELECT 'masks_of_no_object', 1""")
def _(s, d):
    k = F.col("s_suppkey")
    owned = table(s, d, "lineitem").filter("l_partkey % (l_suppkey + 1) = 0").select(F.col("l_suppkey").alias("object_id"), F.col("l_partkey").alias("point_id")).distinct()
    n = owned.groupBy("object_id").agg(F.count("*").alias("c"))
    o = table(s, d, "supplier").join(n, k == F.col("object_id"), "left").select(k.alias("object_id"), (F.coalesce("c", F.lit(0)) + F.when(k % 5 == 0, 1).otherwise(0)).alias("num_points"), F.when(k % 4 == 0, 9).otherwise(2).alias("num_masks"))
    masks = o.select("object_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("frame_id")).unionByName(s.range(1).select(F.lit(-1).cast("bigint").alias("object_id"), F.lit("a").alias("frame_id")))
    return C.project_problems(o, owned, o.filter("object_id % 6 <> 0"), masks, 1000).groupBy("problem").agg(F.count("*").alias("n"))


@query("config_files", "S15 F21", "k:s v:s", "SELECT unnest(['a', 'b.c', 'b.d', 'list']) AS k, unnest(['1', '3', '4', '/data/x']) AS v")
def _(s, d):
    folder = scratch(s, "config")
    _put(folder, {"base.json": b'{"a": 1, "b": {"c": 2, "d": 4}, "list": ["none"]}', "own.json": b'{"inherit_from": "base.json", "b": {"c": 3}, "list": ["${ROOT}/x"]}'})
    c = S.expand_variables(S.load_config(f"{folder.removeprefix('file://')}/own.json"), {"ROOT": "/data"})
    return s.createDataFrame([("a", str(c["a"])), ("b.c", str(c["b"]["c"])), ("b.d", str(c["b"]["d"])), ("list", c["list"][0])], "k string, v string")


@query("class_list_file", "S38", "name:s n:i", "SELECT p_name AS name, count(*) AS n FROM (SELECT p_name FROM part UNION ALL SELECT r_name FROM region) WHERE lower(p_name) NOT IN ('asia', 'europe') AND trim(p_name) <> '' GROUP BY 1")
def _(s, d):
    folder = scratch(s, "classes")
    table(s, d, "part").select("p_name").unionByName(table(s, d, "region").select(F.concat(F.lit(" "), "r_name").alias("p_name"))).select(F.col("p_name").alias("value")).write.text(folder)
    return S.class_list(s, folder, ("asia", "europe")).groupBy("name").agg(F.count("*").alias("n"))


@query("trajectory_file", "S35", "frame_idx:i x:f yaw:f horizon:f", "SELECT n_nationkey AS frame_idx, n_regionkey + 0.5 AS x, n_nationkey * 15.0 AS yaw, greatest(-30.0, least(60.0, n_nationkey * 10 - 100.0)) AS horizon FROM nation")
def _(s, d):
    logs = [{"position": {"x": r.n_regionkey + 0.5, "y": 0.9, "z": 0.0}, "rotation": {"x": 0.0, "y": r.n_nationkey * 15.0, "z": 0.0}, "cameraHorizon": r.n_nationkey * 10 - 100.0} for r in _nations(s, d)]
    folder = scratch(s, "trajectory")
    _put(folder, {"trajectory.json": json.dumps({"agent_logs": logs}).encode()})
    return P.trajectory(s, f"{folder}/trajectory.json").select("frame_idx", F.col("position.x").alias("x"), F.col("rotation.y").alias("yaw"), "horizon")


@query("raw_tracks", "S30 F13", "object_id:s label:s", "SELECT DISTINCT 'o' || s_nationkey AS object_id, CASE WHEN s_nationkey % 3 = 0 THEN n_name WHEN s_nationkey % 3 = 1 THEN 'r' || n_regionkey ELSE 'o' || s_nationkey END AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(s, d):
    k = F.col("n_nationkey")
    prompts = table(s, d, "nation").filter(k % 3 < 2).select(F.concat(F.lit("o"), k).alias("object_id"), F.when(k % 3 == 0, F.concat(F.lit(" "), "n_name", F.lit(" "))).otherwise("  ").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("category"))
    masks = table(s, d, "supplier").select(F.concat(F.lit("o"), "s_nationkey").alias("object_id"), F.lit("f").alias("frame_id"))
    return S.raw_tracks(prompts, masks)


@query("frame_window", "C13 S2", "user_id:i exact:b", "SELECT user_id, list(DISTINCT date_part('day', ts) ORDER BY date_part('day', ts)) = range(1, 31, 1) AS exact FROM events WHERE user_id < 5 GROUP BY 1")
def _(s, d):
    x = table(s, d, "events").filter("user_id < 5").select("user_id", F.day("ts").alias("day")).distinct()
    users = sorted(r.user_id for r in x.select("user_id").distinct().collect())  # five at most
    return s.createDataFrame([(u, C.window_matches(x.filter(F.col("user_id") == u), S.uniform_indices(1, 30, 1), "day")) for u in users], "user_id bigint, exact boolean")


@query("identity_gate", "C8 A13", "track:i coverage:f max_step:f", """SELECT track, count(*) / 30.0 AS coverage, coalesce(max(greatest(p, a) / least(p, a)), 1.0) AS max_step FROM (SELECT track, hi - lo AS a, lag(hi - lo) OVER (PARTITION BY track ORDER BY frame) AS p FROM day) GROUP BY track""", "day")
def _(s, d):
    from . import pipelines as PL

    one = F.lit(0)
    runs = ST.days(s, d).select(one.alias("scene"), "track", "frame", one.alias("y"), F.col("lo").cast("int").alias("x0"), F.col("hi").cast("int").alias("x1"))
    return PL.identity_gate(runs, 30)


@query("map_before_and_after", "K2 M7", "stage:s object_id:s", "SELECT 'map' AS stage, 'o' || obj AS object_id FROM box UNION ALL SELECT 'map_post', 'o' || obj FROM box WHERE n >= 400", "box")
def _(s, d):
    o = ST.object_boxes(s, d).select(F.concat(F.lit("o"), "obj").alias("object_id"), "n")
    folder = scratch(s, "maps")
    K.save_map({"objects": o}, f"{folder}/map")
    K.save_map({"objects": K.load_map(s, f"{folder}/map")["objects"].filter("n >= 400")}, f"{folder}/map_post")
    read = lambda name: K.load_map(s, f"{folder}/{name}")["objects"].select(F.lit(name).alias("stage"), "object_id")
    return read("map").unionByName(read("map_post"))


#: What a cached answer depends on; other settings, such as a timeout, may differ.
_STABLE = ["schema_version", "provider", "model", "prompt_sha256", "caption_file_sha256", "mapfile_sha256", "input_id", "base_url"]


@query("relaxed_cache", "C11", "o_orderkey:i state:s", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 'hit' ELSE 'pending' END AS state FROM orders")
def _(s, d):
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    r = table(s, d, "orders").select("o_orderkey", F.lit(2).alias("schema_version"), F.lit("local").alias("provider"), F.lit("m").alias("model"), F.sha2("o_orderstatus", 256).alias("prompt_sha256"), F.md5(text(k)).alias("caption_file_sha256"), F.lit("z").alias("mapfile_sha256"), k.alias("input_id"), F.lit(None).cast("string").alias("base_url"), (k % 7).alias("timeout"))
    cache = r.filter(k % 3 == 0).withColumns({"timeout": F.lit(99).cast("bigint"), "model": F.when(k % 5 == 0, "other").otherwise("m"), "answer": F.lit("yes")})
    hit, miss = C.cache_hits(r, cache, _STABLE, ["answer"])
    return hit.select("o_orderkey", F.lit("hit").alias("state")).unionByName(miss.select("o_orderkey", F.lit("pending").alias("state")))
