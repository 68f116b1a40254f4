"""Queries that write and read back (maps, graphs, snapshots, pose files), sample, and prepare requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as T
from ..operators import constraints as C
from ..operators import filters as FI
from ..operators import models as MD
from ..session import table
from ..sinks import files as K
from ..sources import poses as P
from ..storage import scratch
from . import standins as S
from .registry import query


@query("map_round_trip", "K1 S20 S21", "object_id:s point_count:i background:b", "SELECT 'o' || obj AS object_id, n AS point_count, obj % 7 = 0 AS background FROM box WHERE obj % 7 <> 0", "box")
def _(s, d):
    o = S.object_boxes(s, d).select(F.concat(F.lit("o"), "obj").alias("object_id"), F.lit("colmap_3d").alias("geometry_type"), F.col("n").alias("point_count"), F.struct("min_x", "max_x").alias("bbox"), (F.col("obj") % 7 == 0).alias("is_background"))
    folder = scratch(s, "map")
    K.save_map({"objects": o}, folder, {"version": 1})
    return K.load_map(s, folder, background=False)["objects"].withColumnRenamed("is_background", "background")


@query("frame_snapshots", "K3 R4 R6", "frame:i objects:i", "SELECT frame, count(*) AS objects FROM day WHERE n >= 2 GROUP BY 1", "day")
def _(s, d):
    folder = scratch(s, "snapshots")
    K.save_snapshot(S.days(s, d), "frame", folder, "n", 2)
    return s.read.parquet(folder).groupBy("frame").agg(F.count("*").alias("objects"))


@query("graph_round_trip", "K7 K9 K10", "name:s regions:i", "SELECT n_name AS name, n_regionkey AS regions FROM nation")
def _(s, d):
    g = table(s, d, "nation").select(F.col("n_name").alias("key"), F.to_json(F.struct("n_regionkey")).alias("value"))
    folder = scratch(s, "graph")
    K.save_graph(g, folder)
    m = F.from_json("value", "map<string, struct<n_regionkey: int>>")
    return s.read.text(folder).select(F.explode(m).alias("name", "v")).select("name", F.col("v.n_regionkey").alias("regions"))


@query("metrics_csv", "K8", "flag:s qty:f", "SELECT l_returnflag AS flag, avg(l_quantity) AS qty FROM lineitem GROUP BY 1")
def _(s, d):
    folder = scratch(s, "metrics")
    K.save_metrics(table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.avg("l_quantity").alias("qty")), folder)
    return s.read.option("header", True).schema("flag string, qty double").csv(folder)


@query("pose_file_round_trip", "S1 S2 S5 S6", "frame_idx:i tx:f", "SELECT n_nationkey AS frame_idx, CAST(n_regionkey AS DOUBLE) AS tx FROM nation WHERE n_nationkey >= 2 AND n_nationkey % 2 = 0")
def _(s, d):
    folder = scratch(s, "poses")
    line = F.concat_ws(" ", *(F.col("n_regionkey").cast("string") if i == 3 else F.lit("1" if i % 5 == 0 else "0") for i in range(16)))
    table(s, d, "nation").orderBy("n_nationkey").coalesce(1).select(line.alias("value")).write.text(f"{folder}/traj.txt")
    return P.read_frames(s, "Replica", folder, start=2, stride=2).select("frame_idx", F.col("pose")[3].alias("tx"))


_HASH = "CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"


@query("bernoulli_sample", "P18", "o_orderkey:i", f"SELECT o_orderkey FROM orders WHERE {_HASH.format(seed=7, key='o_orderkey')} < CAST(floor(0.3 * 4294967296) AS BIGINT)")
def _(s, d):
    return FI.bernoulli(table(s, d, "orders").select("o_orderkey"), F.col("o_orderkey"), 0.3, 7)


@query("pose_samples", "S36", "x:f z:f yaw:f", f"SELECT x, z, yaw FROM (SELECT DISTINCT x, z FROM pts ORDER BY {_HASH.format(seed=3, key="x || ',' || z")}, x, z LIMIT 40), (SELECT unnest(range(0, 8)) * 45.0 AS yaw)", "pts")
def _(s, d):
    return P.sample_poses(S.points(s, d).select("x", "z").distinct(), 40, seed=3)


@query("random_poses", "S37", "id:i x:f z:f yaw:f", f"SELECT id, x, z, {_HASH.format(seed=4, key='id')} / 4294967296.0 * 360 AS yaw FROM (SELECT unnest(range(0, 200)) AS id, 1 AS j) JOIN (SELECT x, z, row_number() OVER (ORDER BY x, z) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT x, z FROM pts)) ON r = {_HASH.format(seed=3, key='id')} % n", "pts")
def _(s, d):
    return P.sample_poses(S.points(s, d).select("x", "z").distinct(), 200, seed=3, replace=True)


@query("depth_clip", "S34", "l_orderkey:i depth:f", "SELECT l_orderkey, sum(CASE WHEN l_quantity / 3 > 15 THEN 0 ELSE round_even(l_quantity / 3, 3) END) AS depth FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(P.depth_meters(F.col("l_quantity") / 3)).alias("depth"))


@query("topdown_footprint", "V26", "obj:i px:f py:f pw:f ph:f", "SELECT obj, (min_x - lx) * k AS px, (min_z - lz) * k AS py, (max_x - min_x) * k AS pw, (max_z - min_z) * k AS ph FROM box, (SELECT min(min_x) AS lx, min(min_z) AS lz, 100.0 / greatest(max(max_x) - min(min_x), max(max_z) - min(min_z)) AS k FROM box)", "box")
def _(s, d):
    b = S.object_boxes(s, d)
    ends = b.agg(*(f(f"{n}_{a}").alias(f"{k}_{a}") for n, f, k in (("min", F.min, "lo"), ("max", F.max, "hi")) for a in "xyz"))
    x = b.crossJoin(F.broadcast(ends))  # one row
    fp = B.footprint(B.Box(), [F.col(f"lo_{a}") for a in "xyz"], [F.col(f"hi_{a}") for a in "xyz"], 100.0)
    return x.select("obj", *(c.alias(n) for n, c in fp.items()))


@query("path_remap", "F28 F30", "k:i path:s report:s", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN '/new/' ELSE '/old/' END || n_name || '.pkl.gz' AS path, '/old/' || n_name || '_conversion_report.json' AS report FROM nation")
def _(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("/old/"), "n_name", F.lit(".pkl.gz")).alias("p"))
    there = n.filter("k % 2 = 0").agg(F.collect_set(F.concat(F.lit("/new/"), F.substring("p", 6, 1000))).alias("there"))
    return n.crossJoin(F.broadcast(there)).select("k", T.path_remap(F.col("p"), "/old", "/new", F.col("there")).alias("path"), T.report_path(F.col("p")).alias("report"))


@query("reply_tags", "F8 F5", "k:i tag:s", "SELECT p_partkey AS k, p_name AS tag FROM part")
def _(s, d):
    reply = F.concat(F.lit('well: {"object_tag" : "'), "p_name", F.lit('", "more": '))
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), T.scan_tag(reply).alias("tag"))


@query("config_overlay", "F20", "k:i a:i b:i c:i", "SELECT n_nationkey AS k, 1 AS a, n_regionkey AS b, n_nationkey AS c FROM nation")
def _(s, d):
    k, r = F.col("n_nationkey").cast("int"), F.col("n_regionkey").cast("int")
    m = T.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), r, F.lit("c"), k))
    return table(s, d, "nation").select(k.alias("k"), m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


@query("prompts_and_replies", "X11 C12", "doc_id:i turns:i reply:s status:s", "SELECT doc_id, 4 AS turns, upper(source) AS reply, 'complete' AS status FROM documents")
def _(s, d):
    x = table(s, d, "documents").select("doc_id", "source")
    asked = x.withColumn("turns", F.size(MD.prompt("You name sources.", [("a", "A")], F.col("source"))))
    got = MD.call_model(asked, "reply string", lambda r: {"reply": r["source"].upper()})
    done = C.progress(got.withColumn("state", F.when(F.col("error").isNull(), "hit").otherwise("pending")), "state")
    return got.crossJoin(F.broadcast(done.select("status")))


@query("project_conversion", "M11 P11 A3 A18 A22 K13", "object_id:i geometry_type:s views:i class_id:i", None)
def _(s, d):
    from . import pipelines as PL

    x = S.detections(s, d)
    one = F.lit(0)
    o = x.select(one.alias("scene"), F.col("class_id").alias("object_id"), F.concat(F.lit("class "), "class_id").alias("label")).distinct()
    runs = x.select(one.alias("scene"), F.col("class_id").alias("object_id"), F.col("frame").alias("frame_id"), F.col("y1").cast("int").alias("y"), (F.col("y1").cast("int") + 61).alias("y1"), F.col("x1").cast("int").alias("x0"), (F.col("x1").cast("int") + 60).alias("x1"))
    pts = S.points(s, d).select(one.alias("scene"), (F.col("obj") % 20).alias("object_id"), F.col("pid").alias("point_id"), "x", "y", "z")
    f = table(s, d, "embeddings").select(one.alias("scene"), F.col("label").cast("bigint").alias("object_id"), F.col("vec_id").alias("frame_id"), F.col("embedding").alias("feature"))
    return PL.convert_project(o, runs, pts, f, 128, 128)[0]
