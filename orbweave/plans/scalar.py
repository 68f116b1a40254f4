"""Queries of the scalar library: labels, tokens, JSON, hashes, boxes, poses, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import poses as P
from ..functions import text as T
from ..functions import vectors as V
from ..operators import mapping as M
from ..session import table
from . import standins as S
from .registry import query


@query("label_normalize", "F1 U4", "k:i label:s", "SELECT p_partkey AS k, trim(regexp_replace(lower(replace(p_name || '_' || p_type, '_', ' ')), '\\s+', ' ', 'g')) AS label FROM part")
def _(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), T.normalize_label(F.concat_ws("_", "p_name", "p_type")).alias("label"))


@query("slug", "F2 F18", "k:i slug:s safe:b", """SELECT k, slug, regexp_matches(slug, '^[A-Za-z0-9][A-Za-z0-9_.-]*$') AS safe FROM (SELECT page_id AS k,
  coalesce(nullif(regexp_replace(regexp_replace(trim(regexp_replace(lower(replace(url, '_', ' ')), '\\s+', ' ', 'g')), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'object') AS slug FROM pages)""")
def _(s, d):
    x = table(s, d, "pages").select(F.col("page_id").alias("k"), T.slug(F.col("url")).alias("slug"))
    return x.withColumn("safe", T.is_safe_id(F.col("slug")))


@query("token_normalize", "F3 F4", "k:i token:s upper:s", """SELECT k, lower(t) AS token, upper(t) AS upper FROM (SELECT p_partkey AS k,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(p_brand || 'Of ' || p_name), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS t FROM part)""")
def _(s, d):
    x = F.concat(F.col("p_brand"), F.lit("Of "), F.col("p_name"))
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), T.normalize_token(x).alias("token"), T.normalize_token(x, True).alias("upper"))


@query("token_list", "F4 U5 F15", "k:i tokens:s", "SELECT p_size AS k, array_to_string(list_distinct_ordered, '|') AS tokens FROM (SELECT p_size, list(t ORDER BY m) AS list_distinct_ordered FROM (SELECT p_size, replace(p_name, ' ', '_') AS t, min(p_partkey) AS m FROM part GROUP BY ALL) GROUP BY p_size)")
def _(s, d):
    g = table(s, d, "part").groupBy(F.col("p_size").alias("k")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    return g.select("k", F.array_join(T.normalize_tokens(F.col("x.p_name")), "|").alias("tokens"))


@query("json_object_extract", "F5 F6 F7 F22", "k:i obj:s v:i exact:b", """SELECT event_id AS k, regexp_extract('note: ```json' || chr(10) || props || chr(10) || '``` end', '(?s)\\{.*\\}') AS obj, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v,
  list_sort(json_keys(props)) = ['k'] AS exact FROM events""")
def _(s, d):
    t = F.concat(F.lit("note: ```json\n"), F.col("props"), F.lit("\n``` end"))
    x = table(s, d, "events").select(F.col("event_id").alias("k"), T.json_object_text(t).alias("obj"))
    return x.select("k", "obj", F.get_json_object("obj", "$.k").cast("bigint").alias("v"), T.has_exact_keys(F.col("obj"), ["k"]).alias("exact"))


@query("canonical_hash", "F9 F11 C9", "k:i sha:s", """SELECT n_nationkey AS k, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS sha FROM nation""")
def _(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("k"), T.canonical_hash("n_regionkey", "n_name", "n_nationkey").alias("sha"))


@query("tree_digest", "F10", "source:s sha:s n:i", "SELECT source, sha256(string_agg(h, chr(10) ORDER BY doc_id)) AS sha, count(*) AS n FROM (SELECT source, doc_id, sha256(text) AS h FROM documents) GROUP BY source")
def _(s, d):
    x = table(s, d, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    g = x.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "h"))).alias("x"), F.count("*").alias("n"))
    return g.select("source", F.sha2(F.array_join("x.h", "\n"), 256).alias("sha"), "n")


@query("stable_color", "F12 D15", "k:i r:f g:f b:f", """SELECT s_suppkey AS k, 0.2 + CAST('0x' || substr(h, 1, 2) AS INTEGER) / 255.0 * 0.75 AS r, 0.2 + CAST('0x' || substr(h, 3, 2) AS INTEGER) / 255.0 * 0.75 AS g,
  0.2 + CAST('0x' || substr(h, 5, 2) AS INTEGER) / 255.0 * 0.75 AS b FROM (SELECT s_suppkey, sha256(s_name) AS h FROM supplier)""")
def _(s, d):
    c = T.stable_color(F.col("s_name"))
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), c[0].alias("r"), c[1].alias("g"), c[2].alias("b"))


@query("object_key", "F16 F13 F17 F23", "k:i name:s det:s prompt:s cache:s", """SELECT p_partkey AS k, lower(regexp_replace(trim(p_name), '[^A-Za-z0-9_]+', '_', 'g')) || '_' || p_partkey AS name, lpad(CAST(p_size AS VARCHAR), 6, '0') || ':' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS det,
  'cg_' || replace(p_name, ' ', '-') || '_f' || p_size || '_d' || p_partkey AS prompt, lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '_' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 16) || '.json' AS cache FROM part""")
def _(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("k"), T.object_key(T.first_nonempty(F.lit("  "), F.col("p_name")), k).alias("name"), T.detection_id(F.lpad(F.col("p_size").cast("string"), 6, "0"), k).alias("det"),
                                      T.prompt_id(F.col("p_name"), F.col("p_size").cast("string"), k).alias("prompt"), T.cache_filename(k, k).alias("cache"))


@query("tag_class_list", "P14 P15 F24", "k:i classes:s n:i", """SELECT k, array_to_string(c, '|') AS classes, len(c) AS n FROM (SELECT doc_id AS k, list_filter(CASE WHEN list_contains(p, 'other item') THEN p ELSE list_append(p, 'other item') END, lambda x: NOT contains(lower(x), 'the')) AS c
  FROM (SELECT doc_id, list_filter(list_transform(string_split(substr(text, 1, 200), ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents))""")
def _(s, d):
    c = T.tag_classes(F.substring("text", 1, 200), ["other item"], ["the"])
    return table(s, d, "documents").select(F.col("doc_id").alias("k"), c.alias("c")).select("k", F.array_join("c", "|").alias("classes"), F.size("c").alias("n"))


@query("caption_cleanup", "F24 P24", "conv_id:i turn:i caption:s low:b", """SELECT conv_id, turn, trim(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS caption, contains(lower(text), 'the ') AS low FROM conversations WHERE conv_id % 5 = 0""")
def _(s, d):
    x = table(s, d, "conversations").filter("conv_id % 5 = 0")
    return x.select("conv_id", "turn", T.clean_caption(F.concat(F.lit("Caption:  "), F.col("text"))).alias("caption"), T.is_low_confidence(F.col("text"), "The ").alias("low"))


@query("category_bucket", "P20 F14 P10", "category:s n:i", "SELECT CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') THEN 'structure' ELSE 'object' END AS category, count(*) AS n FROM part GROUP BY 1")
def _(s, d):
    return table(s, d, "part").groupBy(T.category(F.col("p_name"), ("ring", "bolt")).alias("category")).agg(F.count("*").alias("n"))


@query("round_half_even", "F29 P6", "k:i v:f n:i", "SELECT l_orderkey AS k, sum(round_even(l_quantity / 4, 1)) AS v, count(*) AS n FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY 1")
def _(s, d):
    x = table(s, d, "lineitem").filter("l_orderkey % 10 = 0")
    return x.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.bround(F.col("l_quantity") / 4, 1)).alias("v"), F.count("*").alias("n"))


_I3 = " * ".join(f"greatest(0.0, least(a.max_{c}, b.max_{c}) - greatest(a.min_{c}, b.min_{c}))" for c in "xyz")
_E3 = " * ".join(f"(greatest(a.max_{c}, b.max_{c}) - least(a.min_{c}, b.min_{c}))" for c in "xyz")
_V3 = lambda t: " * ".join(f"({t}.max_{c} - {t}.min_{c})" for c in "xyz")
_BOXES = f"(SELECT a.obj AS a, b.obj AS b, {_I3} AS i, {_E3} AS e, {_V3('a')} AS va, {_V3('b')} AS vb FROM box a JOIN box b ON a.obj < b.obj)"


@query("box_iou_pairs", "G1 G2 J2 G11", "a:i b:i iou:f batch:f share:f encl:f", f"SELECT a, b, i / (va + vb - i) AS iou, i / (va + vb - i + 1e-10) AS batch, greatest(i / va, i / vb) AS share, e AS encl FROM {_BOXES}", "box")
def _(s, d):
    a, b = B.Box("a_"), B.Box("b_")
    return M.box_pairs(S.object_boxes(s, d), "obj", {"iou": B.iou(a, b), "batch": B.spatial("iou", a, b), "share": B.overlap_ratio(a, b), "encl": B.enclosing(a, b)})


@query("box_giou_pairs", "G3 G4 J2", "a:i b:i giou:f batch:f", f"SELECT a, b, i / (va + vb - i) - (e - (va + vb - i)) / e AS giou, i / (va + vb - i + 1e-10) - (e - (va + vb - i)) / (e + 1e-10) AS batch FROM {_BOXES}", "box")
def _(s, d):
    a, b = B.Box("a_"), B.Box("b_")
    return M.box_pairs(S.object_boxes(s, d), "obj", {"giou": B.giou(a, b), "batch": B.spatial("giou", a, b)})


@query("box_containment", "G12 G8 G9", "a:i b:i inside:f strict:b side:f", f"""SELECT a.obj AS a, b.obj AS b, least(1.0, greatest(0.0, {_I3} / ({_V3('a')}))) AS inside, (least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x) > 0 AND least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y) > 0 AND least(a.max_z, b.max_z) - greatest(a.min_z, b.min_z) > 0) AS strict,
  CASE WHEN a.max_z - a.min_z < 7.5 THEN 7.5 ELSE a.max_z - a.min_z END AS side FROM box a JOIN box b ON a.obj < b.obj WHERE a.obj % 4 = 0""", "box")
def _(s, d):
    a, b = B.Box("a_"), B.Box("b_")
    lo, hi = B.widen(F.col("a_min_z"), F.col("a_max_z"), 7.5)
    return M.box_pairs(S.object_boxes(s, d), "obj", {"inside": B.contain_ratio(a, b), "strict": B.overlaps_strictly(a, b), "side": hi - lo}, left=lambda o: o % 4 == 0)


@query("corner_volume", "G8 K1", "obj:i volume:f", f"SELECT obj, {_V3('box')} AS volume FROM box", "box")
def _(s, d):
    x = S.object_boxes(s, d)
    c = [F.array(*(F.col(f"{'max' if k >> i & 1 else 'min'}_{a}") for i, a in enumerate("xyz"))) for k in (0, 1, 2, 4, 3, 5, 6, 7)]
    return x.select("obj", B.corner_volume(F.array(*c)).alias("volume"))


_R2 = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_R2P = f"(SELECT a.frame, a.idx AS a, b.idx AS b, a.class_id AS ca, b.class_id AS cb, {_R2} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS va, (b.x2 - b.x1) * (b.y2 - b.y1) AS vb FROM det a JOIN det b ON a.frame = b.frame AND a.idx < b.idx)"


def rect_pairs(s, d):
    x = S.detections(s, d)
    a = x.select("frame", *(F.col(c).alias("a_" + c) for c in x.columns if c != "frame"))
    b = x.select("frame", *(F.col(c).alias("b_" + c) for c in x.columns if c != "frame"))
    return a.join(b, "frame").filter("a_idx < b_idx")


@query("bbox2d_iou_within_frame", "G13 G14 J19", "frame:i a:i b:i iou:f share:f", f"SELECT frame, a, b, i / (va + vb - i) AS iou, i / va AS share FROM {_R2P}", "det")
def _(s, d):
    return rect_pairs(s, d).select("frame", F.col("a_idx").alias("a"), F.col("b_idx").alias("b"), B.rect_iou(B.Rect("a_"), B.Rect("b_")).alias("iou"), B.rect_share(B.Rect("a_"), B.Rect("b_")).alias("share"))


@query("crop_boxes", "V22 V23", "frame:i idx:i cx1:f cy1:f cx2:f cy2:f", "SELECT frame, idx, greatest(0, x1 - 20) AS cx1, greatest(0, y1 - 20) AS cy1, least(60, x1 + (x2 - x1) + 20) AS cx2, least(30, y1 + (y2 - y1) + 20) AS cy2 FROM det WHERE frame % 7 = 0", "det")
def _(s, d):
    x = S.detections(s, d).filter("frame % 7 = 0")
    c = B.xywh_to_xyxy(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    x = x.select("frame", "idx", *(v.alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"))))
    return x.select("frame", "idx", *(v.alias("c" + n) for n, v in B.crop(B.Rect(), F.lit(20), F.lit(60), F.lit(30)).items()))


@query("unproject_points", "G17 P21 G18", "obj:i pid:i px:f py:f pz:f", "SELECT obj, pid, (x - 25) * z / 500.0 AS px, (y - 5) * z / 480.0 AS py, z AS pz FROM pts WHERE z > 0 AND obj % 5 = 0", "pts")
def _(s, d):
    x = S.points(s, d).filter("z > 0 and obj % 5 = 0")
    p = P.unproject(F.col("x"), F.col("y"), F.col("z"), 500.0, 480.0, 25, 5)
    return x.select("obj", "pid", *(c.alias(n) for c, n in zip(p, ("px", "py", "pz"))))


_POSE = "0.8 * x - 0.6 * y + 1 AS wx, 0.6 * x + 0.8 * y - 2 AS wy, z + 3 AS wz"


def _pose():
    return P.matrix(0.8, -0.6, 0, 1, 0.6, 0.8, 0, -2, 0, 0, 1, 3, 0, 0, 0, 1)


@query("project_points", "G19 G20 G21 G33", "obj:i pid:i u:f v:f bx:f", f"SELECT obj, pid, 500.0 * wx / wz + 320 AS u, 480.0 * wy / wz + 240 AS v, 0.8 * (wx - 1) + 0.6 * (wy + 2) AS bx FROM (SELECT obj, pid, {_POSE} FROM pts WHERE obj % 5 = 1)", "pts")
def _(s, d):
    x = S.points(s, d).filter("obj % 5 = 1").withColumn("p", _pose())
    w = x.withColumns(dict(zip(("wx", "wy", "wz"), P.apply(F.col("p"), F.col("x"), F.col("y"), F.col("z")))))
    back = P.apply(P.rigid_inverse(F.col("p")), F.col("wx"), F.col("wy"), F.col("wz"))
    u, v = P.project(F.col("wx"), F.col("wy"), F.col("wz"), 500.0, 480.0, 320, 240)
    return w.select("obj", "pid", u.alias("u"), v.alias("v"), back[0].alias("bx"))


@query("visibility_class", "G22 G34", "class:s n:i", """SELECT CASE WHEN NOT (u >= 0 AND u < 300 AND v >= 0 AND v < 200 AND z > 0) THEN 'outside' WHEN abs(z - 4) <= 1 THEN 'aligned' WHEN z < 4 THEN 'front' ELSE 'behind' END AS class, count(*) AS n
  FROM (SELECT z, CASE WHEN z <> 0 THEN 50.0 * x / z + 10 ELSE -1 END AS u, CASE WHEN z <> 0 THEN 50.0 * y / z + 5 ELSE -1 END AS v FROM pts) GROUP BY 1""", "pts")
def _(s, d):
    u, v = P.project(F.col("x"), F.col("y"), F.col("z"), 50.0, 50.0, 10, 5)
    return S.points(s, d).groupBy(P.visibility(u, v, F.col("z"), F.lit(4.0), 300, 200, 1.0).alias("class")).agg(F.count("*").alias("n"))


@query("relative_pose", "G24 S3", "obj:i pid:i tx:f ty:f tz:f", """SELECT obj, pid, 0.8 * (x - fx) + 0.6 * (y - fy) AS tx, -0.6 * (x - fx) + 0.8 * (y - fy) AS ty, z - fz AS tz FROM (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, first_value(z) OVER w AS fz FROM pts WHERE obj % 10 = 2 WINDOW w AS (PARTITION BY obj ORDER BY pid))""", "pts")
def _(s, d):
    from pyspark.sql import Window as W

    pose = P.matrix(0.8, -0.6, 0, F.col("x"), 0.6, 0.8, 0, F.col("y"), 0, 0, 1, F.col("z"), 0, 0, 0, 1)
    x = S.points(s, d).filter("obj % 10 = 2").withColumn("p", pose)
    x = x.withColumn("r", P.multiply(P.rigid_inverse(F.first("p").over(W.partitionBy("obj").orderBy("pid"))), F.col("p")))
    return x.select("obj", "pid", F.col("r")[3].alias("tx"), F.col("r")[7].alias("ty"), F.col("r")[11].alias("tz"))


@query("fov_intrinsics", "G25 G23 F25", "k:i fx:f cx:f t0:f t1:f", "SELECT p_partkey AS k, 480 / (2 * tan(radians(30.0 + p_size) / 2)) * 0.5 AS fx, 640 / 2.0 * 0.5 AS cx, (p_size + 0.25) / 60.0 AS t0, (p_size + 10 + 0.75) / 60.0 AS t1 FROM part")
def _(s, d):
    k = P.scale_intrinsics(P.intrinsics(30.0 + F.col("p_size"), 480, 640), 0.5, 0.5)
    t = P.frame_window(F.col("p_size"), F.col("p_size") + 10, 60.0)
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), k["fx"].alias("fx"), k["cx"].alias("cx"), t[0].alias("t0"), t[1].alias("t1"))


@query("circular_distance", "G29 G30", "k:i rot:f l1:f l2:f", """SELECT event_id AS k, least(((value * 3 - 40) % 360 + 360) % 360, 360 - ((value * 3 - 40) % 360 + 360) % 360) AS rot, abs(value - 3) + abs(user_id - 7) AS l1, sqrt((value - 3) * (value - 3) + (user_id - 7) * (user_id - 7)) AS l2 FROM events""")
def _(s, d):
    v, u = F.col("value"), F.col("user_id").cast("double")
    a, b = [v, F.lit(9.0), u], [F.lit(3.0), F.lit(1.0), F.lit(7.0)]
    return table(s, d, "events").select(F.col("event_id").alias("k"), P.rotation_distance([v * 3], [F.lit(40.0)]).alias("rot"), P.position_distance(a, b, 1, True).alias("l1"), P.position_distance(a, b, 2, True).alias("l2"))


@query("euler_poses", "G26 G27 G31 G35 S32", "k:i yaw:f pitch:f angle:f det:f ok:b", "SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS yaw, CAST(p_size AS DOUBLE) / 2 AS pitch, degrees(acos(greatest(-1.0, least(1.0, (cos(radians(p_size)) + cos(radians(p_size / 2.0)) + cos(radians(p_size)) * cos(radians(p_size / 2.0)) - 1) / 2)))) AS angle, 1.0 AS det, true AS ok FROM part WHERE p_size > 0")
def _(s, d):
    a = F.col("p_size").cast("double")
    x = table(s, d, "part").filter("p_size > 0").withColumn("p", P.euler_zxy(a / 2, a, F.lit(0.0), [a, a, a]))
    back = P.euler_zxy_of(F.col("p"))
    return x.select(F.col("p_partkey").alias("k"), back[1].alias("yaw"), back[0].alias("pitch"), P.rotation_angle(F.col("p"), P.matrix(*P.IDENTITY)).alias("angle"), P.determinant3(F.col("p")).alias("det"), P.is_pose(F.col("p")).alias("ok"))


@query("camera_centers", "G32 G28 S28", "k:i cx:f cy:f cz:f fz:f", "SELECT p_partkey AS k, -(0.8 * p_size + 0.6 * 2) AS cx, -(-0.6 * p_size + 0.8 * 2) AS cy, -3.0 AS cz, 1.0 AS fz FROM part")
def _(s, d):
    x = table(s, d, "part").withColumn("p", P.matrix(0.8, -0.6, 0, F.col("p_size").cast("double"), 0.6, 0.8, 0, 2.0, 0, 0, 1, 3.0, 0, 0, 0, 1))
    c, f = P.camera_center(F.col("p"), True), P.camera_forward(F.col("p"), True)
    return x.select(F.col("p_partkey").alias("k"), *(v.alias(n) for v, n in zip(c, ("cx", "cy", "cz"))), f[2].alias("fz"))


@query("pose_conventions", "S8 S9 S10 S11 S12 S13 G27", "k:i a:f b:f c:f m:f", "SELECT p_partkey AS k, -CAST(p_size AS DOUBLE) AS a, -2.0 AS b, 3.0 AS c, -0.6 AS m FROM part")
def _(s, d):
    v = F.col("p_size").cast("double")
    x = table(s, d, "part").withColumn("p", P.conjugate_yz(P.from_column_major(P.from_column_major(P.matrix(0.8, 0.1, 0.6, 3.0, 0.2, 0.9, 0.3, v, 0.6, 0.4, 1, 2.0, 0, 0, 0, 1)))))
    return x.select(F.col("p_partkey").alias("k"), F.col("p")[7].alias("a"), F.col("p")[11].alias("b"), F.col("p")[3].alias("c"), F.col("p")[2].alias("m"))


@query("cosine_pairs", "V4 P2", "a:i b:i cos:f", "SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS cos FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id")
def _(s, d):
    from ..operators import blocks as BL

    return BL.cosine_pairs(table(s, d, "embeddings"), "vec_id", "embedding", ["label"]).select("a", "b", F.col("weight").alias("cos"))


@query("feature_closeness", "A21 F26", "a:i mean_abs:f max_abs:f cosine:f", """SELECT a, avg(abs(p - q)) AS mean_abs, max(abs(p - q)) AS max_abs, sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))) AS cosine FROM (SELECT x.vec_id AS a, unnest(CAST(x.embedding AS DOUBLE[])) AS p, unnest(CAST(y.embedding AS DOUBLE[])) AS q FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1) GROUP BY a""")
def _(s, d):
    e = table(s, d, "embeddings")
    x = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("eb")), "a")
    return x.select("a", *(c.alias(n) for n, c in V.closeness(F.col("ea"), F.col("eb")).items()))
