"""Queries of filters, joins, windows, sets, aggregations, vectors and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DetectionFilter, ObjectFilter, OverlapMerge
from ..functions import boxes as B
from ..functions import vectors as V
from ..operators import constraints as C
from ..operators import evaluate as E
from ..operators import filters as FI
from ..operators import graphs as G
from ..operators import mapping as M
from ..operators import points as PT
from ..operators import views as VW
from ..operators.blocks import cosine_pairs
from ..session import table
from . import standins as S
from .registry import query
from .scalar import _R2P, rect_pairs


@query("detection_filter", "P5 P16", "frame:i idx:i", "SELECT frame, idx FROM det WHERE (x2 - x1) * (y2 - y1) >= 10 AND class_id NOT IN (0, 1) AND (x2 - x1) * (y2 - y1) <= 45 AND conf >= 0.93", "det")
def _(s, d):
    a = B.Rect().area()
    return FI.filter_detections(S.detections(s, d), a, a, F.lit(90.0), F.col("class_id").isin(0, 1), F.col("conf"), DetectionFilter(mask_area=8, max_box_ratio=0.5, confidence=0.93)).select("frame", "idx")


@query("view_validity_ladder", "P12 P23", "reason:s n:i", """SELECT CASE WHEN x1 IS NULL OR area <= 0 THEN 'empty_mask' WHEN bw * bh <= 0 THEN 'invalid_bbox' WHEN area < 100 THEN 'mask_area_below_100' WHEN area / (bw * bh) < 0.1 THEN 'mask_fill_ratio_below_0.1'
  WHEN least(least(640, x2 + pad) - greatest(0, x1 - pad), least(60, y2 + pad) - greatest(0, y1 - pad)) < 48 THEN 'caption_crop_dimension_below_48' WHEN (least(640, x2 + pad) - greatest(0, x1 - pad)) * (least(60, y2 + pad) - greatest(0, y1 - pad)) < 4900 THEN 'caption_crop_area_below_4900' ELSE 'ok' END AS reason, count(*) AS n
  FROM (SELECT *, x2 - x1 AS bw, y2 - y1 AS bh, floor((x2 - x1) * (y2 - y1) * (0.05 + (frame % 10) / 10.0)) AS area, least(50, greatest(20, round_even(0.2 * greatest(x2 - x1, y2 - y1), 0))) AS pad FROM (SELECT frame, x1 * 4 AS x1, y1 * 6 AS y1, (x2 - (frame % 7)) * 8 AS x2, y2 * 6 AS y2 FROM det)) GROUP BY 1""", "det")
def _(s, d):
    x = S.detections(s, d).select("frame", (F.col("x1") * 4).alias("x1"), (F.col("y1") * 6).alias("y1"), ((F.col("x2") - F.col("frame") % 7) * 8).alias("x2"), (F.col("y2") * 6).alias("y2"))
    r = B.Rect()
    reason = B.caption_view_reason(r, F.floor(r.w * r.h * (0.05 + (F.col("frame") % 10) / 10.0)), F.lit(640), F.lit(60))
    return x.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("object_min_support_filter", "P7 P8", "obj:i n:i", "SELECT obj, n FROM box WHERE n >= 400 AND n >= 3 AND n >= 16 AND (max_x - min_x) * (max_y - min_y) * (max_z - min_z) >= 1e-6", "box")
def _(s, d):
    x = FI.filter_objects(S.object_boxes(s, d), F.col("n"), F.col("n"), ObjectFilter(400, 3))
    return x.filter(FI.has_support(F.col("n"), B.Box().volume())).select("obj", "n")


@query("fg_bg_split", "P9 P10 P25 A22", "background:b event_type:s n:i", "SELECT event_type IN ('error', 'view') AS background, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    x = table(s, d, "events").withColumn("background", FI.is_background(F.col("event_type"), F.upper("event_type"), names=("error", "view")))
    return x.groupBy("background", "event_type").agg(F.count("*").alias("n"))


@query("acceptance_reasons", "P11 A22", "reason:s n:i", """SELECT unnest(list_filter([CASE WHEN views <= 0 THEN 'no_nonempty_2d_masks' END, CASE WHEN flat AND views < 3 AND views > 0 THEN 'too_few_views_for_multiview_2d' END, CASE WHEN views > 0 AND cap < CASE WHEN bg THEN 1 ELSE 2 END THEN 'too_few_caption_views' END], lambda x: x IS NOT NULL)) AS reason, 1 AS n
  FROM (SELECT user_id, count(*) - 60 AS views, count_if(value > 120) - 2 AS cap, user_id % 5 = 0 AS bg, user_id % 2 = 0 AS flat FROM events GROUP BY user_id)""".replace("SELECT unnest", "SELECT reason, count(*) AS n FROM (SELECT unnest", 1) + ") GROUP BY reason")
def _(s, d):
    u = F.col("user_id")
    x = table(s, d, "events").groupBy("user_id").agg((F.count("*") - 60).alias("views"), (F.count_if(F.col("value") > 120) - 2).alias("cap"))
    r = FI.acceptance_reasons(F.col("views"), F.col("cap"), u % 5 == 0, u % 2 == 0)
    return x.select(F.explode(r).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("node_pruning", "P13 C6 J13", "doc_id:i", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE lower(trim(source)) NOT IN ('src1', 'src2') AND quality >= 1".replace("('src1', 'src2')", "('fail', 'invalid')"))
def _(s, d):
    return FI.prune_nodes(table(s, d, "documents").select("doc_id", "source"), table(s, d, "labels"), "doc_id", "source", "quality", 1).select("doc_id")


@query("removable_objects", "P17 P19", "level:i n:i", "SELECT 1 AS level, count_if(a) AS n FROM (SELECT o_orderstatus = 'F' AS a FROM orders) UNION ALL SELECT 2, count_if(o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority <> '5-LOW')) FROM orders UNION ALL SELECT 3, count_if(o_orderstatus IN ('F', 'O')) FROM orders")
def _(s, d):
    x = table(s, d, "orders")
    p, m, r = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", F.col("o_orderpriority") == "5-LOW"
    one = x.agg(*(F.count_if(FI.removable(p, m, r, k)).alias(str(k)) for k in (1, 2, 3)))
    return one.select(F.explode(F.create_map(*(v for k in (1, 2, 3) for v in (F.lit(k), F.col(str(k)))))).alias("level", "n"))


@query("gather_rows", "P3 P1 P4 W13", "pos:i c_custkey:i", "SELECT p.pos, c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) c JOIN (VALUES (0, 5), (1, 3), (2, 5), (3, 100)) AS p(pos, r) ON c.r = p.r")
def _(s, d):
    return FI.gather(table(s, d, "customer").select("c_custkey"), F.col("c_custkey"), [5, 3, 5, 100]).select("pos", "c_custkey")


@query("contain_count", "J20 M3", "frame:i idx:i inside:i", "SELECT a.frame, a.idx, count_if(greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) > 0.5 * (b.x2 - b.x1) * (b.y2 - b.y1)) - 1 AS inside FROM det a JOIN det b ON a.frame = b.frame GROUP BY 1, 2", "det")
def _(s, d):
    x = S.detections(s, d)
    a = x.select("frame", *(F.col(c).alias("a_" + c) for c in ("idx", "x1", "y1", "x2", "y2")))
    b = x.select("frame", *(F.col(c).alias("b_" + c) for c in ("idx", "x1", "y1", "x2", "y2")))
    hit = B.rect_intersection(B.Rect("a_"), B.Rect("b_")) > 0.5 * B.Rect("b_").area()
    return a.join(b, "frame").groupBy("frame", F.col("a_idx").alias("idx")).agg((F.count_if(hit) - 1).alias("inside"))


@query("contained_box_pairs", "J21 V17", "frame:i a:i b:i", f"SELECT frame, a, b FROM {_R2P} WHERE i / va < 0.7 AND i / vb > 0.8", "det")
def _(s, d):
    i = B.rect_intersection(B.Rect("a_"), B.Rect("b_"))
    x = rect_pairs(s, d).filter((i / B.Rect("a_").area() < 0.7) & (i / B.Rect("b_").area() > 0.8))
    return x.select("frame", F.col("a_idx").alias("a"), F.col("b_idx").alias("b"))


@query("forbidden_pairs", "J19 J23", "frame:i a:i b:i", f"SELECT frame, a, b FROM {_R2P} WHERE ca = cb AND i / (va + vb - i) < 0.2", "det")
def _(s, d):
    x = rect_pairs(s, d).filter(F.col("a_class_id") == F.col("b_class_id")).filter(B.rect_iou(B.Rect("a_"), B.Rect("b_")) < 0.2)
    return x.select("frame", F.col("a_idx").alias("a"), F.col("b_idx").alias("b"))


@query("receptacle_mapping", "J22", "parent:i children:s n:i", """SELECT parent, string_agg(CAST(child AS VARCHAR), ',' ORDER BY child) AS children, count(*) AS n FROM (SELECT o_custkey AS child, min(p) AS parent FROM (SELECT DISTINCT o_custkey, o_orderkey % 7 AS p FROM orders WHERE o_orderkey < 3000) WHERE p <> 0 GROUP BY o_custkey HAVING count(*) = 1) GROUP BY parent""")
def _(s, d):
    x = table(s, d, "orders").filter("o_orderkey < 3000").groupBy(F.col("o_custkey").alias("child")).agg(F.collect_set(F.col("o_orderkey") % 7).alias("p"))
    one = x.withColumn("p", F.array_remove("p", 0)).filter(F.size("p") == 1).select("child", F.col("p")[0].alias("parent"))
    return one.groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda c: c.cast("string")), ",").alias("children"), F.count("*").alias("n"))


@query("class_remap", "J24 J15 J17", "name:s n:i q:f", "SELECT n_name AS name, count(*) AS n, sum(c_acctbal) AS q FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(s, d):
    x = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("q"))


@query("id_join_coverage", "J13 J14 J16 U8", "doc_id:i side:s", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def _(s, d):
    return C.missing(table(s, d, "documents"), table(s, d, "labels"), "doc_id")


@query("cache_lookup", "C10 C12", "state:s n:i total:f", "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'hit' ELSE 'pending' END AS state, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1")
def _(s, d):
    x = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cache = x.filter("o_custkey % 2 = 0").withColumn("answer", F.lit("yes"))
    hit, miss = C.cache_hits(x, cache, ["o_orderkey", "o_custkey"], ["answer"])
    both = hit.select("o_totalprice", F.lit("hit").alias("state")).unionByName(miss.select("o_totalprice", F.lit("pending").alias("state")))
    return both.groupBy("state").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("stale_stages", "C9", "k:i sha:s", "SELECT n_nationkey AS k, sha256(n_name) AS sha FROM nation WHERE n_regionkey <> 2")
def _(s, d):
    x = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.sha2("n_name", 256).alias("sha"), "n_regionkey")
    marks = x.select("k", "sha", F.when(F.col("n_regionkey") == 2, "complete").otherwise("failed").alias("status"))
    return C.stale_stages(x.select("k", "sha"), marks, "k", "sha")


@query("rule_violations", "F19", "rule:s n:i", "SELECT 'price' AS rule, count_if(NOT (l_extendedprice > 1000)) AS n FROM lineitem UNION ALL SELECT 'discount', count_if(NOT (l_discount BETWEEN 0 AND 0.05)) FROM lineitem UNION ALL SELECT 'flag', count_if(NOT (l_returnflag IN ('A', 'N'))) FROM lineitem")
def _(s, d):
    return C.violations(table(s, d, "lineitem"), {"price": F.col("l_extendedprice") > 1000, "discount": F.col("l_discount").between(0, 0.05), "flag": F.col("l_returnflag").isin("A", "N")})


@query("duplicate_keys", "A24 A25", "k:i line:i n:i", "SELECT l_orderkey AS k, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return G.duplicates(table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line")), "k", "line")


@query("association_argmax", "J1 J2 G15 W1 W2 M2 V4 V5", "vec_id:i label:i similarity:f", """SELECT vec_id, CASE WHEN similarity >= 0.2 THEN label ELSE -1 END AS label, similarity FROM (SELECT vec_id, cen.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) DESC, cen.label) AS r FROM embeddings, cen) WHERE r = 1""", "cen")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    p = M.similarity_pairs(e, S.centroids(s, d), B.similarity(F.lit(0.0), V.cosine(F.col("embedding"), F.col("c"))))
    return M.best_match(p, ["vec_id"], "label", 0.2).na.fill(-1, ["label"])


@query("association_spatial", "J1 M3 J11", "a:i b:i similarity:f", """SELECT a, b, similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS r FROM (SELECT a, b, i / (va + vb - i + 1e-10) - CASE WHEN (a % 2 > 0) <> (b % 3 > 0) THEN 0.5 ELSE 0 END AS similarity FROM
  (SELECT a.obj AS a, b.obj AS b, greatest(0.0, least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) * greatest(0.0, least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y)) * greatest(0.0, least(a.max_z, b.max_z) - greatest(a.min_z, b.min_z)) AS i,
  (a.max_x - a.min_x) * (a.max_y - a.min_y) * (a.max_z - a.min_z) AS va, (b.max_x - b.min_x) * (b.max_y - b.min_y) * (b.max_z - b.min_z) AS vb FROM box a JOIN box b ON a.obj % 2 = 1 AND b.obj % 2 = 0))) WHERE r = 1 AND similarity > 0.3""", "box")
def _(s, d):
    # Boxes that are equal and contained alike score alike: each kind is compared once, for its least object.
    x = S.object_boxes(s, d)
    a = M.kinds(x.filter("obj % 2 = 1"), "obj", M.BOX)
    b = M.kinds(x.filter("obj % 2 = 0"), "obj", [*M.BOX, (F.col("obj") % 3 > 0).alias("contains")])
    left = a.select(*(F.col(c).alias("a_" + c) for c in a.columns if c != "members")).repartition(8 * s.sparkContext.defaultParallelism, "a_obj")
    right = b.select(*(F.col(c).alias("b_" + c) for c in b.columns if c not in ("members", "contains"))).groupBy(*("b_" + c for c in M.BOX), (F.col("b_obj") % 3 > 0).alias("_c")).agg(F.min("b_obj").alias("b_obj"))
    score = M.containment_penalty(B.spatial("iou", B.Box("a_"), B.Box("b_")), F.col("a_obj") % 2, F.col("b_obj") % 3)
    best = M.greedy_matches(M.similarity_pairs(left, right, score), ["a_obj"], "b_obj", 0.3)
    out = best.join(a.select(F.col("obj").alias("a_obj"), F.explode("members").alias("a")), "a_obj")
    return out.select("a", F.col("b_obj").alias("b"), "similarity").orderBy(F.desc("similarity"))


@query("text_query_topk", "V6 W19 X1 X3", "q:i vec_id:i scaled:f probability:f", """SELECT q, vec_id, scaled, probability FROM (SELECT q, vec_id, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS scaled, exp(v - max(v) OVER w) / sum(exp(v)) OVER w * exp(max(v) OVER w) AS probability, row_number() OVER (PARTITION BY q ORDER BY v DESC, vec_id) AS r
  FROM (SELECT a.vec_id AS q, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS v FROM embeddings a, embeddings b WHERE a.vec_id < 10) WINDOW w AS (PARTITION BY q)) WHERE r <= 5""")
def _(s, d):
    e = table(s, d, "embeddings")
    q = e.filter("vec_id < 10").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))
    x = M.similarity_pairs(e.select("vec_id", "embedding"), q, V.cosine(F.col("qe"), F.col("embedding")))
    top = VW.minmax_softmax(x.select("q", "vec_id", "similarity"), ["q"], "similarity")
    return VW.best_per(top, ["q"], F.desc("similarity"), F.asc("vec_id"), n=5)


@query("zero_shot_class", "V5 W1", "vec_id:i label:i similarity:f", "SELECT vec_id, label, similarity FROM (SELECT vec_id, cen.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) DESC, cen.label) AS r FROM embeddings, cen WHERE cen.label <> 3) WHERE r = 1", "cen")
def _(s, d):
    return E.zero_shot(table(s, d, "embeddings").select("vec_id", "embedding"), S.centroids(s, d), "vec_id", "label", "embedding", "c", [3])


@query("feature_fuse_weighted", "A2 A3", "label:i w:i f0:f f63:f", """SELECT label, max(w) AS w, max(CASE WHEN i = 1 THEN v END) / sqrt(sum(v * v)) AS f0, max(CASE WHEN i = 64 THEN v END) / sqrt(sum(v * v)) AS f63 FROM (SELECT label, i, sum(v * w) AS v, sum(w) AS w FROM (SELECT label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v, vec_id % 4 + 1 AS w FROM embeddings) GROUP BY label, i) GROUP BY label""")
def _(s, d):
    x = table(s, d, "embeddings").withColumn("w", F.col("vec_id") % 4 + 1)
    m = M.merge_objects_by_key(x.select("label", "w", "embedding"), ["label"], "embedding", "w")
    return m.select("label", "w", F.col("embedding")[0].alias("f0"), F.col("embedding")[63].alias("f63"))


@query("object_merge_agg", "A1 A20 U1", "k:i n:i qty:f lines:s flags:s", "SELECT l_suppkey AS k, count(*) AS n, sum(l_quantity) AS qty, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_orderkey, l_linenumber, l_partkey) AS lines, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem WHERE l_suppkey % 10 = 0 GROUP BY 1")
def _(s, d):
    x = table(s, d, "lineitem").filter("l_suppkey % 10 = 0")
    return x.groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey"))).alias("x"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags")).select(
        "k", "n", "qty", F.array_join(F.transform("x.l_partkey", lambda v: v.cast("string")), ",").alias("lines"), "flags")


@query("most_common_class", "A4 P25", "user_id:i event_type:s", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def _(s, d):
    n = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return VW.best_per(n, ["user_id"], F.desc("n"), F.asc("event_type")).select("user_id", "event_type")


@query("class_histogram", "A5 A23", "event_type:s n:i users:i", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).orderBy(F.desc("n"))


@query("running_class_set", "A26", "event_id:i classes:s", "SELECT event_id, array_to_string(list_sort(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))), ',') AS classes FROM events WHERE user_id < 20")
def _(s, d):
    x = M.running_classes(table(s, d, "events").filter("user_id < 20").withColumn("o", F.struct("ts", "event_id")), ["user_id"], "o", "event_type")
    return x.select("event_id", F.array_join("classes", ",").alias("classes"))


@query("set_intersect", "U2 J12", "k:i", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def _(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(s, d, "orders").select("o_custkey"))


@query("set_except", "U3 U4", "k:i", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(s, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey"))


@query("ordered_distinct", "U5 F15", "k:i prios:s", "SELECT o_custkey AS k, string_agg(o_orderpriority, ',' ORDER BY m) AS prios FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS m FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    g = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    return g.select("k", F.array_join(F.array_distinct("x.o_orderpriority"), ",").alias("prios"))


@query("union_and_xor", "U1 U6 U7", "k:i", "SELECT k FROM (SELECT c_custkey AS k, 1 AS w FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_mktsegment = 'HOUSEHOLD') GROUP BY k HAVING count(*) = 1")
def _(s, d):
    c = table(s, d, "customer")
    both = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")).unionByName(c.filter("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("k")))
    return both.groupBy("k").count().filter("count = 1").select("k")


@query("best_view_per_image", "W3 V21", "user_id:i frame:i event_id:i", "SELECT user_id, frame, event_id FROM (SELECT user_id, CAST(date_part('day', ts) AS BIGINT) AS frame, event_id, row_number() OVER (PARTITION BY user_id, date_part('day', ts) ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def _(s, d):
    x = table(s, d, "events").withColumn("frame", F.day("ts"))
    return VW.best_per(x, ["user_id", "frame"], F.desc("value"), F.asc("event_id")).select("user_id", "frame", "event_id")


@query("temporal_view_bins", "W4", "user_id:i bin:i event_id:i", """SELECT user_id, bin, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, bin ORDER BY value DESC, frame, event_id) AS q FROM (SELECT *, ntile(4) OVER (PARTITION BY user_id ORDER BY frame, event_id) AS bin FROM (SELECT user_id, date_part('day', ts) AS frame, event_id, value, row_number() OVER (PARTITION BY user_id, date_part('day', ts) ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1)) WHERE q = 1""")
def _(s, d):
    x = table(s, d, "events").withColumn("frame", F.day("ts"))
    return VW.caption_views(x, ["user_id"], "frame", "frame", "event_id", "value", 4)


@query("seed_selection", "W5 W6 M9", "user_id:i event_id:i", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, frame, event_id) AS r FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY top DESC, frame) AS f FROM (SELECT user_id, event_id, value, date_part('day', ts) AS frame, max(value) OVER (PARTITION BY user_id, date_part('day', ts)) AS top FROM events)) WHERE f <= 2) WHERE r <= 8""")
def _(s, d):
    from ..operators.tracks import seeds

    return seeds(table(s, d, "events").withColumn("frame", F.day("ts")), ["user_id"], "frame", "value", "event_id").select("user_id", "event_id")


@query("uniform_subsample", "W13 W14 S2", "user_id:i event_id:i", """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n <= 7 OR list_contains(list_transform(range(0, 7), lambda k: CAST(round_even(k * (n - 1) / 6.0, 0) AS BIGINT)), i)""")
def _(s, d):
    return VW.uniform_positions(table(s, d, "events"), ["user_id"], ["ts", "event_id"], 7).select("user_id", "event_id")


@query("even_point_sample", "W14", "obj:i pid:i", """SELECT obj, pid FROM (SELECT obj, pid, row_number() OVER (PARTITION BY obj ORDER BY pid) - 1 AS i, count(*) OVER (PARTITION BY obj) AS n FROM pts) WHERE list_contains(list_transform(range(0, 50), lambda k: CAST(floor(k * ((n - 1) / 49.0)) AS BIGINT)), i)""", "pts")
def _(s, d):
    return PT.even_sample(S.points(s, d), ["obj"], ["pid"], 50).select("obj", "pid")


@query("frame_slice", "S2 W10", "user_id:i event_id:i frame_idx:i", "SELECT user_id, event_id, i AS frame_idx FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) WHERE i >= 3 AND i < 40 AND (i - 3) % 4 = 0")
def _(s, d):
    return VW.frame_slice(table(s, d, "events"), ["user_id"], "event_id", 3, 40, 4)


@query("mask_index", "W11", "frame:i idx:i mask_index:i", "SELECT frame, idx, dense_rank() OVER (PARTITION BY frame ORDER BY idx) - 1 AS mask_index FROM det", "det")
def _(s, d):
    return VW.mask_index(S.detections(s, d), ["frame"], "idx")


@query("class_index", "W17", "p_name:s class_id:i", "SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS class_id FROM (SELECT DISTINCT p_name FROM part)")
def _(s, d):
    return VW.class_index(table(s, d, "part"), "p_name")


@query("newest_result", "W15", "user_id:i event_type:s", "SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY 1")
def _(s, d):
    return VW.newest(table(s, d, "events"), ["user_id"], "event_type", "ts")


@query("top_by_confidence", "W16 W12", "frame:i idx:i", "SELECT frame, idx FROM (SELECT frame, idx, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, idx) AS r FROM det) WHERE r <= 5", "det")
def _(s, d):
    return VW.best_per(S.detections(s, d), ["frame"], F.desc("conf"), F.asc("idx"), n=5)


@query("trajectory_length", "W18", "obj:i length:f", "SELECT obj, coalesce(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z))), 0) AS length FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM pts WINDOW w AS (PARTITION BY obj ORDER BY pid)) GROUP BY obj", "pts")
def _(s, d):
    return VW.path_length(S.points(s, d), ["obj"], "pid")


@query("monotonic_check", "W10", "n:i", "SELECT count(*) AS n FROM (SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b >= value")
def _(s, d):
    x = table(s, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return G.monotonic_violations(x, ["user_id"], "o", "value").agg(F.count("*").alias("n"))


_PRED = "pred AS (SELECT vec_id, label AS gt, p FROM (SELECT vec_id, embeddings.label, cen.label AS p, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) DESC, cen.label) AS r FROM embeddings, cen WHERE cen.label <> 3) WHERE r = 1)"


def _pred(s, d):
    e = table(s, d, "embeddings")
    p = E.zero_shot(e.select("vec_id", "embedding"), S.centroids(s, d), "vec_id", "label", "embedding", "c", [3]).select("vec_id", F.col("label").alias("p"))
    return e.select("vec_id", F.col("label").alias("gt")).join(p, "vec_id")


@query("confusion_matrix", "A14", "gt:i pred:i n:i", f"WITH {_PRED} SELECT gt, p AS pred, count(*) AS n FROM pred GROUP BY 1, 2", "cen")
def _(s, d):
    return E.confusion(_pred(s, d), "gt", "p")


_METRIC = f"""WITH {_PRED}, g AS (SELECT gt AS c, count(*) AS g, count_if(gt = p) AS tp FROM pred GROUP BY 1), q AS (SELECT p AS c, count(*) AS q FROM pred GROUP BY 1),
  m AS (SELECT g.c, tp, g, tp / greatest(1, g + coalesce(q, 0) - tp) AS iou, tp / greatest(1, coalesce(q, 0)) AS precision, tp / greatest(1, g) AS recall FROM g LEFT JOIN q ON g.c = q.c)"""


@query("semseg_metrics", "A15", "class:i iou:f precision:f recall:f f1:f", f"{_METRIC} SELECT c AS class, iou, precision, recall, 2 * precision * recall / greatest(1, precision + recall) AS f1 FROM m", "cen")
def _(s, d):
    return E.class_metrics(E.confusion(_pred(s, d), "gt", "p"))


@query("semseg_summary", "A15", "miou:f fmiou:f classes:i acc_15:i acc_50:i macc:f", f"{_METRIC} SELECT avg(iou) AS miou, sum(iou * g) / sum(g) AS fmiou, count(*) AS classes, count_if(iou > 0.15) AS acc_15, count_if(iou > 0.5) AS acc_50, avg(recall) AS macc FROM m", "cen")
def _(s, d):
    return E.summary(E.class_metrics(E.confusion(_pred(s, d), "gt", "p")))


@query("metrics_with_all_row", "A16", "scene:s gt:i pred:i n:i", "SELECT coalesce(lang, 'all') AS scene, quality AS gt, toxic AS pred, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, quality, toxic), (quality, toxic))")
def _(s, d):
    x = table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id")
    return E.confusion(x, "quality", "toxic", "lang")


@query("conversion_counts", "A22 A23", "total:i accepted:i masks:i views:i", "SELECT count(*) AS total, count_if(n >= 60) AS accepted, sum(n) AS masks, sum(big) AS views FROM (SELECT user_id, count(*) AS n, count_if(value > 50) AS big FROM events GROUP BY 1)")
def _(s, d):
    x = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("big"))
    return x.agg(F.count("*").alias("total"), F.count_if(F.col("n") >= 60).alias("accepted"), F.sum("n").alias("masks"), F.sum("big").alias("views"))


@query("overlap_merge_order", "M5 M6 M7 W12", "source:i target:i", """WITH RECURSIVE pr AS (SELECT a, b, row_number() OVER (ORDER BY ratio DESC, a, b) AS k FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) AS ratio FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id) WHERE ratio > 0.25),
  fo(k, gone, source, target) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) UNION ALL
    SELECT pr.k, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, a) END, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN NULL ELSE a END, b FROM fo JOIN pr ON pr.k = fo.k + 1)
  SELECT source, target FROM fo WHERE source IS NOT NULL""")
def _(s, d):
    # Vectors meet in blocks; both directions of a pair have one ratio, which is rounded, so pairs a little below the bound are asked for.
    p = cosine_pairs(table(s, d, "embeddings"), "vec_id", "embedding", ["label"], above=0.2499).select(F.lit(0).alias("scene"), "a", "b", F.round("weight", 9).alias("ratio"))
    # Of one ratio (a, b) with a < b comes before (b, a) and leaves at most one of the two, so (b, a) never merges.
    return M.overlap_merge(p.withColumns({"visual": F.col("ratio"), "text": F.lit(1.0)}), "scene", OverlapMerge(0.25, 0.25, 0.5))


def _frames(s, d):
    """Detections of two scenes of 25 frames: whole-number features of eight axes, boxes of the objects."""
    f = F.transform(F.slice("embedding", 1, 8), lambda v: F.round(v * 40))
    e = table(s, d, "embeddings").withColumn("o", F.col("vec_id") % 10 + 1).join(S.object_boxes(s, d).withColumnRenamed("obj", "o"), "o")
    return e.select((F.col("label") % 2).alias("scene"), (F.col("vec_id") % 25).alias("frame"), F.col("vec_id").alias("det"), f.alias("f"), *M.BOX)


#: The mapping fold. State: a list of objects (sum of features, weight, box, id); a frame's detections are compared with the map before the frame.
_FOLD = """de AS (SELECT label % 2 AS scene, vec_id % 25 AS frame, vec_id AS det, list_transform(embedding[1:8], lambda v: round(CAST(v AS DOUBLE) * 40)) AS f, [min_x, min_y, min_z] AS lo, [max_x, max_y, max_z] AS hi FROM embeddings JOIN box ON box.obj = vec_id % 10 + 1),
  fr AS (SELECT scene, frame, list(struct_pack(det := det, f := f, lo := lo, hi := hi) ORDER BY det) AS ds, row_number() OVER (PARTITION BY scene ORDER BY frame) AS k FROM de GROUP BY scene, frame),
  st(scene, k, n, objs, got) AS (SELECT DISTINCT scene, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, f DOUBLE[], w DOUBLE, lo DOUBLE[], hi DOUBLE[])[]), CAST([] AS STRUCT(det BIGINT, id BIGINT)[]) FROM fr UNION ALL
    SELECT scene, k, n + len(fresh), list_concat(
        list_transform(objs, lambda o: list_reduce(list_prepend(o, list_transform(list_filter(picked, lambda p: p.at IS NOT NULL AND p.id = o.id), lambda p: struct_pack(id := p.id, f := p.d.f, w := 1.0, lo := p.d.lo, hi := p.d.hi))),
          lambda x, y: struct_pack(id := x.id, f := list_transform(list_zip(x.f, y.f), lambda v: (v[1] * x.w + v[2]) / (x.w + 1) / greatest(sqrt(list_sum(list_transform(list_zip(x.f, y.f), lambda u: ((u[1] * x.w + u[2]) / (x.w + 1)) ** 2))), 1e-12)), w := x.w + 1,
            lo := [least(x.lo[1], y.lo[1]), least(x.lo[2], y.lo[2]), least(x.lo[3], y.lo[3])], hi := [greatest(x.hi[1], y.hi[1]), greatest(x.hi[2], y.hi[2]), greatest(x.hi[3], y.hi[3])]))),
        list_transform(fresh, lambda p, i: struct_pack(id := n + i - 1, f := p.d.f, w := 1.0, lo := p.d.lo, hi := p.d.hi))),
      list_concat(list_transform(list_filter(picked, lambda p: p.at IS NOT NULL), lambda p: struct_pack(det := p.d.det, id := p.id)), list_transform(fresh, lambda p, i: struct_pack(det := p.d.det, id := n + i - 1)))
    FROM (SELECT *, list_filter(picked, lambda p: p.at IS NULL) AS fresh FROM
      (SELECT scene, k, n, objs, list_transform(scored, lambda s: CASE WHEN len(s.v) > 0 AND list_max(s.v) >= 1.0 THEN struct_pack(d := s.d, at := list_position(s.v, list_max(s.v)), id := objs[list_position(s.v, list_max(s.v))].id) ELSE struct_pack(d := s.d, at := NULL, id := CAST(-1 AS BIGINT)) END) AS picked FROM
        (SELECT st.scene, fr.k, st.n, st.objs, list_transform(fr.ds, lambda d: struct_pack(d := d, v := list_transform(st.objs, lambda o: round(
            greatest(0.0, least(d.hi[1], o.hi[1]) - greatest(d.lo[1], o.lo[1])) * greatest(0.0, least(d.hi[2], o.hi[2]) - greatest(d.lo[2], o.lo[2])) * greatest(0.0, least(d.hi[3], o.hi[3]) - greatest(d.lo[3], o.lo[3]))
            / ((d.hi[1] - d.lo[1]) * (d.hi[2] - d.lo[2]) * (d.hi[3] - d.lo[3]) + (o.hi[1] - o.lo[1]) * (o.hi[2] - o.lo[2]) * (o.hi[3] - o.lo[3]) - greatest(0.0, least(d.hi[1], o.hi[1]) - greatest(d.lo[1], o.lo[1])) * greatest(0.0, least(d.hi[2], o.hi[2]) - greatest(d.lo[2], o.lo[2])) * greatest(0.0, least(d.hi[3], o.hi[3]) - greatest(d.lo[3], o.lo[3])) + 1e-10)
            + list_dot_product(d.f, o.f) / greatest(sqrt(list_dot_product(d.f, d.f)) * sqrt(list_dot_product(o.f, o.f)), 1e-12), 9))) ) AS scored FROM st JOIN fr ON fr.scene = st.scene AND fr.k = st.k + 1))))"""


@query("mapping_loop", "M8 M2", "scene:i det:i object:i", f"WITH RECURSIVE {_FOLD} SELECT scene, g.det AS det, g.id AS object FROM (SELECT scene, unnest(got) AS g FROM st)", "box")
def _(s, d):
    return M.map_scenes(_frames(s, d), "scene", "frame", "det", "f", 1.0)


@query("mapping_maintenance", "M4", "scene:i objects:i detections:i", None)
def _(s, d):
    m = M.map_scenes(_frames(s, d), "scene", "frame", "det", "f", 1.0, maintain=10, min_detections=2)
    return m.groupBy("scene").agg(F.count_distinct("object").alias("objects"), F.count("*").alias("detections"))


@query("exact_fusion", "A1 A2", "label:i w:f f0:f f63:f", """WITH RECURSIVE ve AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
  fo(label, k, f) AS (SELECT label, k, v FROM ve WHERE k = 1 UNION ALL SELECT label, k, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) FROM (SELECT ve.label, ve.k, list_transform(list_zip(fo.f, ve.v), lambda p: (p[1] * fo.k + p[2]) / (fo.k + 1)) AS m FROM fo JOIN ve ON ve.label = fo.label AND ve.k = fo.k + 1))
  SELECT label, max(k) AS w, arg_max(f, k)[1] AS f0, arg_max(f, k)[64] AS f63 FROM fo GROUP BY label""")
def _(s, d):
    x = table(s, d, "embeddings").withColumn("w", F.lit(1.0))
    return M.fold_feature(x, ["label"], "vec_id", "embedding", "w").select("label", "w", F.col("embedding")[0].alias("f0"), F.col("embedding")[63].alias("f63"))


@query("stack_batch", "S18", "scene:i n:i first:i last:i", "SELECT user_id AS scene, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def _(s, d):
    g = table(s, d, "events").groupBy(F.col("user_id").alias("scene")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    return g.select("scene", F.size("x").alias("n"), F.col("x.event_id")[0].alias("first"), F.element_at("x.event_id", -1).alias("last"))


@query("one_hot_planes", "S7", "plane:i n:i", "SELECT plane, count_if(p_size = plane) AS n FROM part, (SELECT unnest(range(0, 61)) AS plane) GROUP BY 1")
def _(s, d):
    x = table(s, d, "part").select(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: (i == F.col("p_size")).cast("int")).alias("h"))
    return x.select(F.posexplode("h").alias("plane", "v")).groupBy("plane").agg(F.sum("v").alias("n"))


@query("tumbling_counts", "2.12", "start:s event_type:s n:i v:f", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2")
def _(s, d):
    from ..streaming.windows import tumbling

    x = tumbling(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["event_type"], "value")
    return x.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "v")


@query("sessions", "2.12", "user_id:i start:s n:i", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, g""")
def _(s, d):
    from ..streaming.windows import sessions

    x = sessions(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", ["user_id"])
    return x.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("as_of_pose", "2.12", "event_id:i order_id:i", """SELECT event_id, (SELECT coalesce(max(p.event_id), -1) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND p.event_id <= e.event_id) AS order_id FROM events e WHERE event_type = 'click'""")
def _(s, d):
    from ..streaming.windows import as_of

    e = table(s, d, "events")
    return as_of(e.filter("event_type = 'click'").select("user_id", "event_id"), e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("t"), F.col("event_id").alias("order_id")), ["user_id"], "event_id", "t", ["order_id"]).select("event_id", F.coalesce("order_id", F.lit(-1)).alias("order_id"))


