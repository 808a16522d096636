"""Geometry queries (G1-G10): orders are frames, line items are detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import geometry as G
from framewright.plans.adapters import div, r, rnd, spread, table
from framewright.plans.registry import query

LMS_SQL = """lms AS (SELECT 'm' || (o_custkey % 8) AS model_id, o_orderkey AS frame_idx, p::INT AS point_idx,
  ((o_orderkey * 31 + p * p * 17) % 640)::INT AS x, ((o_custkey * 7 + p * 29) % 480)::INT AS y FROM orders, range(110) t(p))"""


def landmarks(spark, sf):
    """Dealt by frame before the points are made, so that what goes by frame moves no points."""
    model = F.concat(F.lit("m"), (F.col("o_custkey") % 8).cast("string"))
    o = spread(table(spark, sf, "orders").select(model.alias("model_id"), F.col("o_orderkey").alias("frame_idx"), "o_orderkey", "o_custkey"), "model_id", "frame_idx")
    return o.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(109)))).select(
        "model_id", "frame_idx", F.col("p").alias("point_idx"),
        ((F.col("o_orderkey") * 31 + F.col("p") * F.col("p") * 17) % 640).cast("int").alias("x"),
        ((F.col("o_custkey") * 7 + F.col("p") * 29) % 480).cast("int").alias("y"))


@query("g01_landmarks_to_rect", f"""WITH {LMS_SQL}, c AS (SELECT model_id, frame_idx, max(x) FILTER (point_idx = 1) AS x1,
  max(y) FILTER (point_idx = 52) AS y1, max(x) FILTER (point_idx = 31) AS x2 FROM lms GROUP BY 1, 2)
SELECT *, y1 + x2 - x1 AS y2 FROM c""")
def g01(spark, sf):
    return G.landmarks_to_rect(landmarks(spark, sf))


_BBOX = """bb AS (SELECT model_id, frame_idx, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2,
  max(x) - min(x) AS w, max(y) - min(y) AS h FROM lms GROUP BY 1, 2)"""


@query("g02_landmark_bbox", f"WITH {LMS_SQL}, {_BBOX} SELECT *, {r('320.0::DOUBLE / w', 9)} AS ratio FROM bb")
def g02(spark, sf):
    return G.landmark_bbox(landmarks(spark, sf)).withColumn("ratio", rnd(F.col("ratio"), 9))


@query("g03_centered_box", f"""WITH {LMS_SQL}, {_BBOX}, c AS (SELECT model_id, frame_idx,
  trunc((x1 + x2) / 2.0::DOUBLE - 164)::INT AS bx1, trunc((y1 + y2) / 2.0::DOUBLE - 164)::INT AS by1 FROM bb)
SELECT *, bx1 + 328 AS bx2, by1 + 328 AS by2, bx1 >= 0 AND by1 >= 0 AND bx1 + 328 <= 640 AND by1 + 328 <= 480 AS in_frame FROM c""")
def g03(spark, sf):
    return G.centered_box(G.landmark_bbox(landmarks(spark, sf)), F.lit(640), F.lit(480)).select(
        "model_id", "frame_idx", "bx1", "by1", "bx2", "by2", "in_frame")


BOX_SQL = """bx AS (SELECT o_orderkey AS image_id, (o_custkey % 600)::INT AS x1, (o_orderkey % 440)::INT AS y1,
  (o_custkey % 600 + 20 + o_orderkey % 97)::INT AS x2, (o_orderkey % 440 + 20 + o_custkey % 89)::INT AS y2, 640 AS width, 480 AS height FROM orders)"""


def _boxes(spark, sf):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        o.alias("image_id"), (c % 600).cast("int").alias("x1"), (o % 440).cast("int").alias("y1"),
        (c % 600 + 20 + o % 97).cast("int").alias("x2"), (o % 440 + 20 + c % 89).cast("int").alias("y2"),
        F.lit(640).alias("width"), F.lit(480).alias("height"))


@query("g04_square_face_box", f"""WITH {BOX_SQL}, s AS (SELECT *, trunc(greatest(x2 - x1, y2 - y1) * 1.05::DOUBLE)::INT AS size,
  ((x1 + x2) // 2)::INT AS cx, ((y1 + y2) // 2)::INT AS cy FROM bx),
o AS (SELECT *, (cx - size // 2)::INT AS ox, (cy - size // 2)::INT AS oy FROM s)
SELECT *, greatest(0, -ox) AS dx, greatest(0, -oy) AS dy, greatest(0, ox + size - width) AS edx, greatest(0, oy + size - height) AS edy,
  least(width, ox + size) AS ex, least(height, oy + size) AS ey FROM o""")
def g04(spark, sf):
    return G.square_face_box(_boxes(spark, sf))


@query("g05_eye_angle", f"""WITH {BOX_SQL} SELECT image_id, {r('degrees(atan2(y2 - y1 - 60, x2 - x1 - 50))', 8)} AS angle FROM bx""")
def g05(spark, sf):
    b = _boxes(spark, sf)
    return b.select("image_id", rnd(G.eye_angle(F.col("x1") + 50, F.col("y1") + 60, F.col("x2"), F.col("y2")), 8).alias("angle"))


@query("g06_denormalize_landmarks", f"""WITH {LMS_SQL}, {BOX_SQL},
mean AS (SELECT p::INT AS point_idx, p / 128.0::DOUBLE AS mx, (127 - p) / 128.0::DOUBLE AS my FROM range(110) t(p))
SELECT model_id, frame_idx, point_idx, trunc((x / 1024.0::DOUBLE - 0.25::DOUBLE + mx) * (x2 - x1))::INT + x1 AS x,
  trunc((y / 1024.0::DOUBLE - 0.25::DOUBLE + my) * (y2 - y1))::INT + y1 AS y
FROM (SELECT model_id, frame_idx, point_idx, x, y FROM lms) JOIN mean USING (point_idx)
JOIN (SELECT image_id AS frame_idx, x1, y1, x2, y2 FROM bx) USING (frame_idx)""")
def g06(spark, sf):
    points = landmarks(spark, sf).select(
        "model_id", "frame_idx", "point_idx", (F.col("x") / 1024.0 - 0.25).alias("dx"), (F.col("y") / 1024.0 - 0.25).alias("dy"))
    mean = spark.range(110).select(F.col("id").cast("int").alias("point_idx"), (F.col("id") / 128.0).alias("mx"),
                                   ((127 - F.col("id")) / 128.0).alias("my"))
    model = F.concat(F.lit("m"), (F.col("o_custkey") % 8).cast("string"))
    keys = table(spark, sf, "orders").select(model.alias("model_id"), F.col("o_orderkey").alias("frame_idx"))
    boxes = _boxes(spark, sf).select(
        F.col("image_id").alias("frame_idx"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"),
        F.col("x1").alias("ox"), F.col("y1").alias("oy")).join(keys, "frame_idx")
    return G.denormalize_landmarks(points, mean, boxes)


# Detections: stride 8/16/32 by line number, a grid cell by part key, distances in 1/16 strides.
PRED_SQL = """pr AS (SELECT l_orderkey // 20 AS image_id,
  ((l_partkey * 100000 + l_suppkey) * 64 + l_quantity::INT) * 8 + l_linenumber AS box_id, l_partkey, l_suppkey, l_quantity, l_linenumber,
  8 << (l_linenumber % 3) AS stride, l_discount * 10 AS score FROM lineitem),
pa AS (SELECT *, (l_partkey * 7 + l_suppkey) % (2 * (640 // stride) * (640 // stride)) AS anchor_idx,
  [(l_quantity::INT % 8 + 8) / 16.0::DOUBLE, (l_suppkey % 16 + 8) / 16.0::DOUBLE, (l_partkey % 16 + 8) / 16.0::DOUBLE, (l_quantity::INT % 16 + 8) / 16.0::DOUBLE] AS dist FROM pr),
dec AS (SELECT image_id, box_id, anchor_idx, stride, score, (anchor_idx // 2) % (640 // stride) * stride AS ax, (anchor_idx // 2) // (640 // stride) * stride AS ay, dist FROM pa WHERE score >= 0.5::DOUBLE),
det AS (SELECT image_id, box_id, anchor_idx, stride, score, ax - dist[1]*stride AS x, ay - dist[2]*stride AS y, (dist[1] + dist[3])*stride AS w,
  (dist[2] + dist[4])*stride AS h, dist[1]*stride + ax AS kx, dist[2]*stride + ay AS ky FROM dec)"""


def _preds(spark, sf):
    li = table(spark, sf, "lineitem")
    stride = F.element_at(F.array(F.lit(8), F.lit(16), F.lit(32)), F.col("l_linenumber") % 3 + 1)
    per_row = F.floor(F.lit(640) / stride)
    q = F.col("l_quantity").cast("int")
    dist = F.array(*[(v + 8) / F.lit(16.0) for v in (q % 8, F.col("l_suppkey") % 16, F.col("l_partkey") % 16, q % 16)])
    return li.select(
        div(F.col("l_orderkey"), 20).alias("image_id"), stride.alias("stride"),
        (((F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 64 + q) * 8 + F.col("l_linenumber")).alias("box_id"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % (per_row * per_row * 2)).alias("anchor_idx"),
        (F.col("l_discount") * 10).alias("score"), dist.alias("dist"), F.slice(dist, 1, 2).alias("kps"))


@query("g07_decode_anchors", f"""WITH {PRED_SQL} SELECT image_id, count(*) AS n, {r('sum(x)')} AS x, {r('sum(y)')} AS y, {r('sum(w)')} AS w,
  {r('sum(h)')} AS h, {r('sum(kx)')} AS kx, {r('sum(ky)')} AS ky FROM det GROUP BY 1""")
def g07(spark, sf):
    det = G.decode_anchors(_preds(spark, sf))
    return det.groupBy("image_id").agg(
        F.count("*").alias("n"), *[rnd(F.sum(c)).alias(c) for c in "xywh"],
        rnd(F.sum(F.col("points")[0])).alias("kx"), rnd(F.sum(F.col("points")[1])).alias("ky"))


@query("g08_letterbox", f"""WITH im AS (SELECT o_orderkey AS image_id, (200 + o_custkey % 500)::INT AS width, (200 + o_orderkey % 500)::INT AS height FROM orders),
p AS (SELECT *, CASE WHEN height > width THEN trunc(640 / (height / width::DOUBLE))::INT ELSE 640 END AS new_w,
  CASE WHEN height >= width THEN 640 ELSE trunc(640 * (height / width::DOUBLE))::INT + 1 END AS new_h FROM im),
q AS (SELECT *, CASE WHEN height > width THEN trunc((640 - new_w) * 0.5)::INT ELSE 0 END AS pad_w,
  CASE WHEN width > height THEN trunc((640 - new_h) * 0.5)::INT ELSE 0 END AS pad_h FROM p)
SELECT image_id, new_w, new_h, pad_w, pad_h, {r('(320 - pad_w) * (width / new_w::DOUBLE)', 7)} AS x, {r('(200 - pad_h) * (height / new_h::DOUBLE)', 7)} AS y,
  {r('64 * (width / new_w::DOUBLE)', 7)} AS w, {r('48 * (height / new_h::DOUBLE)', 7)} AS h FROM q""")
def g08(spark, sf):
    im = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"), (200 + F.col("o_custkey") % 500).cast("int").alias("width"),
        (200 + F.col("o_orderkey") % 500).cast("int").alias("height"))
    boxes = G.letterbox_params(im).withColumns({"x": F.lit(320.0), "y": F.lit(200.0), "w": F.lit(64.0), "h": F.lit(48.0)})
    out = G.unletterbox(boxes)
    return out.select("image_id", "new_w", "new_h", "pad_w", "pad_h", *[rnd(F.col(c), 7).alias(c) for c in "xywh"])


def _detections(spark, sf):
    return G.decode_anchors(_preds(spark, sf)).select("image_id", "box_id", "x", "y", "w", "h", "score")


_NMS_SQL = f"""WITH {PRED_SQL},
u AS (SELECT image_id, x, y, w, h, max(score) AS score, arg_max(box_id, (score, -box_id)) AS box_id FROM det GROUP BY ALL),
l AS (SELECT image_id, list([{{'id': box_id::BIGINT, 'x': x, 'y': y, 'w': w, 'h': h, 's': score}}] ORDER BY score DESC, box_id) AS b FROM u GROUP BY 1),
k AS (SELECT image_id, unnest(list_reduce(b, lambda acc, e: CASE WHEN len(list_filter(acc, lambda q:
  greatest(least(q.x + q.w, e[1].x + e[1].w) - greatest(q.x, e[1].x), 0) * greatest(least(q.y + q.h, e[1].y + e[1].h) - greatest(q.y, e[1].y), 0)
  > 0.5::DOUBLE * (q.w * q.h + e[1].w * e[1].h - greatest(least(q.x + q.w, e[1].x + e[1].w) - greatest(q.x, e[1].x), 0) * greatest(least(q.y + q.h, e[1].y + e[1].h) - greatest(q.y, e[1].y), 0)))) > 0
  THEN acc ELSE list_concat(acc, e) END)) AS r FROM l)"""


@query("g09_nms", _NMS_SQL + " SELECT image_id, r.id AS box_id, r.x AS x, r.y AS y, r.w AS w, r.h AS h, r.s AS score FROM k")
def g09(spark, sf):
    return G.nms(_detections(spark, sf))


@query("g09_best_box", f"""WITH {PRED_SQL} SELECT image_id, max(score) AS score, arg_max(box_id,
  (score, -box_id)) AS box_id FROM det GROUP BY 1""")
def g09b(spark, sf):
    return G.best_box(_detections(spark, sf)).select("image_id", "score", "box_id")


@query("g10_normalize_bounds", """WITH b AS (SELECT p_partkey, p_size % 5 AS k, p_size AS s FROM part)
SELECT p_partkey, k IN (1, 2, 3) AS ok, coalesce(CASE WHEN k IN (1, 2, 3) THEN s END, -1)::INT AS x1, coalesce(CASE WHEN k IN (1, 2, 3) THEN s + 1 END, -1)::INT AS y1,
  coalesce(CASE WHEN k IN (1, 2, 3) THEN s * 3 END, -1)::INT AS x2, coalesce(CASE WHEN k IN (1, 2, 3) THEN s * 4 END, -1)::INT AS y2,
  coalesce(CASE k WHEN 1 THEN s * 3 - s WHEN 2 THEN s * 2 WHEN 3 THEN s * 2 END, -1)::INT AS width,
  coalesce(CASE k WHEN 3 THEN s * 5 WHEN 1 THEN s * 4 - s - 1 WHEN 2 THEN s * 4 - s - 1 END, -1)::INT AS height FROM b""")
def g10(spark, sf):
    s = F.col("p_size")
    full = F.array(*[c.cast("double") for c in (s, s + 1, s * 3, s * 4, s * 2, s * 5, s * 6)])
    n = F.element_at(F.array(*[F.lit(v) for v in (3, 4, 5, 6, 7)]), s % 5 + 1)
    part = table(spark, sf, "part").select("p_partkey", G.normalize_bounds(F.slice(full, F.lit(1), n)).alias("b"), (s % 5).alias("k"))
    return part.select("p_partkey", F.col("b").isNotNull().alias("ok"), *[
        F.coalesce(F.col("b")[c], F.lit(-1)).alias(c) for c in ("x1", "y1", "x2", "y2", "width", "height")])
