"""Frame-key queries (J): line items are frames, parts are ring rows and rects."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import frames as J
from framewright.operators.windows import context_windows
from framewright.plans.adapters import FEATURES_SQL, div, features, r, rnd, table, weigh
from framewright.plans.registry import query

FRAMES_SQL = """frames AS (SELECT 'm' || (o_custkey % 16) AS model_id, o_orderkey AS frame_idx,
  (640 + o_custkey % 7 * 100)::INT AS width, (480 + o_orderkey % 5 * 60)::INT AS height FROM orders),
ring AS (SELECT 'm' || (p_partkey % 16) AS model_id, p_partkey // 16 AS ring_idx, p_size, p_name FROM part),
rects AS (SELECT model_id, ring_idx AS frame_idx, (p_size * 20 - 60)::INT AS x1, (p_size * 11 - 40)::INT AS y1,
  (p_size * 20 - 60 + 180 + p_size % 9)::INT AS x2, (p_size * 11 - 40 + 180 + p_size % 9)::INT AS y2 FROM ring WHERE p_size > 5)"""


def frames(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 16).cast("string")).alias("model_id"),
        F.col("o_orderkey").alias("frame_idx"),
        (640 + F.col("o_custkey") % 7 * 100).cast("int").alias("width"),
        (480 + F.col("o_orderkey") % 5 * 60).cast("int").alias("height"))


def ring(spark, sf):
    return table(spark, sf, "part").select(
        F.concat(F.lit("m"), (F.col("p_partkey") % 16).cast("string")).alias("model_id"),
        div(F.col("p_partkey"), 16).alias("ring_idx"), "p_size", "p_name")


def rects(spark, sf):
    s = F.col("p_size")
    x, y, side = s * 20 - 60, s * 11 - 40, 180 + s % 9
    return ring(spark, sf).filter("p_size > 5").select(
        "model_id", F.col("ring_idx").alias("frame_idx"), x.alias("x1"), y.alias("y1"),
        (x + side).alias("x2"), (y + side).alias("y2"))


_SIZES = "sizes AS (SELECT model_id, max(ring_idx) + 1 AS n FROM ring GROUP BY 1)"


@query("j01_cyclic_join", f"""WITH {FRAMES_SQL}, {_SIZES}
SELECT f.model_id, f.frame_idx, f.frame_idx % n AS ring_idx, p_size, p_name FROM frames f JOIN sizes USING (model_id)
JOIN ring r ON r.model_id = f.model_id AND r.ring_idx = f.frame_idx % n""")
def j01(spark, sf):
    return J.cyclic_join(frames(spark, sf).select("model_id", "frame_idx"), ring(spark, sf))


@query("j02_strict_lookup", f"""WITH {FRAMES_SQL},
l AS (SELECT f.model_id, f.frame_idx // 8 AS batch_id, f.frame_idx, r.x1 IS NULL AS bad FROM frames f LEFT JOIN rects r USING (model_id, frame_idx))
SELECT model_id, batch_id, NOT bool_or(bad) AS success, count(*) FILTER (bad) AS failed,
  'no crop rect for frame ' || min(frame_idx) FILTER (bad) AS first_error FROM l GROUP BY 1, 2""")
def j02(spark, sf):
    looked = J.strict_lookup(frames(spark, sf).select("model_id", "frame_idx"), rects(spark, sf))
    return J.batch_status(looked.withColumn("batch_id", div(F.col("frame_idx"), 8)), ["model_id", "batch_id"])


@query("j03_pingpong_join", f"""WITH {FRAMES_SQL}, {_SIZES},
k AS (SELECT f.model_id, f.frame_idx, (frame_idx + 1) % (2 * (n - 1)) AS p, n - 1 AS top FROM frames f JOIN sizes USING (model_id))
SELECT k.model_id, k.frame_idx, CASE WHEN p <= top THEN p ELSE 2 * top - p END AS ring_idx, p_size, p_name FROM k
JOIN ring r ON r.model_id = k.model_id AND r.ring_idx = CASE WHEN p <= top THEN p ELSE 2 * top - p END""")
def j03(spark, sf):
    return J.pingpong_join(frames(spark, sf).select("model_id", "frame_idx"), ring(spark, sf))


@query("j04_align_modalities", f"""WITH {FEATURES_SQL}, lim AS (SELECT clip_id, max(frame_idx) AS lim FROM feats GROUP BY 1),
img AS (SELECT p_partkey // 50 AS clip_id, p_partkey % 50 AS frame_idx, p_name FROM part),
lmk AS (SELECT c_custkey // 50 AS clip_id, c_custkey % 50 AS frame_idx, c_name FROM customer),
ctx AS (SELECT a.clip_id, a.frame_idx, {r('sum((o + 9) * list_sum(list_transform(b.feature, lambda v: v::DOUBLE)))')} AS ctx
  FROM feats a, range(-8, 8) t(o) LEFT JOIN feats b ON b.clip_id = a.clip_id AND b.frame_idx = a.frame_idx + o GROUP BY 1, 2)
SELECT clip_id::VARCHAR AS model_id, frame_idx, p_name, c_name, ctx FROM img JOIN lmk USING (clip_id, frame_idx)
JOIN ctx USING (clip_id, frame_idx) JOIN lim USING (clip_id) WHERE frame_idx < lim""")
def j04(spark, sf):
    def keyed(name, key, keep):
        return table(spark, sf, name).select(div(F.col(key), 50).cast("string").alias("model_id"),
                                             (F.col(key) % 50).alias("frame_idx"), keep)

    feats = features(spark, sf)
    per_row = F.transform("window", lambda v, j: F.aggregate(
        v, F.lit(0.0), lambda a, b: a + b.cast("double")) * (j + 1))
    ctx = context_windows(feats, "feature").select(
        F.col("clip_id").cast("string").alias("model_id"), F.col("window_idx").alias("frame_idx"),
        rnd(F.aggregate(per_row, F.lit(0.0), lambda a, b: a + b)).alias("ctx"))
    return J.align_modalities(
        keyed("part", "p_partkey", "p_name"), keyed("customer", "c_custkey", "c_name"), ctx,
        feats.select(F.col("clip_id").cast("string").alias("model_id"), "frame_idx"))


@query("j05_exemplar_pairs", f"""WITH {FRAMES_SQL}, {_SIZES}, k AS (SELECT *,
  ('0x' || substr(md5('7:' || model_id || ':' || ring_idx), 1, 15))::BIGINT % n AS exemplar_idx FROM ring JOIN sizes USING (model_id))
SELECT k.model_id, k.ring_idx AS frame_idx, k.exemplar_idx, k.p_name, e.p_name AS exemplar_p_name FROM k
JOIN ring e ON e.model_id = k.model_id AND e.ring_idx = k.exemplar_idx""")
def j05(spark, sf):
    rows = ring(spark, sf).select("model_id", F.col("ring_idx").alias("frame_idx"), "p_name")
    return J.exemplar_pairs(rows, seed=7)


@query("j06_lookup_with_default", f"""WITH {FRAMES_SQL} SELECT model_id, frame_idx, width, height,
  coalesce(x1, width // 2 - 164)::INT AS x1, coalesce(y1, height // 2 - 164)::INT AS y1,
  coalesce(x2, width // 2 + 164)::INT AS x2, coalesce(y2, height // 2 + 164)::INT AS y2
FROM frames LEFT JOIN rects USING (model_id, frame_idx)""")
def j06(spark, sf):
    return J.lookup_with_default(frames(spark, sf), rects(spark, sf))


@query("j06_lookup_bounds_only", f"""WITH {FRAMES_SQL} SELECT model_id, frame_idx, coalesce(x1, 0)::INT AS x1,
  coalesce(y1, 0)::INT AS y1, coalesce(x2, 328)::INT AS x2, coalesce(y2, 328)::INT AS y2
FROM frames LEFT JOIN rects USING (model_id, frame_idx)""")
def j06b(spark, sf):
    return J.lookup_with_default(frames(spark, sf).select("model_id", "frame_idx"), rects(spark, sf), True)


@query("j07_clamp_into_frame", f"""WITH {FRAMES_SQL}, b AS (SELECT model_id, frame_idx, width, height, x1, y1,
  x2 - x1 AS w, y2 - y1 AS h FROM frames JOIN rects USING (model_id, frame_idx)),
c AS (SELECT *, greatest(0, least(x1, width - w)) AS nx, greatest(0, least(y1, height - h)) AS ny FROM b)
SELECT model_id, frame_idx, width, height, nx AS x1, ny AS y1, nx + w AS x2, ny + h AS y2 FROM c""")
def j07(spark, sf):
    return J.clamp_into_frame(frames(spark, sf).join(rects(spark, sf), ["model_id", "frame_idx"]))


@query("j08_playback_lookup", """WITH ev AS (SELECT event_id, user_id % 50 AS stream_id, (value * 100)::BIGINT AS elapsed_ms FROM events),
fr AS (SELECT p_partkey % 50 AS stream_id, p_partkey // 50 AS frame_idx, p_name FROM part)
SELECT event_id, ev.stream_id, elapsed_ms, elapsed_ms // 40 % 60 AS frame_idx, p_name FROM ev
LEFT JOIN fr ON fr.stream_id = ev.stream_id AND fr.frame_idx = elapsed_ms // 40 % 60""")
def j08(spark, sf):
    ev = table(spark, sf, "events").select("event_id", (F.col("user_id") % 50).alias("stream_id"),
                                           F.round(F.col("value") * 100).cast("long").alias("elapsed_ms"))
    fr = table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("stream_id"),
                                         div(F.col("p_partkey"), 50).alias("frame_idx"), "p_name")
    return J.playback_lookup(ev, fr, ring=60)


@query("j08_playback_latest", """SELECT e.event_id, e.user_id, coalesce((SELECT max(f.event_id) FROM events f
  WHERE f.user_id = e.user_id AND f.event_type = 'purchase' AND f.ts <= e.ts), -1) AS frame_id
FROM events e WHERE e.event_type = 'view'""")
def j08b(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    views = ev.filter("event_type = 'view'")
    shown = ev.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("frame_id"))
    return J.playback_latest(views, shown, "user_id", "ts", "event_id", "frame_id").drop("ts").withColumn(
        "frame_id", F.coalesce("frame_id", F.lit(-1).cast("long")))


@query("j09_catalog_with_stats", """WITH s AS (SELECT c_nationkey % 30 AS s_suppkey, count(*) AS requests, max(c_custkey) AS last_used
  FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT s_suppkey, s_name, coalesce(requests, 0) AS requests, coalesce(last_used, -1) AS last_used, requests IS NOT NULL AS loaded
FROM supplier LEFT JOIN s USING (s_suppkey)""")
def j09(spark, sf):
    stats = table(spark, sf, "customer").filter("c_acctbal > 0").groupBy(
        (F.col("c_nationkey") % 30).cast("long").alias("s_suppkey")).agg(
        F.count("*").alias("requests"), F.max("c_custkey").alias("last_used"))
    out = J.catalog_with_stats(table(spark, sf, "supplier").select("s_suppkey", "s_name"), stats, "s_suppkey")
    return out.withColumns({"requests": F.coalesce("requests", F.lit(0)),
                            "last_used": F.coalesce("last_used", F.lit(-1))})


@query("j10_list_only_unready", """SELECT DISTINCT o_custkey AS model_id, 'ready' AS status FROM orders
UNION ALL SELECT c_custkey, 'archived' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def j10(spark, sf):
    ready = table(spark, sf, "orders").select(F.col("o_custkey").alias("model_id")).distinct()
    return J.list_only_unready(ready, table(spark, sf, "customer").select(F.col("c_custkey").alias("model_id")))


_REQUIRED = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("j11_completeness", """WITH h AS (SELECT c_custkey AS model_id, p, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey
  AND o.o_orderpriority = p) AS has FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders),
  (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM')) v(p))
SELECT model_id, coalesce(string_agg(p, ',' ORDER BY p) FILTER (NOT has), '') AS missing, bool_and(has) AS ready FROM h GROUP BY 1""")
def j11(spark, sf):
    files = table(spark, sf, "orders").select(F.col("o_custkey").alias("model_id"),
                                              F.col("o_orderpriority").alias("file"))
    return J.completeness(files, _REQUIRED).withColumn("missing", F.array_join("missing", ","))


@query("j12_latest_checkpoint", """SELECT o_custkey AS model_id, 'ckpt/' || o_custkey || '/' || max(o_orderkey) || '.pth' AS path,
  max(o_orderkey) AS step FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1""")
def j12(spark, sf):
    stem = F.when(F.col("o_orderkey") % 3 == 0, F.lit("best")).otherwise(F.col("o_orderkey").cast("string"))
    files = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("model_id"),
        F.concat(F.lit("ckpt/"), F.col("o_custkey").cast("string"), F.lit("/"), stem, F.lit(".pth")).alias("path"))
    return J.latest_checkpoint(files)


@query("j13_uncached", f"""WITH {FRAMES_SQL} SELECT model_id, frame_idx FROM frames
WHERE (model_id, frame_idx) NOT IN (SELECT model_id, frame_idx FROM rects)""")
def j13(spark, sf):
    return J.uncached(frames(spark, sf).select("model_id", "frame_idx"), rects(spark, sf), ["model_id", "frame_idx"])


@query("j14_epoch_batches", """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY
  ('0x' || substr(md5('3:' || o_orderkey), 1, 15))::BIGINT, o_orderkey) - 1 AS rn FROM orders)
SELECT o_orderkey, rn // 64 AS batch_id, rn % 64 AS batch_pos FROM k""")
def j14(spark, sf):
    return J.epoch_batches(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 64, seed=3)
