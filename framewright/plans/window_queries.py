"""Window queries (W) over the step series and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import windows as W
from framewright.plans.adapters import (
    CLIPS_SQL, FEATURES_SQL, STEPS_SQL, features, r, rnd, step_series, table, text_blocks, weigh, weigh_flat, weigh_grid,
)
from framewright.plans.registry import query


_GRID, _STACK = weigh_grid(16, 4), weigh_grid(5, 16, 4)


def _chk(window):
    """``sum (j+1) * weigh(row j)`` over the rows of a window, up to 16 of four values."""
    return _GRID(F.flatten(window))


def _windows_sql(lo: int, hi: int, pad: str) -> str:
    src = "least(greatest(w + o, 0), n - 1)" if pad == "edge" else "w + o"
    join = "LEFT JOIN" if pad == "zero" else "JOIN"
    keep = f"WHERE w + {lo} >= 0 AND w + {hi - 1} < n" if pad == "drop" else ""
    return f"""WITH {STEPS_SQL},
want AS (SELECT clip_id, frame_idx AS w, o, n, {src} AS src FROM steps JOIN lens USING (clip_id), range({lo}, {hi}) t(o))
SELECT want.clip_id, w AS window_idx, count(*) AS size, {r(f'sum((o - ({lo}) + 1) * coalesce(v, 0))')} AS chk
FROM want {join} steps ON steps.clip_id = want.clip_id AND steps.frame_idx = src {keep} GROUP BY 1, 2"""


def _out(df):
    return df.select("clip_id", "window_idx", F.size("window").cast("long").alias("size"),
                     rnd(_chk(F.col("window"))).alias("chk"))


@query("w01_sliding_windows", _windows_sql(0, 16, "edge"))
def w01(spark, sf):
    return _out(W.sliding_windows(step_series(spark, sf), "vec"))


@query("w01_sliding_windows_strict", _windows_sql(0, 16, "drop"))
def w01b(spark, sf):
    return _out(W.sliding_windows(step_series(spark, sf), "vec", strict=True))


@query("w01_complete_windows", f"""WITH {STEPS_SQL}, g AS (SELECT * FROM steps WHERE frame_idx % 23 <> 7)
SELECT a.clip_id, a.frame_idx AS window_idx, CASE WHEN count(*) = 5 THEN {r('sum((o + 1) * b.v)')} END AS chk
FROM g a, range(5) t(o) JOIN g b ON b.clip_id = a.clip_id AND b.frame_idx = a.frame_idx + o GROUP BY 1, 2""")
def w01d(spark, sf):
    """Every 23rd frame is missing, so the windows that would hold it are null."""
    out = W.complete_windows(step_series(spark, sf).where("frame_idx % 23 <> 7"), "vec")
    return out.select("clip_id", "window_idx", rnd(_chk(F.col("window"))).alias("chk"))


@query("w01_too_short", f"""WITH {STEPS_SQL} SELECT clip_id, n,
  n || ' of 16 frames' AS error FROM lens WHERE n < 16""")
def w01c(spark, sf):
    return W.too_short(step_series(spark, sf))


@query("w02_batch_windows", f"""WITH {STEPS_SQL},
want AS (SELECT clip_id, n, w, o FROM lens, range(8) a(w), range(16) b(o) WHERE n > 5),
got AS (SELECT want.clip_id, 5 + w AS window_idx, sum((o + 1) * v) AS chk FROM want JOIN steps
  ON steps.clip_id = want.clip_id AND frame_idx = least(5 + w + o, n - 1) GROUP BY 1, 2)
SELECT clip_id, window_idx, {r('chk')} AS chk, NULL AS error FROM got
UNION ALL SELECT clip_id, -1, NULL, 'a start at 5 does not lie in a clip of ' || n FROM lens WHERE n <= 5""")
def w02(spark, sf):
    out = W.batch_windows(step_series(spark, sf), "vec", batch=8, start=5)
    return out.select("clip_id", F.coalesce("window_idx", F.lit(-1)).alias("window_idx"),
                      rnd(_chk(F.col("window"))).alias("chk"), "error")


_ONLINE = "greatest(((n - 16) * 25 // 80), 0)"
_OFFLINE = "greatest(trunc((n - 16) / 80.0::DOUBLE * 25.0::DOUBLE)::BIGINT + 2, 0)"


def _clock_sql(count: str) -> str:
    return f"""WITH {STEPS_SQL},
fr AS (SELECT clip_id, n, unnest(range({count})) AS f FROM lens),
st AS (SELECT clip_id, n, f, greatest(CASE WHEN 80*f//25 + 16 > n THEN n - 16 ELSE 80*f//25 END, 0) AS st FROM fr)
SELECT st.clip_id, f AS video_frame, min(frame_idx) AS first_src, count(*) AS size, {r('sum((j + 1) * v)')} AS chk
FROM st, range(16) t(j) JOIN steps ON steps.clip_id = st.clip_id AND frame_idx = least(st + j, n - 1) GROUP BY 1, 2"""


def _clock_out(spark, sf, **kw):
    # The row index rides along as a fifth value with weight 0 in the checksum.
    series = step_series(spark, sf).withColumn("row", F.struct(F.col("frame_idx").alias("i"), F.col("vec").alias("x")))
    out = W.clock_aligned_windows(series, "row", **kw)
    return out.select(
        "clip_id", "video_frame", F.col("window")[0]["i"].alias("first_src"),
        F.size("window").cast("long").alias("size"),
        rnd(_chk(F.transform("window", lambda x: x["x"]))).alias("chk"))


@query("w03_clock_aligned_windows", _clock_sql(_ONLINE))
def w03(spark, sf):
    return _clock_out(spark, sf, mode="online")


@query("w03_clock_aligned_windows_offline", _clock_sql(_OFFLINE))
def w03b(spark, sf):
    return _clock_out(spark, sf, mode="offline")


@query("w03_clock_aligned_windows_capped", _clock_sql(f"least({_ONLINE}, 24)"))
def w03c(spark, sf):
    return _clock_out(spark, sf, mode="online", batch=8)


@query("w04_video_frame_count", f"""WITH {STEPS_SQL} SELECT clip_id, n, {_ONLINE} AS online,
  least({_ONLINE}, 24) AS capped, {_OFFLINE} AS offline FROM lens""")
def w04(spark, sf):
    n = F.col("n")
    return step_series(spark, sf).groupBy("clip_id").agg((F.max("frame_idx") + 1).alias("n")).select(
        "clip_id", "n", W.video_frame_count(n).alias("online"),
        W.video_frame_count(n, batch=8).alias("capped"), W.video_frame_count(n, "offline").alias("offline"))


@query("w05_center_window", f"""WITH {STEPS_SQL}
SELECT clip_id, 16::BIGINT AS size, {r('sum((frame_idx - greatest((n - 16) // 2, 0) + 1) * v)')} AS chk
FROM steps JOIN lens USING (clip_id)
WHERE frame_idx - greatest((n - 16) // 2, 0) BETWEEN 0 AND 15 GROUP BY 1""")
def w05(spark, sf):
    return W.center_window(step_series(spark, sf), "vec").select(
        "clip_id", F.size("window").cast("long").alias("size"), rnd(_chk(F.col("window"))).alias("chk"))


@query("w06_edge_pad", f"""WITH {STEPS_SQL}
SELECT clip_id, frame_idx + 1 AS frame_idx, {r('v')} AS chk FROM steps
UNION ALL SELECT clip_id, 0, {r('v')} FROM steps WHERE frame_idx = 0
UNION ALL SELECT clip_id, n + 1, {r('v')} FROM steps JOIN lens USING (clip_id) WHERE frame_idx = n - 1""")
def w06(spark, sf):
    return W.edge_pad(step_series(spark, sf), "vec").select(
        "clip_id", "frame_idx", rnd(weigh(F.col("vec"))).alias("chk"))


@query("w07_context_windows_zero", _windows_sql(-8, 8, "zero"))
def w07(spark, sf):
    return _out(W.context_windows(step_series(spark, sf), "vec"))


@query("w07_context_windows_edge", _windows_sql(-8, 8, "edge"))
def w07b(spark, sf):
    return _out(W.context_windows(step_series(spark, sf), "vec", pad="edge"))


@query("w08_causal_windows", _windows_sql(-8, 0, "zero"))
def w08(spark, sf):
    return _out(W.causal_windows(step_series(spark, sf), "vec"))


@query("w09_forward_slice", _windows_sql(-1, 2, "edge"))
def w09(spark, sf):
    return _out(W.forward_slice(step_series(spark, sf), "vec"))


@query("w10_segmented_windows", f"""WITH {STEPS_SQL},
fr AS (SELECT clip_id, n, unnest(range({_OFFLINE})) AS f FROM lens),
st AS (SELECT clip_id, n, f, k, CASE WHEN 80*(f-1+k)//25 + 16 > n THEN n - 16 ELSE 80*(f-1+k)//25 END AS st
  FROM fr, range(5) t(k) WHERE f >= 1 AND n >= 16),
got AS (SELECT st.clip_id, f, sum((k + 1) * (j + 1) * v) AS chk FROM st, range(16) t(j)
  JOIN steps ON steps.clip_id = st.clip_id AND frame_idx = st + j GROUP BY 1, 2)
SELECT fr.clip_id, fr.f AS video_frame, {r('chk')} AS chk FROM fr LEFT JOIN got ON got.clip_id = fr.clip_id AND got.f = fr.f""")
def w10(spark, sf):
    out = W.segmented_windows(step_series(spark, sf), "vec")
    chk = _STACK(F.flatten(F.flatten("window")))
    return out.select("clip_id", "video_frame", rnd(chk).alias("chk"))


@query("w11_transpose_window", f"""WITH {STEPS_SQL}
SELECT w.clip_id, w.frame_idx AS window_idx, {r('sum((o + 1) * list_sum(x.q) + 16 * (x.q[2] + 2 * x.q[3] + 3 * x.q[4]))')} AS chk
FROM steps w JOIN lens USING (clip_id), range(16) a(o) JOIN steps x ON x.clip_id = w.clip_id AND x.frame_idx = least(w.frame_idx + o, n - 1) GROUP BY 1, 2""")
def w11(spark, sf):
    out = W.sliding_windows(step_series(spark, sf), "vec")
    flat = F.flatten(W.transpose_window(F.col("window"), 4, 16))
    return out.select("clip_id", "window_idx", rnd(weigh_flat(flat)).alias("chk"))


@query("w11_reshape_check", """WITH t AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN 'ave' WHEN 1 THEN 'hubert'
  WHEN 2 THEN 'wenet' ELSE 'other' END AS mode, CASE WHEN n_chars % 2 = 0 THEN 8192 ELSE 32768 END AS len FROM documents),
u AS (SELECT *, CASE mode WHEN 'ave' THEN 8192 WHEN 'hubert' THEN 32768 WHEN 'wenet' THEN 131072 END AS want FROM t)
SELECT doc_id, mode, CASE WHEN want IS NULL THEN 'no layout for ' || mode WHEN want <> len THEN
  len || ' values do not fill ' || want END AS error FROM u""")
def w11b(spark, sf):
    docs = table(spark, sf, "documents")
    mode = F.element_at(F.array(F.lit("ave"), F.lit("hubert"), F.lit("wenet"), F.lit("other")),
                        (F.col("doc_id") % 4 + 1).cast("int"))
    flat = F.array_repeat(F.lit(0.0), F.when(F.col("n_chars") % 2 == 0, 8192).otherwise(32768))
    return docs.select("doc_id", mode.alias("mode"), W.reshape_check(flat, mode).alias("error"))


@query("w12_tile_feature", f"""WITH {FEATURES_SQL}, lens AS (SELECT clip_id, max(frame_idx) AS last FROM feats GROUP BY 1),
req AS (SELECT o_orderkey AS request_id, o_custkey % (SELECT max(clip_id) + 1 FROM lens) AS clip_id, o_orderkey % 80 AS frame_idx FROM orders),
k AS (SELECT request_id, clip_id, least(frame_idx, last) AS frame_idx FROM req JOIN lens USING (clip_id))
SELECT request_id, clip_id, frame_idx AS src_idx, (len(feature) * 16)::BIGINT AS n,
  {r('list_sum(list_transform(feature, lambda v, i: v::DOUBLE * (256.0::DOUBLE * (i - 1) + 136)))', 4)} AS chk
FROM k JOIN feats USING (clip_id, frame_idx)""")
def w12(spark, sf):
    clips = features(spark, sf).agg((F.max("clip_id") + 1).alias("clips"))
    req = table(spark, sf, "orders").crossJoin(F.broadcast(clips)).select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % F.col("clips")).alias("clip_id"),
        (F.col("o_orderkey") % 80).alias("frame_idx"))
    out = W.clamped_features(req, features(spark, sf), "feature").withColumn(
        "tile", W.tile_feature(F.col("feature")))
    return out.select("request_id", "clip_id", "src_idx", F.size("tile").cast("long").alias("n"),
                      rnd(weigh_flat("tile"), 4).alias("chk"))


@query("w13_replicate_feature", f"""WITH {FEATURES_SQL}
SELECT vec_id, b::INT AS batch_frame, {r('list_sum(list_transform(feature, lambda v: v::DOUBLE))')} AS chk
FROM (SELECT *, unnest(range(label % 4 + 1)) AS b FROM feats)""")
def w13(spark, sf):
    total = F.aggregate("feature", F.lit(0.0), lambda a, v: a + v.cast("double"))
    slim = features(spark, sf).select("vec_id", "label", rnd(total).alias("chk"))
    return W.replicate_feature(slim, F.col("label") % 4 + 1).select("vec_id", "batch_frame", "chk")


@query("w14_chunk_windows", f"""WITH {STEPS_SQL},
req AS (SELECT clip_id AS request_id, clip_id % 25 + 1 AS frames, n AS chunks FROM lens),
ok AS (SELECT *, unnest(range(frames)) AS i FROM req WHERE chunks >= frames + 15)
SELECT request_id, i AS window_idx, {r('(frames*16 - chunks) / (frames*16)::DOUBLE')} AS saved_share,
  {r('sum((j + 1) * v)')} AS chk, NULL AS error FROM ok, range(16) t(j) JOIN steps
  ON steps.clip_id = request_id AND frame_idx = i + j GROUP BY ALL
UNION ALL SELECT request_id, -1, NULL, NULL, 'wants ' || (frames + 15) || ' chunks, has ' || chunks
FROM req WHERE chunks < frames + 15""")
def w14(spark, sf):
    chunks = step_series(spark, sf).select(F.col("clip_id").alias("request_id"),
                                           F.col("frame_idx").alias("chunk_idx"), "vec")
    req = text_blocks(spark, sf).filter("block_idx = 0").select(
        F.col("clip_id").alias("request_id"), (F.col("clip_id") % 25 + 1).alias("frames"))
    out = W.chunk_windows(chunks, req, "vec")
    return out.select("request_id", F.coalesce("window_idx", F.lit(-1)).alias("window_idx"),
                      rnd(F.col("saved_share")).alias("saved_share"),
                      rnd(_chk(F.col("window"))).alias("chk"), "error")
