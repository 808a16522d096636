"""Comparison and quality queries (Q1-Q11, V1) and scoring (M) over the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framewright.operators import compare as Q
from framewright.operators import scoring as M
from framewright.plans.adapters import FEATURES_SQL, div, features, r, rnd, table
from framewright.plans.registry import query

# Run a is the embedding; run b is cut to steps of 1/512, lacks some tensors and has short ones.
TENS_SQL = """ta AS (SELECT vec_id AS tensor_id, label, embedding AS v FROM embeddings),
tb AS (SELECT vec_id AS tensor_id, CASE WHEN vec_id % 19 = 3 THEN b[1:60] ELSE b END AS v FROM (SELECT vec_id,
  list_transform(embedding, lambda x: CASE WHEN vec_id % 5 = 0 THEN x ELSE (floor(x * 512::FLOAT) / 512)::FLOAT END) AS b
  FROM embeddings WHERE vec_id % 17 <> 0)),
el AS (SELECT ta.tensor_id, label, i - 1 AS pos, ta.v[i]::DOUBLE AS a, tb.v[i]::DOUBLE AS b, abs(ta.v[i]::DOUBLE - tb.v[i]::DOUBLE) AS d
  FROM ta JOIN tb USING (tensor_id), range(1, 65) t(i) WHERE len(ta.v) = len(tb.v)),
st AS (SELECT tensor_id, label, CASE WHEN tb.v IS NULL THEN 'only a' WHEN ta.v IS NULL THEN 'only b' WHEN len(ta.v) = len(tb.v) THEN 'paired' ELSE 'shape' END AS status
  FROM ta FULL JOIN tb USING (tensor_id)),
sides AS (SELECT label, count(*) FILTER (status = 'paired') AS paired, count(*) FILTER (status = 'only a') AS only_a, count(*) FILTER (status = 'only b') AS only_b,
  count(*) FILTER (status = 'shape') AS other_shape FROM st GROUP BY 1)"""


def run_a(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("tensor_id"), "label", F.col("embedding").alias("values"))


def run_b(spark, sf):
    step = F.transform("values", lambda x: F.when(F.col("tensor_id") % 5 == 0, x).otherwise(
        (F.floor(x * F.lit(512.0).cast("float")) / F.lit(512.0)).cast("float")))
    cut = F.when(F.col("tensor_id") % 19 == 3, F.slice(step, 1, 60)).otherwise(step)
    return run_a(spark, sf).filter("tensor_id % 17 <> 0").select("tensor_id", cut.alias("values"))


def pairs(spark, sf):
    return Q.paired(run_a(spark, sf), run_b(spark, sf), keep=("label",))


def _round(df, digits=9):
    return df.withColumns({f.name: rnd(F.col(f.name), digits) for f in df.schema if f.dataType.typeName() == "double"})


@query("q01_tensor_stats", f"""SELECT vec_id AS tensor_id, {r('min(v)', 9)} AS min, {r('max(v)', 9)} AS max, {r('avg(v)', 9)} AS mean,
  {r('stddev_pop(v)', 9)} AS std, count(*) FILTER (v <> 0) AS nonzero_count, count(*) AS total_elements
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1""")
def q01(spark, sf):
    return _round(Q.tensor_stats(run_a(spark, sf)))


@query("q02_tensor_diff", f"""WITH {TENS_SQL} SELECT label, count(d) AS n, {r('avg(d)', 9)} AS mae, {r('max(d)', 9)} AS max_diff, {r('sqrt(avg(d*d))', 9)} AS rmse,
  {r('avg((d = 0)::INT) * 100', 9)} AS pct_exact, {r('avg((d < 1e-3::DOUBLE)::INT) * 100', 9)} AS pct_lt_1e3, {r('avg((d < 1e-2::DOUBLE)::INT) * 100', 9)} AS pct_lt_1e2,
  {r('avg((d > 1e-2::DOUBLE)::INT) * 100', 9)} AS pct_gt_1e2,
  any_value(paired) AS paired, any_value(only_a) AS only_a, any_value(only_b) AS only_b, any_value(other_shape) AS other_shape FROM sides LEFT JOIN el USING (label) GROUP BY 1""")
def q02(spark, sf):
    return _round(Q.tensor_diff(pairs(spark, sf), ["label"]))


@query("q03_diff_by_frame", f"""WITH {TENS_SQL} SELECT tensor_id, 'paired' AS status, (pos // 8)::INT AS frame, {r('avg(d)', 9)} AS mean_diff, {r('max(d)', 9)} AS max_diff,
  count(*) FILTER (a <> 0) AS nonzero_a, count(*) FILTER (b <> 0) AS nonzero_b, max(d) <= 1e-3::DOUBLE AS passed FROM el GROUP BY 1, 3
UNION ALL SELECT tensor_id, status, -1, NULL, NULL, 0, 0, false FROM st WHERE status <> 'paired'""")
def q03(spark, sf):
    out = Q.diff_by_frame(pairs(spark, sf), 8)
    return _round(out.withColumns({"frame": F.coalesce("frame", F.lit(-1)), **{c: F.coalesce(c, F.lit(0).cast("long")) for c in ("nonzero_a", "nonzero_b")}}))


@query("q04_top_diffs", f"""WITH {TENS_SQL} SELECT tensor_id, pos::INT AS pos, {r('d', 9)} AS diff, {r('a', 9)} AS a, {r('b', 9)} AS b, (pos // 8)::INT AS row, (pos % 8)::INT AS col,
  (SELECT count(*) FROM st WHERE status <> 'paired') AS unpaired FROM el ORDER BY d DESC, tensor_id, pos LIMIT 10""")
def q04(spark, sf):
    return _round(Q.top_diffs(pairs(spark, sf), 10, (8, 8)))


@query("q05_error_histogram", f"""WITH {TENS_SQL} SELECT label, count(d) AS n, count(*) FILTER (d > 1e-6::DOUBLE) AS gt_1, count(*) FILTER (d > 10 * 1e-6::DOUBLE) AS gt_10,
  count(*) FILTER (d > 100 * 1e-6::DOUBLE) AS gt_100, count(*) FILTER (d > 1000 * 1e-6::DOUBLE) AS gt_1000, {r('count(*) FILTER (d > 1e-6::DOUBLE) * 100.0::DOUBLE / count(d)', 9)} AS mismatch_pct,
  any_value(paired) AS paired, any_value(only_a) AS only_a, any_value(only_b) AS only_b, any_value(other_shape) AS other_shape FROM sides LEFT JOIN el USING (label) GROUP BY 1""")
def q05(spark, sf):
    return _round(Q.error_histogram(pairs(spark, sf), 1e-6, ["label"]))


@query("q06_tolerance_gate", f"""WITH {TENS_SQL}, g AS (SELECT tensor_id, abs(min(a) - min(b)) <= 0.01::DOUBLE AND abs(max(a) - max(b)) <= 0.01::DOUBLE AND abs(avg(a) - avg(b)) <= 0.01::DOUBLE
  AND abs(stddev_pop(a) - stddev_pop(b)) <= 0.01::DOUBLE AS stats_ok, max(d) <= 0.1::DOUBLE AS max_ok, avg(d) <= 0.01::DOUBLE AS mean_ok, max(d) <= 1e-5::DOUBLE AS identical FROM el GROUP BY 1)
SELECT tensor_id, stats_ok IS NOT NULL AS shape_ok, coalesce(stats_ok, false) AS stats_ok, coalesce(max_ok, false) AS max_ok, coalesce(mean_ok, false) AS mean_ok,
  coalesce(identical, false) AS identical, coalesce(stats_ok AND max_ok AND mean_ok, false) AS passed FROM ta LEFT JOIN g USING (tensor_id)""")
def q06(spark, sf):
    return Q.tolerance_gate(Q.paired(run_a(spark, sf), run_b(spark, sf)))


@query("q07_value_bands", f"""SELECT label, {r('avg((v BETWEEN -0.1::DOUBLE AND 0.1::DOUBLE)::INT) * 100', 9)} AS near_zero,
  {r('avg((v BETWEEN 0.9::DOUBLE AND 1.0::DOUBLE)::INT) * 100', 9)} AS near_one, {r('avg((v BETWEEN -1.0::DOUBLE AND -0.9::DOUBLE)::INT) * 100', 9)} AS near_minus_one
FROM (SELECT label, unnest(embedding)::DOUBLE * 4 AS v FROM embeddings) GROUP BY 1""")
def q07(spark, sf):
    wide = run_a(spark, sf).withColumn("values", F.transform("values", lambda x: x.cast("double") * 4))
    return _round(Q.value_bands(wide, ["label"]))


# Short integer vectors made of line items, so that equal rows occur in every group.
_VEC_SQL = """vec AS (SELECT l_suppkey % 8 AS grp, row_number() OVER () AS rn, l_orderkey * 64 + l_partkey % 8 * 8 + l_linenumber AS idx,
  l_linenumber AS a, l_quantity::INT // 10 AS b, (l_discount * 100)::INT AS c FROM lineitem)"""


def _vectors(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 8).alias("grp"),
        (F.col("l_orderkey") * 64 + F.col("l_partkey") % 8 * 8 + F.col("l_linenumber")).alias("idx"),
        F.array(F.col("l_linenumber"), F.floor(F.col("l_quantity") / 10).cast("int"),
                F.round(F.col("l_discount") * 100).cast("int")).alias("values"))


@query("q08_unique_rows", f"""WITH {_VEC_SQL} SELECT grp, count(*) AS n_rows, count(DISTINCT (a, b, c)) AS n_unique FROM vec GROUP BY 1""")
def q08(spark, sf):
    return Q.unique_rows(_vectors(spark, sf), "grp", "idx")


@query("q08_first_matches", f"""WITH {_VEC_SQL}, g AS (SELECT *, min(idx) OVER w AS first_idx, count(*) OVER w AS copies FROM vec
  WINDOW w AS (PARTITION BY grp, a, b, c)) SELECT grp, first_idx, idx, copies FROM g WHERE copies > 1 AND idx <> first_idx""")
def q08b(spark, sf):
    return Q.first_matches(_vectors(spark, sf), "grp", "idx")


@query("q09_constant_features", """WITH v AS (SELECT doc_id // 50 AS grp, unnest([0, 1, 2, 3]) AS pos, unnest([7, doc_id % 2, n_chars // 1000, CASE lang WHEN 'xx' THEN 1 ELSE 0 END]) AS v FROM documents),
s AS (SELECT grp, pos, min(v) = max(v) AS const FROM v GROUP BY 1, 2)
SELECT grp, count(*) FILTER (const) AS constant, count(*) FILTER (NOT const) AS varying FROM s GROUP BY 1""")
def q09(spark, sf):
    docs = table(spark, sf, "documents")
    vec = F.array(F.lit(7).cast("long"), F.col("doc_id") % 2, div(F.col("n_chars"), 1000),
                  F.when(F.col("lang") == "xx", 1).otherwise(0).cast("long"))
    return Q.constant_features(docs.select(div(F.col("doc_id"), 50).alias("grp"), vec.alias("values")), ["grp"])


@query("q10_zero_vectors", """WITH v AS (SELECT l_suppkey, (l_discount = 0)::INT + (l_tax = 0)::INT + (l_quantity::INT % 10 = 0)::INT AS z FROM lineitem)
SELECT l_suppkey, count(*) AS vectors, count(*) FILTER (z = 3) AS all_zero, count(*) FILTER (z > 0) AS with_zero, sum(z)::BIGINT AS zero_values FROM v GROUP BY 1""")
def q10(spark, sf):
    vec = F.array(F.col("l_discount"), F.col("l_tax"), (F.col("l_quantity").cast("int") % 10).cast("double"))
    return Q.zero_vectors(table(spark, sf, "lineitem").select("l_suppkey", vec.alias("values")), ["l_suppkey"])


@query("q11_image_size_match", """SELECT o_orderkey AS frame_idx, (o_custkey % 20)::INT AS w, (o_custkey % 20)::INT AS h, coalesce(p_size, -1)::INT AS stored_w, coalesce(p_size, -1)::INT AS stored_h, coalesce(o_custkey % 20 = p_size, false) AS match
FROM orders LEFT JOIN part ON p_partkey = o_orderkey""")
def q11(spark, sf):
    side = (F.col("o_custkey") % 20).cast("int")
    got = table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_idx"), side.alias("w"), side.alias("h"))
    stored = table(spark, sf, "part").select(F.col("p_partkey").alias("frame_idx"), F.col("p_size").alias("w"), F.col("p_size").alias("h"))
    out = Q.image_size_match(got, stored, ["frame_idx"])
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("stored_w", "stored_h")})


@query("v01_validate_requests", """WITH q AS (SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 23 = 0 THEN '' ELSE 'm' END AS model_id, (o_custkey % 36)::INT AS batch_size,
  (o_custkey % 36) * 2457600 + CASE WHEN o_orderkey % 11 = 0 THEN 4 ELSE 0 END AS visual_bytes, CASE WHEN o_orderkey % 3 = 0 THEN 640 ELSE 0 END AS raw_audio_bytes,
  CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 100 ELSE 32768 END AS feature_bytes FROM orders),
e AS (SELECT request_id, CASE WHEN model_id = '' THEN 'no model named' WHEN batch_size <= 0 OR batch_size > 32 THEN 'batch outside 1 to 32: ' || batch_size
  WHEN visual_bytes <> batch_size::BIGINT * 2457600 THEN 'frames have ' || visual_bytes || ' bytes instead of ' || (batch_size::BIGINT * 2457600)
  WHEN raw_audio_bytes = 0 AND feature_bytes > 0 AND feature_bytes <> 32768 THEN 'features have ' || feature_bytes || ' bytes instead of 32768'
  WHEN raw_audio_bytes = 0 AND feature_bytes = 0 THEN 'neither audio nor features' END AS error FROM q)
SELECT request_id, error, error IS NULL AS success FROM e""")
def v01(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    batch = (c % 36).cast("int")
    req = table(spark, sf, "orders").select(
        o.alias("request_id"), F.when(c % 23 == 0, "").otherwise("m").alias("model_id"), batch.alias("batch_size"),
        (batch.cast("long") * 2457600 + F.when(o % 11 == 0, 4).otherwise(0)).alias("visual_bytes"),
        F.when(o % 3 == 0, 640).otherwise(0).alias("raw_audio_bytes"),
        F.when(o % 5 == 0, 0).when(o % 5 == 1, 100).otherwise(32768).alias("feature_bytes"))
    return Q.validate_requests(req).select("request_id", "error", "success")


def _load_linear():
    return np.arange(64) % 5 - 2.0


@query("m01_score_batches", f"""SELECT vec_id, {r('list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * ((i - 1) % 5 - 2)))')} AS score FROM embeddings""")
def m01(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = M.score_batches(rows, "embedding", _load_linear, lambda w, x: x.astype(np.float64) @ w, "vec_id")
    return out.select("vec_id", rnd(F.col("score")).alias("score"))


@query("m02_cosine_sync_loss", f"""WITH {FEATURES_SQL}, p AS (SELECT a.clip_id, a.frame_idx, list_dot_product(a.feature::DOUBLE[], b.feature::DOUBLE[]) /
  (sqrt(list_dot_product(a.feature::DOUBLE[], a.feature::DOUBLE[])) * sqrt(list_dot_product(b.feature::DOUBLE[], b.feature::DOUBLE[]))) AS c
  FROM feats a JOIN feats b ON b.clip_id = a.clip_id AND b.frame_idx = a.frame_idx + 1)
SELECT clip_id, frame_idx, {r('c')} AS cosine, {r('CASE WHEN c > 0 THEN least(-ln(c), 100) ELSE 100 END')} AS loss FROM p""")
def m02(spark, sf):
    f = features(spark, sf)
    audio = f.select("clip_id", "frame_idx", F.col("feature").alias("vec"))
    video = f.filter("frame_idx > 0").select("clip_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("feature").alias("vec"))
    return _round(M.cosine_sync_loss(audio, video, ["clip_id", "frame_idx"]), 6)


@query("m03_l1_mse_metrics", f"""WITH {TENS_SQL}, t AS (SELECT tensor_id, label, avg(d) AS l1, avg(d * d) AS mse, any_value(label) * 0.5::DOUBLE AS p, any_value(tensor_id) % 7 * 0.25::DOUBLE AS s FROM el GROUP BY 1, 2)
SELECT label, {r('avg(l1)', 9)} AS l1, {r('avg(mse)', 9)} AS mse, {r('avg(p)', 9)} AS perceptual, {r('avg(s)', 9)} AS sync, {r('avg(l1) + avg(p) * 0.01::DOUBLE + avg(s) * 10', 9)} AS total,
  any_value(only_a + other_shape) AS unmatched FROM sides LEFT JOIN t USING (label) GROUP BY 1""")
def m03(spark, sf):
    pred = run_a(spark, sf).withColumns({"p": F.col("label") * 0.5, "s": F.col("tensor_id") % 7 * 0.25})
    return _round(M.l1_mse_metrics(pred, run_b(spark, sf), ["tensor_id"], ["label"], "p", "s"))


@query("m04_best_so_far", """SELECT event_type AS run, event_id AS epoch, value AS loss FROM (SELECT *, min(value) OVER (PARTITION BY event_type ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) WHERE best IS NULL OR value < best""")
def m04(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("loss"))
    return M.best_so_far(log, "run", "epoch", "loss")
