"""Telemetry queries (T) over the events seen as a serving log."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import telemetry as T
from framewright.plans.adapters import REQUEST_SQL, div, r, request_log, rnd, table
from framewright.plans.registry import query


def _round(df, digits=6):
    return df.withColumns({f.name: rnd(F.col(f.name), digits) for f in df.schema if f.dataType.typeName() == "double"})


@query("t01_model_stats", f"""WITH {REQUEST_SQL} SELECT model_id, count(*) AS requests, {r('sum(total_ms)')} AS total_ms, epoch_us(max(ts)) AS last_used,
  sum(bytes)::BIGINT AS memory_bytes, {r('avg(total_ms)')} AS avg_ms FROM req GROUP BY 1""")
def t01(spark, sf):
    return _round(T.model_stats(request_log(spark, sf))).withColumn("last_used", F.unix_micros("last_used"))


def _latency_sql(p95: str, p99: str) -> str:
    return f"""WITH {REQUEST_SQL} SELECT model_id, count(*) AS n, {r('avg(total_ms)')} AS mean, {r('stddev_pop(total_ms)')} AS std, min(total_ms) AS min, max(total_ms) AS max,
  {r('quantile_cont(total_ms, 0.5)')} AS median, {r(p95)} AS p95, {r(p99)} AS p99, {r('1000 / avg(total_ms)')} AS fps FROM req GROUP BY 1"""


@query("t02_latency_summary", _latency_sql("quantile_cont(total_ms, 0.95)", "quantile_cont(total_ms, 0.99)"))
def t02(spark, sf):
    return _round(T.latency_summary(request_log(spark, sf), ["model_id"]))


@query("t02_latency_summary_rank", _latency_sql(*[f"list_sort(list(total_ms))[trunc((count(*) - 1) * {p}::DOUBLE)::INT + 1]" for p in ("0.95", "0.99")]))
def t02b(spark, sf):
    return _round(T.latency_summary(request_log(spark, sf), ["model_id"], rule="rank"))


@query("t02_latency_sketch", "SELECT event_type AS model_id, true AS median_close, true AS p95_close, true AS p99_close FROM events GROUP BY 1")
def t02c(spark, sf):
    """Whether the sketch keeps its promise on every group; the exact forms above have their own twins."""
    return T.sketch_rank_errors(request_log(spark, sf), ["model_id"])


@query("t03_warm_summary", f"""WITH {REQUEST_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY batch_size ORDER BY ts, request_id) AS rn FROM req)
SELECT batch_size, count(*) AS iterations, {r('avg(audio_ms)')} AS audio_ms, {r('avg(inference_ms)')} AS inference_ms, {r('avg(composite_ms)')} AS composite_ms, {r('avg(total_ms)')} AS total_ms,
  {r('CASE WHEN batch_size = 0 THEN 0 ELSE avg(total_ms) / batch_size END')} AS ms_per_frame, {r('batch_size * 1000.0::DOUBLE / avg(total_ms)')} AS fps FROM n WHERE rn > 1 GROUP BY 1""")
def t03(spark, sf):
    return _round(T.warm_summary(request_log(spark, sf)))


@query("t04_stage_breakdown", f"""WITH {REQUEST_SQL}, s AS (SELECT model_id, unnest(['audio_ms', 'inference_ms', 'composite_ms']) AS stage, unnest([audio_ms, inference_ms, composite_ms]) AS v FROM req),
g AS (SELECT model_id, stage, sum(v) AS ms FROM s GROUP BY 1, 2) SELECT model_id, stage, {r('ms')} AS ms, {r('ms / sum(ms) OVER (PARTITION BY model_id)')} AS share FROM g""")
def t04(spark, sf):
    return _round(T.stage_breakdown(request_log(spark, sf)))


@query("t05_overhead", f"""WITH {REQUEST_SQL}, g AS (SELECT backend, avg(total_ms) FILTER (success) AS t, avg(audio_ms + inference_ms + composite_ms) FILTER (success) AS p,
  avg(bytes) FILTER (success) AS b, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM req GROUP BY 1)
SELECT backend, {r('t')} AS avg_total, {r('p')} AS avg_processing, {r('b')} AS avg_bytes, succeeded, failed, {r('t - p')} AS overhead_ms, {r('(t - p) / t * 100')} AS overhead_pct FROM g""")
def t05(spark, sf):
    return _round(T.overhead(request_log(spark, sf), "backend", F.col("audio_ms") + F.col("inference_ms") + F.col("composite_ms")))


@query("t06_speedup", f"""WITH {REQUEST_SQL}, g AS (SELECT backend, model_id, gpu_id + 1 AS workers, avg(total_ms) AS mean_ms FROM req GROUP BY ALL),
b AS (SELECT backend, min(mean_ms) AS base_ms FROM g WHERE model_id = 'view' GROUP BY 1)
SELECT backend, model_id, workers, {r('mean_ms')} AS mean_ms, {r('base_ms')} AS base_ms, {r('base_ms / mean_ms')} AS speedup, {r('base_ms / mean_ms / workers * 100')} AS efficiency_pct FROM g LEFT JOIN b USING (backend)""")
def t06(spark, sf):
    runs = request_log(spark, sf).withColumn("workers", F.col("gpu_id") + 1)
    return _round(T.speedup(runs, "backend", "model_id", "workers", "total_ms", "view"))


@query("t07_gpu_usage", f"""WITH {REQUEST_SQL} SELECT g::INT AS gpu_id, count(DISTINCT model_id) AS models, coalesce(sum(bytes), 0)::BIGINT AS used_bytes, 25769803776::BIGINT AS total_bytes
FROM range(5) t(g) LEFT JOIN req ON gpu_id = g GROUP BY 1""")
def t07(spark, sf):
    return T.gpu_usage(request_log(spark, sf), 5)


_BACKENDS = "bk AS (SELECT backend, count(*) AS requests, count(*) FILTER (NOT success) AS errors, arg_max(success, (ts, request_id)) AS healthy FROM req GROUP BY 1)"


@query("t08_health_summary", f"""WITH {REQUEST_SQL}, {_BACKENDS} SELECT bool_or(healthy) AS healthy, count(*) FILTER (healthy) AS healthy_backends, count(*) AS backends,
  sum(requests)::BIGINT AS requests, sum(errors)::BIGINT AS errors FROM bk""")
def t08(spark, sf):
    return T.health_summary(T.backend_health(request_log(spark, sf)))


@query("t09_backend_error_rate", f"WITH {REQUEST_SQL}, {_BACKENDS} SELECT *, {r('errors / requests::DOUBLE')} AS error_rate FROM bk")
def t09(spark, sf):
    return _round(T.backend_health(request_log(spark, sf)))


@query("t10_cache_hit_ratio", f"""WITH {REQUEST_SQL} SELECT coalesce(model_id, 'all') AS model_id, count(*) FILTER (k % 3 > 0) AS hits, count(*) FILTER (k % 3 = 0) AS misses,
  grouping(model_id) = 1 AS overall, {r('avg((k % 3 > 0)::INT)')} AS ratio FROM req GROUP BY ROLLUP (model_id)""")
def t10(spark, sf):
    ev = request_log(spark, sf).select("model_id", (F.col("k") % 3 > 0).alias("hit"))
    return _round(T.cache_hit_ratio(ev)).withColumn("model_id", F.coalesce("model_id", F.lit("all")))


_USERS = "u AS (SELECT user_id AS model_id, count(*) AS requests, max(ts) AS last_used FROM events GROUP BY 1)"


def _user_stats(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("model_id")).agg(
        F.count("*").alias("requests"), F.max(F.col("ts").cast("timestamp")).alias("last_used"))


@query("t11_eviction_lfu", f"""WITH {_USERS}, k AS (SELECT *, row_number() OVER (ORDER BY requests, model_id) AS evict_rank FROM u)
SELECT model_id, requests, evict_rank FROM k WHERE evict_rank <= (SELECT count(*) FROM u) - 100""")
def t11(spark, sf):
    return T.eviction_candidates(_user_stats(spark, sf), 100, "lfu")


@query("t11_eviction_lru", f"""WITH {_USERS}, k AS (SELECT *, row_number() OVER (ORDER BY last_used, model_id) AS evict_rank FROM u)
SELECT model_id, epoch_us(last_used) AS last_used, evict_rank FROM k WHERE evict_rank <= (SELECT count(*) FROM u) - 100""")
def t11b(spark, sf):
    return T.eviction_candidates(_user_stats(spark, sf), 100, "lru").withColumn(
        "last_used", F.unix_micros("last_used"))


@query("t12_sample_requests", "SELECT event_id AS request_id, value AS total_ms FROM events WHERE event_id % 10 = 0")
def t12(spark, sf):
    return T.sample_requests(request_log(spark, sf), 10).select("request_id", "total_ms")


@query("t13_cold_start_flag", f"WITH {REQUEST_SQL} SELECT model_id, count(*) FILTER (model_load_ms > 100) AS cold, count(*) FILTER (model_load_ms <= 100) AS warm FROM req GROUP BY 1")
def t13(spark, sf):
    return T.cold_start_flag(request_log(spark, sf)).groupBy("model_id").agg(
        F.count_if("cold_start").alias("cold"), F.count_if(~F.col("cold_start")).alias("warm"))


@query("t14_queue_metrics", f"""WITH {REQUEST_SQL} SELECT gpu_id, count(*) AS jobs, {r('avg(audio_ms * 2)')} AS avg_queue_ms, {r('max(audio_ms * 2)')} AS max_queue_ms, {r('avg(total_ms - inference_ms)')} AS avg_wait_ms,
  {r('avg(inference_ms)')} AS avg_inference_ms FROM req GROUP BY 1""")
def t14(spark, sf):
    log = request_log(spark, sf).withColumns({"queue_ms": F.col("audio_ms") * 2, "wait_ms": F.col("total_ms") - F.col("inference_ms")})
    return _round(T.queue_metrics(log))


@query("t15_memory_delta", """WITH o AS (SELECT event_id // 2 AS operation, event_id % 2 AS ph, (value * 1000)::BIGINT AS bytes FROM events)
SELECT operation, max(bytes) FILTER (ph = 0) AS "before", max(bytes) FILTER (ph = 1) AS "after", max(bytes) FILTER (ph = 1) - max(bytes) FILTER (ph = 0) AS delta FROM o GROUP BY 1""")
def t15(spark, sf):
    probes = table(spark, sf, "events").select(
        div(F.col("event_id"), 2).alias("operation"), F.when(F.col("event_id") % 2 == 0, "before").otherwise("after").alias("phase"),
        F.round(F.col("value") * 1000).cast("long").alias("bytes"))
    return T.memory_delta(probes, ["operation"])


@query("t16_extraction_report", f"""WITH f AS (SELECT l_suppkey AS model_id, count(*) AS n, sum(l_extendedprice::BIGINT * 40) AS b FROM lineitem GROUP BY 1)
SELECT s_suppkey AS model_id, n AS num_frames, {r('b / 1048576.0::DOUBLE', 2)} AS size_mb, {r('b / 1024.0::DOUBLE / n', 1)} AS avg_frame_kb,
  {r('CASE WHEN s_nationkey % 4 = 0 THEN 0 ELSE n / (s_nationkey + 3.0::DOUBLE) END', 1)} AS frames_per_sec, s_nationkey % 4 = 0 AS cached, s_acctbal * 100000 > 500 * 1048576 AS rejected
FROM supplier JOIN f ON model_id = s_suppkey""")
def t16(spark, sf):
    frames = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("model_id"), (F.round(F.col("l_extendedprice")).cast("long") * 40).alias("bytes"))
    videos = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("model_id"), (F.col("s_acctbal") * 100000).alias("video_bytes"),
        (F.col("s_nationkey") + 3.0).alias("elapsed_s"), (F.col("s_nationkey") % 4 == 0).alias("cached"))
    return T.extraction_report(frames, videos).withColumn("rejected", F.col("error").isNotNull()).drop("error")


@query("t17_cache_size_report", """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'audio' ELSE 'frame' END AS kind, 'm' || (o_custkey % 9) AS model_id, count(*) AS items FROM orders GROUP BY 1, 2""")
def t17(spark, sf):
    kind = F.when(F.col("o_orderkey") % 5 == 0, "audio").otherwise("frame")
    keys = table(spark, sf, "orders").select(F.concat(kind, F.lit(":m"), (F.col("o_custkey") % 9).cast("string"), F.lit(":"), F.col("o_orderkey").cast("string")).alias("key"))
    return T.cache_size_report(keys)


@query("t18_protocol_mix", f"""WITH {REQUEST_SQL} SELECT backend, count(*) AS total, count(*) FILTER (k % 4 > 0) AS "binary", count(*) FILTER (k % 4 = 0) AS json,
  {r('avg((k % 4 > 0)::INT) * 100')} AS binary_pct, {r('avg(total_ms)')} AS avg_ms FROM req GROUP BY 1""")
def t18(spark, sf):
    return _round(T.protocol_mix(request_log(spark, sf).withColumn("is_binary", F.col("k") % 4 > 0), ["backend"]))
