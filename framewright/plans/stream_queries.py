"""Stream queries (R): events are chunks; `_stream` names run as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.plans.adapters import div, r, rnd, table
from framewright.plans.registry import query
from framewright.session import scratch_path
from framewright.streaming import chunks as R
from framewright.streaming import stateful as S
from framewright.streaming.run import drain, published

# 64 consecutive events form a stream; its numbering skips one index after every 29 chunks, so there are gaps and all events stay.
CHUNK_SQL = """ck AS (SELECT event_id // 64 AS stream_id, event_id % 64 + event_id % 64 // 29 AS chunk_idx, ts, value, event_id FROM events)"""


def _shape(events):
    k = F.col("event_id") % 64
    return events.select(div(F.col("event_id"), 64).alias("stream_id"), (k + div(k, 29)).alias("chunk_idx"), "ts", "value", "event_id")


_PARTS: dict[tuple[str, str], str] = {}


def event_stream(spark, sf, files: int = 4):
    """The events as a stream that comes in order of time, one file a trigger.

    The table is one file, so it is first cut by event number, which follows time, into ``files`` files, which the session keeps.
    """
    key = (spark.sparkContext.applicationId, sf)
    events = table(spark, sf, "events")
    if key not in _PARTS:
        path = scratch_path(spark, "event-files")
        ends = F.percentile_approx("event_id", [i / files for i in range(1, files)])
        cut = [float("-inf"), *events.agg(ends.alias("e")).first().e, float("inf")]
        for low, high in zip(cut, cut[1:]):  # one after another: a file stream goes by the time of writing
            events.where((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(path)
        _PARTS[key] = path
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(_PARTS[key])


def _us(df, *cols):
    return df.withColumns({c: F.unix_micros(c) for c in cols})


def _messages(events):
    """JSON-like chunk messages whose payload is the event text as PCM bytes."""
    return events.select(
        F.col("user_id").cast("string").alias("stream_id"), F.lit("audio").alias("type"),
        F.base64(F.col("props").cast("binary")).alias("data"), F.lit(None).cast("string").alias("audio_data"),
        F.unix_millis("ts").alias("timestamp"), F.lit(24000).alias("sampleRate"), F.lit("pcm16").alias("format"))


_R01 = """SELECT user_id::VARCHAR AS stream_id, epoch_us(ts) // 1000 // 40 AS chunk_idx, (strlen(props) // 2)::INT AS n_samples, 24000 AS sample_rate, props AS payload FROM events"""


def _r01_out(df):
    return df.select("stream_id", "chunk_idx", "n_samples", "sample_rate", F.col("pcm").cast("string").alias("payload"))


@query("r01_chunk_stream", _R01)
def r01(spark, sf):
    return _r01_out(R.chunk_stream(_messages(table(spark, sf, "events"))))


@query("r01_chunk_stream_stream", _R01)
def r01s(spark, sf):
    return drain(_r01_out(R.chunk_stream(_messages(event_stream(spark, sf)))), "r01")


@query("r01_number_chunks", """SELECT user_id AS stream_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS chunk_idx FROM events""")
def r01b(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id")
    return R.number_chunks(ev, ["ts", "event_id"]).drop("ts")


@query("r01_number_chunks_stream", """SELECT user_id AS stream_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS chunk_idx FROM events""")
def r01n(spark, sf):
    ev = event_stream(spark, sf).select(F.col("user_id").alias("stream_id"), "ts", "event_id")
    return R.number_chunks_stream(ev, ["ts", "event_id"]).drop("ts")


def _tumble_sql(width_us: int) -> str:
    return f"""SELECT user_id AS stream_id, epoch_us(ts) // {width_us} * {width_us} AS start, count(*) AS n, min(value) AS min, max(value) AS max, {r('sum(value)')} AS sum
FROM events GROUP BY 1, 2"""


def _users(events):
    return events.select(F.col("user_id").alias("stream_id"), "ts", "value", "event_id")


@query("r02_tumbling_stats", _tumble_sql(40_000))
def r02(spark, sf):
    return _us(R.tumbling_stats(_users(table(spark, sf, "events"))), "start").withColumn("sum", rnd(F.col("sum")))


@query("r02_tumbling_stats_hour_stream", _tumble_sql(3_600_000_000))
def r02s(spark, sf):
    """Complete mode, so that the last open windows are part of the answer."""
    out = drain(R.tumbling_stats(_users(event_stream(spark, sf)), "1 hour"), "r02", "complete")
    return _us(_last(out), "start").withColumn("sum", rnd(F.col("sum")))


# In append mode a window is final, and emitted, once the watermark has passed its end.
_CLOSED = "epoch_us(max(ts)) // 1000 * 1000 - 3600 * 1000000::BIGINT"


@query("r02_tumbling_stats_append_stream", f"""WITH w AS (SELECT user_id AS stream_id, epoch_us(ts) // 3600000000 * 3600000000 AS start, count(*) AS n, min(value) AS min, max(value) AS max,
  {r('sum(value)')} AS sum FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + 3600000000 <= (SELECT {_CLOSED} FROM events)""")
def r02a(spark, sf):
    out = drain(R.tumbling_stats(_users(event_stream(spark, sf)), "1 hour", watermark="1 hour"), "r02")
    return _us(out, "start").withColumn("sum", rnd(F.col("sum")))


def _last(out):
    newest = out.agg(F.max("_batch").alias("_batch"))
    return out.join(F.broadcast(newest), "_batch").drop("_batch")


_R03 = f"""WITH {CHUNK_SQL}, c AS (SELECT a.stream_id, a.chunk_idx, count(*) AS n, sum((o + 9) * b.value) AS chk FROM ck a, range(-8, 8) t(o)
  JOIN ck b ON b.stream_id = a.stream_id AND b.chunk_idx = a.chunk_idx + o GROUP BY 1, 2) SELECT stream_id, chunk_idx, {r('chk')} AS chk FROM c WHERE n = 16"""


def _r03_out(df):
    weighed = F.transform("context", lambda v, j: v * (j + 1))
    return df.select("stream_id", "chunk_idx", rnd(F.aggregate(weighed, F.lit(0.0), lambda a, b: a + b)).alias("chk"))


@query("r03_lookahead_context", _R03)
def r03(spark, sf):
    return _r03_out(R.lookahead_context(_shape(table(spark, sf, "events")), "value"))


@query("r03_lookahead_context_stream", _R03)
def r03s(spark, sf):
    return _r03_out(drain(S.lookahead_context_stream(_shape(event_stream(spark, sf)), "value"), "r03", timeouts=True))


_R05_RUNS = f"""WITH {CHUNK_SQL}, e AS (SELECT a.stream_id, a.chunk_idx FROM ck a LEFT JOIN ck b ON b.stream_id = a.stream_id AND b.chunk_idx = a.chunk_idx + 1 WHERE b.chunk_idx IS NULL),
s AS (SELECT stream_id, min(chunk_idx) AS run_start FROM ck GROUP BY 1), g AS (SELECT stream_id, min(chunk_idx) AS run_end, count(*) - 1 AS gaps FROM e GROUP BY 1)"""


@query("r05_gap_detect", f"{_R05_RUNS} SELECT stream_id, run_start, run_end, gaps FROM s JOIN g USING (stream_id)")
def r05(spark, sf):
    return R.gap_detect(_shape(table(spark, sf, "events")))


@query("r05_gap_detect_stream", f"{_R05_RUNS} SELECT stream_id, run_end FROM s JOIN g USING (stream_id)")
def r05s(spark, sf):
    return S.run_ends(drain(S.filled_segments_stream(_shape(event_stream(spark, sf)), span=16), "r05", timeouts=True), span=16)


_R06 = """WITH k AS (SELECT user_id AS stream_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT stream_id, epoch_us(ts) AS ready_ts, epoch_us(ts) + 380000 AS start_ts FROM k WHERE rn = 20"""


@query("r06_playback_start", _R06)
def r06(spark, sf):
    return _us(R.playback_start(_users(table(spark, sf, "events")), ["ts", "event_id"]), "ready_ts", "start_ts")


@query("r06_playback_start_stream", _R06)
def r06s(spark, sf):
    return _us(drain(S.playback_start_stream(_users(event_stream(spark, sf))), "r06", timeouts=True), "ready_ts", "start_ts")


_DELTA = "CASE WHEN event_type IN ('view', 'error') THEN -1 ELSE 1 END"
_STATUS = "CASE WHEN fill <= 3 THEN 'critical' WHEN fill < 8 THEN 'low' WHEN fill > 25 THEN 'high' ELSE 'optimal' END"


@query("r07_buffer_status", f"""WITH k AS (SELECT user_id AS stream_id, event_id, {_DELTA} AS delta, sum({_DELTA}) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS fill FROM events)
SELECT stream_id, event_id, fill, {_STATUS} AS status, {r('fill / 15.0::DOUBLE * 100')} AS percent FROM k""")
def r07(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id", F.expr(_DELTA).alias("delta"))
    return R.buffer_status(ev, ["ts", "event_id"], "delta").select(
        "stream_id", "event_id", "fill", "status", rnd(F.col("percent")).alias("percent"))


@query("r07_buffer_status_stream", f"""WITH k AS (SELECT user_id AS stream_id, sum({_DELTA})::BIGINT AS fill FROM events GROUP BY 1)
SELECT stream_id, fill, {_STATUS} AS status, {r('fill / 15.0::DOUBLE * 100')} AS percent FROM k""")
def r07s(spark, sf):
    """Published by trigger, a version of the changed streams each; read as the table stands at the end."""
    ev = event_stream(spark, sf).select(F.col("user_id").alias("stream_id"), F.expr(_DELTA).alias("delta"))
    return published(S.buffer_status_stream(ev), ["stream_id"], "r07").current().withColumn("percent", rnd(F.col("percent")))


@query("r08_bounded_history", """SELECT user_id AS stream_id, event_id AS chunk_idx, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30""")
def r08(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("chunk_idx"), "value")
    return R.bounded_history(ev, 30)


@query("r08_bounded_history_stream", """SELECT user_id AS stream_id, event_id AS chunk_idx, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30""")
def r08s(spark, sf):
    ev = event_stream(spark, sf).select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("chunk_idx"), "value")
    return S.kept_history(drain(S.bounded_history_stream(ev, "value", 30), "r08"))


@query("r09_ttl_cache_keys", """WITH k AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, event_id, coalesce(epoch_us(ts) - epoch_us(p) <= 3600 * 1000000::BIGINT, false) AS valid FROM k""")
def r09(spark, sf):
    return R.ttl_cache_keys(table(spark, sf, "events"), "user_id", "ts", "event_id", 3600).select("user_id", "event_id", "valid")


# Rows and expiries are final, and emitted, once the watermark has passed them.
@query("r09_ttl_cache_keys_stream", """WITH lim AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600 * 1000000::BIGINT AS w FROM events),
k AS (SELECT user_id, event_id, epoch_us(ts) AS "at", lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p,
  lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
SELECT user_id, event_id, "at", coalesce("at" - p <= 3600 * 1000000::BIGINT, false) AS valid FROM k, lim WHERE "at" < w
UNION ALL SELECT user_id, NULL, "at" + 3600 * 1000000::BIGINT, false FROM k, lim WHERE "at" < w AND "at" + 3600 * 1000000::BIGINT < w
  AND (nx IS NULL OR nx > "at" + 3600 * 1000000::BIGINT)""")
def r09s(spark, sf):
    return _us(drain(S.ttl_cache_keys_stream(event_stream(spark, sf), "user_id", "ts", "event_id", 3600, "1 hour"), "r09"), "at")


@query("r10_content_dedup", "SELECT md5(text) AS content_md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def r10(spark, sf):
    return R.content_dedup(table(spark, sf, "documents"), "text", ["doc_id"])


@query("r10_content_dedup_stream", "SELECT DISTINCT md5(props) AS content_md5 FROM events")
def r10s(spark, sf):
    """The watermark spans the whole month of events."""
    return drain(R.content_dedup(event_stream(spark, sf), "props", [], "ts", "40 days"), "r10")


@query("r11_session_activity", """WITH k AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR, true)::INT AS s FROM events),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS sess FROM k)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 2 HOUR) AS "end", count(*) AS n FROM n GROUP BY user_id, sess""")
def r11(spark, sf):
    return _us(R.session_activity(table(spark, sf, "events"), 7_200_000, by="user_id"), "start", "end")


@query("r11_session_activity_stream", f"""WITH k AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR, true)::INT AS s FROM events),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS sess FROM k),
w AS (SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 2 HOUR) AS "end", count(*) AS n FROM n GROUP BY user_id, sess)
SELECT * FROM w WHERE "end" <= (SELECT {_CLOSED} FROM events)""")
def r11s(spark, sf):
    return _us(drain(R.session_activity(event_stream(spark, sf), 7_200_000, by="user_id", watermark="1 hour"), "r11"), "start", "end")


@query("r12_fps_counter_stream", f"""WITH w AS (SELECT event_type, epoch_us(ts) // 1000000 * 1000000 AS start, count(*) AS frames FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE start + 1000000 <= (SELECT {_CLOSED} FROM events)""")
def r12s(spark, sf):
    return _us(drain(R.fps_counter(event_stream(spark, sf), by="event_type", watermark="1 hour"), "r12"), "start")


@query("r12_fps_counter", "SELECT event_type, epoch_us(ts) // 1000000 * 1000000 AS start, count(*) AS frames FROM events GROUP BY 1, 2")
def r12(spark, sf):
    return _us(R.fps_counter(table(spark, sf, "events"), by="event_type"), "start")


@query("r12_generation_rate", f"""WITH k AS (SELECT user_id AS stream_id, event_id, (props->>'$.k')::INT AS n, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6::DOUBLE AS s FROM events)
SELECT stream_id, event_id, n, {r('CASE WHEN s > 0 THEN n / s END', 9)} AS fps FROM k""")
def r12b(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id",
                                           F.get_json_object("props", "$.k").cast("int").alias("n"))
    return R.generation_rate(ev, "ts", "event_id", "n").select(
        "stream_id", "event_id", "n", rnd(F.col("fps"), 9).alias("fps"))


_R13 = f"SELECT event_type, count(*) AS n, {r('sum(value)')} AS total, max(value) AS peak FROM events GROUP BY 1"


@query("r13_periodic_stats_stream", _R13)
def r13(spark, sf):
    """Published on a clock; read as the table stands at the end."""
    return published(R.periodic_stats(event_stream(spark, sf), ["event_type"]), ["event_type"], "r13").current().withColumn("total", rnd(F.col("total")))
