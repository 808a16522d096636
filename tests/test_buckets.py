"""Stateful steps share calls and state rows by bucket, and still treat each key alone."""

import pytest
from pyspark.sql import functions as F

from framewright.streaming import stateful as S
from framewright.streaming.run import drain

SCHEMA = "stream_id long, chunk_idx long, value double, ts timestamp"


def _stream(spark, path, *parts):
    for rows in parts:
        df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, "stream_id long, chunk_idx long")
        df.select("stream_id", "chunk_idx", F.col("chunk_idx").cast("double").alias("value"), F.timestamp_millis("chunk_idx").alias("ts")) \
            .coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


STEPS = {
    "lookahead": lambda s: S.lookahead_context_stream(s, "value"),
    "segments": lambda s: S.filled_segments_stream(s),
    "playback": lambda s: S.playback_start_stream(s),
    "history": lambda s: S.bounded_history_stream(s, "value", 2),
    "cache": lambda s: S.ttl_cache_keys_stream(s, "stream_id", "ts", "chunk_idx", 3600, "1 hour"),
}


@pytest.mark.parametrize("name", STEPS)
def test_state_rows_do_not_grow_with_keys(spark, tmp, name):
    src = _stream(spark, tmp / "in", spark.range(6000).select((F.col("id") % 3000).alias("stream_id"), F.floor(F.col("id") / 3000).alias("chunk_idx")))
    flag = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(flag)
    spark.conf.set(flag, "false")
    try:
        q = STEPS[name](src).writeStream.format("noop").option("checkpointLocation", str(tmp / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(flag, before)
    rows = [op.numRowsTotal for p in q.recentProgress for op in p.stateOperators]
    assert rows and 0 < max(rows) <= S.BUCKETS


def test_null_and_large_keys_stay_apart(spark, tmp):
    big = 2 ** 60 + 1
    keys = [None, 0, big, big + 1]
    src = _stream(spark, tmp / "in", [(k, i) for k in keys for i in range(3)], [(k, i) for k in keys[:3] for i in range(3, 6)])
    filled = drain(S.filled_segments_stream(src, span=8), "t", timeouts=True)
    high = {r.stream_id: r.h for r in filled.groupBy("stream_id").agg(F.max("high").alias("h")).collect()}
    assert high == {None: 5, 0: 5, big: 5, big + 1: 2}
    kept = S.kept_history(drain(S.bounded_history_stream(src, "value", 2), "t"))
    assert {(r.stream_id, r.chunk_idx) for r in kept.collect()} == {(k, i) for k in keys[:3] for i in (4, 5)} | {(big + 1, 1), (big + 1, 2)}


def test_idle_keys_are_forgotten(spark, tmp):
    src = _stream(spark, tmp / "in", [(1, i) for i in range(15)] + [(2, i) for i in range(20)], [(1, i) for i in range(15, 20)])
    assert [r.stream_id for r in drain(S.playback_start_stream(src, ttl_s=0), "t", timeouts=True).collect()] == [2]
    assert {r.stream_id for r in drain(S.playback_start_stream(src), "t", timeouts=True).collect()} == {1, 2}
