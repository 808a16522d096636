"""Streams over several triggers equal the batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from framewright.streaming import chunks as R
from framewright.streaming import stateful as S
from framewright.streaming.run import VersionedTable, drain, published

SCHEMA = "stream_id int, chunk_idx long, value double, ts timestamp"


def _rows(spark, missing=(), n=40, late=()):
    rows = [(s, i, float(i + s), 1_000_000 * i) for s in (1, 2) for i in range(n) if (s, i) not in missing]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "stream_id int, chunk_idx long, value double, us long").select(
        "stream_id", "chunk_idx", "value", F.timestamp_micros("us").alias("ts"))


def _stream(spark, df, path, triggers=4):
    df.repartition(triggers).write.parquet(str(path))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_lookahead_in_any_order(spark, tmp):
    df = _rows(spark, missing={(1, 20)})
    got = drain(S.lookahead_context_stream(_stream(spark, df, tmp / "in"), "value", span=16), "t", timeouts=True)
    want = R.lookahead_context(df, "value", span=16)
    key = lambda d: sorted((r.stream_id, r.chunk_idx, tuple(r.context)) for r in d.collect())
    assert key(got) == key(want)
    assert {r.chunk_idx for r in want.filter("stream_id = 2").collect()} == set(range(8, 33))
    assert {r.chunk_idx for r in want.filter("stream_id = 1").collect()} == set(range(8, 13)) | set(range(29, 33)) - {28}


@pytest.mark.parametrize("chunks,ready", [(15, False), (16, True)])
def test_sixteen_chunks_make_a_context(spark, chunks, ready):
    df = spark.range(chunks).select(F.lit(1).alias("stream_id"), F.col("id").alias("chunk_idx"), F.lit(1.0).alias("value"))
    assert (R.lookahead_context(df, "value").count() == 1) == ready


def test_gap_and_playback(spark, tmp):
    df = _rows(spark, missing={(1, 7)})
    stream = _stream(spark, df, tmp / "in")
    filled = drain(S.filled_segments_stream(stream, span=8), "t", timeouts=True)
    assert {tuple(r) for r in S.run_ends(filled, span=8).collect()} == {(1, 6), (2, 39)}
    assert {(r.stream_id, r.run_end, r.gaps) for r in R.gap_detect(df).collect()} == {(1, 6, 1), (2, 39, 0)}
    started = drain(S.playback_start_stream(stream), "t", timeouts=True).collect()
    assert {r.stream_id for r in started} == {1, 2} and len(started) == 2
    assert all((r.start_ts - r.ready_ts).total_seconds() == 0.38 for r in started)


def test_runs_over_many_triggers_equal_the_table(spark, tmp):
    missing = {(1, 16), (1, 30), (2, 15)}
    df = _rows(spark, missing=missing)
    filled = drain(S.filled_segments_stream(_stream(spark, df, tmp / "in", 6), span=4), "t", timeouts=True)
    want = {(r.stream_id, r.run_end) for r in R.gap_detect(df).collect()}
    assert {tuple(r) for r in S.run_ends(filled, span=4).collect()} == want == {(1, 15), (2, 14)}


def test_history_keeps_the_latest(spark, tmp):
    df = _rows(spark)
    changes = drain(S.bounded_history_stream(_stream(spark, df, tmp / "in", 5), "value", 10), "t")
    rows = lambda d: {(r.stream_id, r.chunk_idx, r.value) for r in d.collect()}
    assert rows(S.kept_history(changes)) == rows(R.bounded_history(df, 10)) == {(s, i, float(i + s)) for s in (1, 2) for i in range(30, 40)}
    gone = {(r.stream_id, r.chunk_idx) for r in changes.where("not kept").collect()}
    assert gone and all(i < 30 for _, i in gone)
    assert changes.groupBy("stream_id", "version").count().where("count > 20").count() == 0


def _files(spark, path, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us")).drop("us").coalesce(1).write.mode("append").parquet(str(path))
    kinds = spark.read.parquet(str(path)).schema
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_arrival_numbers_over_several_triggers(spark, tmp):
    rng = random.Random(4)
    parts = [[(rng.choice([1, 1, 1, 2, None]), 1000 * t + k, 100 * t + k) for k in range(40)] for t in range(3)]
    got = R.number_chunks_stream(_files(spark, tmp / "in", parts, "stream_id int, us long, event_id long"), ["ts", "event_id"])
    assert got.columns == ["stream_id", "event_id", "ts", "chunk_idx"]
    table = spark.createDataFrame([x for p in parts for x in p], "stream_id int, us long, event_id long").withColumn("ts", F.timestamp_micros("us"))
    want = R.number_chunks(table, ["ts", "event_id"])
    rows = lambda d: sorted(((r.stream_id, r.event_id, r.chunk_idx) for r in d.collect()), key=str)
    assert rows(got) == rows(want)


def test_expiry_by_event_time(spark, tmp):
    """Rows out of order within the watermark; a key that expires while the stream goes on, and one set again in time."""
    s = 1_000_000
    parts = [[("a", 10 * s, 1), ("b", 12 * s, 2)], [("a", 14 * s, 4), ("a", 13 * s, 3)], [("c", 60 * s, 5)], [("a", 61 * s, 6)], [("c", 300 * s, 7)]]
    src = _files(spark, tmp / "in", parts, "k string, us long, event_id long")
    got = drain(S.ttl_cache_keys_stream(src, "k", "ts", "event_id", 20, "30 seconds"), "t").withColumn("us", F.unix_micros("at")).collect()
    want = [("a", 1, 10, False), ("a", 3, 13, True), ("a", 4, 14, True), ("a", None, 34, False), ("a", 6, 61, False), ("a", None, 81, False),
            ("b", 2, 12, False), ("b", None, 32, False), ("c", 5, 60, False), ("c", None, 80, False)]
    assert sorted(((r.k, r.event_id, r.us // s, r.valid) for r in got), key=str) == sorted(want, key=str)
    table = spark.createDataFrame([x for p in parts for x in p], "k string, us long, event_id long").withColumn("ts", F.timestamp_micros("us"))
    valid = {(r.event_id, r.valid) for r in R.ttl_cache_keys(table, "k", "ts", "event_id", 20).collect()}
    assert {(r.event_id, r.valid) for r in got if r.event_id is not None} == {v for v in valid if v[0] != 7}


def test_published_versions_and_a_repeated_trigger(spark, tmp):
    parts = [[("x", 0, 1.0), ("y", 0, 2.0)], [("x", 0, 3.0)], [("y", 0, 5.0), (None, 0, 7.0)]]
    src = _files(spark, tmp / "in", parts, "event_type string, us long, value double")
    table = published(R.periodic_stats(src, ["event_type"]), ["event_type"], "t", "100 milliseconds")
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    want = sorted([("x", 2, 4.0, 3.0), ("y", 2, 7.0, 5.0), (None, 1, 7.0, 7.0)], key=str)
    assert rows(table.current()) == want
    assert rows(table.current(before=1)) == [("x", 1, 1.0, 1.0), ("y", 1, 2.0, 2.0)]
    again = table.spark.read.parquet(f"{table.path}/_batch=2")
    table.put(spark.createDataFrame(again.collect(), again.schema), 2)
    assert rows(table.current()) == want


def test_full_versions_carry_what_stood_before(spark, tmp):
    rows = lambda n: spark.createDataFrame([(n % 3, float(n))], "k int, v double")
    table = VersionedTable(spark, str(tmp / "t"), ["k"], rows(0).schema, full=4)
    for n in range(10):
        table.put(rows(n), n)
    table.put(rows(8), 8)
    assert {tuple(r) for r in table.current().collect()} == {(0, 9.0), (1, 7.0), (2, 8.0)}
    assert {tuple(r) for r in table.current(before=6).collect()} == {(0, 3.0), (1, 4.0), (2, 5.0)}
    assert table.current(before=0).count() == 0


def test_late_rows_past_the_watermark_are_dropped(spark, tmp):
    def put(rows):
        spark.createDataFrame(rows, "stream_id int, us long, value double").select(
            "stream_id", F.lit(0).cast("long").alias("chunk_idx"), "value", F.timestamp_micros("us").alias("ts")) \
            .coalesce(1).write.mode("append").parquet(str(tmp / "in"))

    put([(1, 0, 1.0), (1, 100_000_000, 1.0)])
    put([(1, 200_000_000, 1.0)])
    put([(1, 1_000, 5.0), (1, 300_000_000, 1.0)])
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp / "in"))
    rows = drain(R.tumbling_stats(src, "10 seconds", watermark="10 seconds"), "t").collect()
    assert {r["sum"] for r in rows} == {1.0}


@pytest.mark.parametrize("fill,status", [(3, "critical"), (4, "low"), (7, "low"), (8, "optimal"), (15, "optimal"), (25, "optimal"), (26, "high")])
def test_fill_levels(spark, fill, status):
    assert spark.range(1).select(R.status_of(F.lit(fill))).first()[0] == status


def test_dedup_within_watermark(spark, tmp):
    df = _rows(spark).withColumn("value", F.lit(1.0))
    out = drain(R.content_dedup(_stream(spark, df, tmp / "in").withColumn("c", F.col("value").cast("string")), "c", [], "ts", "1 hour"), "t")
    assert out.count() == 1


def test_sessions_of_a_stream_equal_those_of_a_table(spark, tmp):
    def rows(d):
        return {tuple(r) for r in d.collect()}

    us = [0, 500_000, 1_499_999, 2_500_000, 2_500_000, 9_000_000]
    df = spark.createDataFrame([(1, i, 1.0, u) for i, u in enumerate(us)], "stream_id int, chunk_idx long, value double, us long").select(
        "stream_id", "chunk_idx", "value", F.timestamp_micros("us").alias("ts"))
    table = rows(R.session_activity(df, 1000))
    assert sorted(r[3] for r in table) == [1, 2, 3]
    out = drain(R.session_activity(_stream(spark, df, tmp / "in", 1), 1000), "t", "complete").drop("_batch")
    assert rows(out) == table


def test_repeated_chunk_and_lost_first(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(20)] + [(1, 5, 99.0)] + [(2, i, 0.0) for i in range(3, 9)], "stream_id int, chunk_idx long, value double")
    got = R.lookahead_context(df, "value").collect()
    assert {(r.stream_id, r.chunk_idx) for r in got} == {(1, i) for i in range(8, 13)}
    assert all(99.0 not in r.context for r in got)
    assert {(r.stream_id, r.run_start, r.run_end) for r in R.gap_detect(df).collect()} == {(1, 0, 19), (2, 0, -1)}


def test_late_rows_are_counted(spark, tmp):
    """A window that the watermark has passed takes no more rows; the progress reports say how many were dropped."""
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    for part in ([(1, at(0)), (1, at(30))], [(1, at(31))], [(1, at(1)), (1, at(32))]):
        spark.createDataFrame([(s, t, 1.0) for s, t in part], "stream_id int, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp / "in"))
    src = spark.readStream.schema("stream_id int, ts timestamp, value double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp / "in"))
    q = R.tumbling_stats(src, "1 minute", watermark="5 minutes").writeStream.format("noop").option("checkpointLocation", str(tmp / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    assert dropped == 1
