"""Hot keys: the split forms must equal plain windows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framewright.operators.segments import OrderedParts, halo_segments, salted_attach, spread_join


def _skewed(spark, n=4000, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 50, n)),
                        "o": rng.integers(0, 400, n), "u": np.arange(n), "v": rng.integers(-50, 50, n)})
    return pdf, spark.createDataFrame(pdf)


def test_ordered_parts_match_plain_windows(spark):
    pdf, df = _skewed(spark)
    parts = OrderedParts(df, ["k"], ["o", "u"], parts=13)
    assert parts.rows.filter("k = 0").select("_part").distinct().count() > 4
    pdf = pdf.sort_values(["k", "o", "u"])
    g = pdf.groupby("k")
    want = {
        "rn": g.cumcount() + 1, "prev": g["v"].shift(), "sum": g["v"].cumsum(), "min": g["v"].cummin(),
    }
    for name, got in {
        "rn": parts.row_number("x"), "prev": parts.lag("v", "x"),
        "sum": parts.running("v", "x", "sum"), "min": parts.running("v", "x", "min"),
    }.items():
        out = got.select("u", "x").toPandas().set_index("u")["x"].astype("float64").sort_index()
        exp = pd.Series(want[name].values, index=pdf["u"].values).astype("float64").sort_index()
        pd.testing.assert_series_equal(out, exp, check_names=False)


def test_running_last_skips_nulls(spark):
    rows = [(0, i, float(i) if i % 7 == 0 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, o int, v double")
    got = OrderedParts(df, ["k"], ["o"], parts=9).running("v", "x", "last").select("o", "x").collect()
    assert {r.o: r.x for r in got} == {i: float(i // 7 * 7) for i in range(100)}


def test_no_group_exceeds_span_and_halo(spark):
    df = spark.range(5000).select(F.lit(1).alias("clip_id"), F.col("id").alias("frame_idx"))
    segs = halo_segments(df, F.col("frame_idx"), 64, 5, 7)
    sizes = segs.select(F.size("rows").alias("n"), "seg", F.col("rows")[0]["i"].alias("lo")).collect()
    assert max(r.n for r in sizes) == 64 + 5 + 7
    assert all(r.lo == max(0, r.seg * 64 - 5) for r in sizes)


def test_spread_and_salted_joins_keep_every_row(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("clip_id"), F.floor(F.col("id") / 3).alias("block_idx"))
    per = rows.groupBy("clip_id").agg(F.max("block_idx").alias("last"), F.count("*").alias("n"))
    out = spread_join(rows, per, "last", width=64)
    assert out.count() == 3000 and out.filter("n = 1000").count() == 3000
    got = salted_attach(rows, per.drop("last"), ["clip_id"], ["block_idx"])
    assert got.count() == 3000 and got.filter("n = 1000").count() == 3000


def test_null_keys_are_keys(spark):
    rows = [(k, i, i % 7) for k in (None, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i long, v long")
    parts = OrderedParts(df, ["k"], ["i"], parts=5)
    for k in (None, 1):
        own = lambda d: {r.i: r[2] for r in d.select("k", "i", "x").collect() if r.k == k}  # noqa: B023, E731
        assert own(parts.row_number("x")) == {i: i + 1 for i in range(200)}
        assert own(parts.lag("v", "x")) == {i: (i - 1) % 7 if i else None for i in range(200)}
        assert own(parts.running("v", "x")) == {i: sum(j % 7 for j in range(i + 1)) for i in range(200)}


def test_building_a_plan_starts_no_job(spark, tmp):
    """Neither a write nor a scan before an action, at any operator on ordered parts."""
    from framewright.operators import frames, scoring, telemetry
    from framewright.streaming import chunks

    df = spark.createDataFrame([(1, 1, 2.0, 3)], "stream_id int, chunk_idx long, value double, event_id long").withColumn("ts", F.current_timestamp())
    sc = spark.sparkContext
    sc.setJobGroup("building", "building")
    try:
        plans = [
            chunks.number_chunks(df, ["ts", "event_id"]), chunks.playback_start(df, ["ts", "event_id"]),
            chunks.buffer_status(df, ["ts", "event_id"], "chunk_idx"), chunks.bounded_history(df, 3), chunks.ttl_cache_keys(df, "stream_id", "ts", "event_id", 3),
            chunks.session_activity(df, 1000), chunks.generation_rate(df, "ts", "event_id", "chunk_idx"),
            frames.playback_latest(df, df, "stream_id", "ts", "event_id", "chunk_idx"), frames.epoch_batches(df, "event_id", 3),
            scoring.best_so_far(df, "stream_id", "chunk_idx", "value"), telemetry.latency_summary(df, ["stream_id"], "value"),
            telemetry.eviction_candidates(df.withColumnRenamed("chunk_idx", "requests"), 0, key="event_id")]
        assert sc.statusTracker().getJobIdsForGroup("building") == []
    finally:
        sc.setJobGroup("", "")
    assert [p.count() for p in plans] == [1, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]


def test_parts_are_even_and_cut_one_key(spark):
    from framewright.operators.segments import part_of, range_edges

    df = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 7 % 20_000).alias("o"))
    parts = df.withColumn("e", range_edges(df, ["k", "o"], 16)).withColumn("p", part_of(F.col("e"), F.struct("k", "o"), 16))
    sizes = parts.groupBy("p").agg(F.count("*").alias("n"), F.min("o").alias("lo"), F.max("o").alias("hi")).orderBy("p").collect()
    assert len(sizes) == 16 and max(r.n for r in sizes) < 4 * 20_000 / 16
    assert all(a.hi < b.lo for a, b in zip(sizes, sizes[1:]))
    assert parts.where("p <> size(filter(e, x -> x <= struct(k, o)))").count() == 0
