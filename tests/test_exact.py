"""Quantiles, as-of lookups, silent runs and clustered writes against plain Python."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import frames, signal, telemetry
from framewright.sources.writers import write_tensors


@pytest.mark.parametrize("rule", ["linear", "rank"])
def test_quantiles_inside_brackets(spark, rule):
    rng = np.random.default_rng(1)
    groups = {"big": rng.gamma(2, 50, 30_000), "ties": rng.integers(0, 5, 9_000).astype(float), "one": np.array([7.5]),
              "two": np.array([1.0, 2.0]), None: rng.normal(size=300), "flat": np.full(4_000, 3.25)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("two", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    percents = [0.0, 12.5, 50.0, 95.0, 99.0, 100.0]
    got = {(r.g, r.p): r.value for r in telemetry.exact_quantiles(df, ["g"], "v", percents, rule).collect()}
    want = {}
    for g, vs in groups.items():
        s = np.sort(vs)
        for p in percents:
            want[g, p] = np.quantile(s, p / 100) if rule == "linear" else s[int((len(s) - 1) * (p / 100))]
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_summary_keeps_null_and_empty_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", None)], "g string, total_ms double")
    got = {r.g: (r.n, r.median, r.p99) for r in telemetry.latency_summary(df, ["g"]).collect()}
    assert got == {None: (2, 2.0, 2.98), "x": (1, None, None)}


def test_sketch_errors_are_counted(spark):
    df = spark.createDataFrame([("a", float(i % 977)) for i in range(20_000)], "g string, total_ms double")
    assert [tuple(r) for r in telemetry.sketch_rank_errors(df, ["g"]).collect()] == [("a", True, True, True)]


def test_latest_frame_by_buckets(spark):
    rng = random.Random(3)
    streams = [1, 1, 1, 2, None, 3]
    shown = [(s, rng.randrange(2000), i) for i, s in enumerate(rng.choice(streams[:5]) for _ in range(150))]
    asked = [(s, rng.randrange(2200), i) for i, s in enumerate(rng.choice(streams) for _ in range(300))] + [(1, None, 900)]
    stamp = lambda rows, name: spark.createDataFrame(rows, f"s int, sec long, {name} long").select(
        "s", F.timestamp_seconds("sec").alias("ts"), name).repartition(4)
    got = frames.playback_latest(stamp(asked, "event"), stamp(shown, "frame"), "s", "ts", "event", "frame", bucket_s=60).collect()
    latest = lambda s, t: max(((at, f) for x, at, f in shown if x == s and t is not None and at <= t), default=(None, None))[1]
    assert {r.event: r.frame for r in got} == {e: latest(s, t) for s, t, e in asked}
    assert len(got) == len(asked)


def test_silent_runs(spark):
    loud, quiet = [0.5, 0.0], [0.0, 0.0005]
    levels = {1: "qqlqllqqq", 2: "lll", 3: "q" * 300, 4: "q"}
    rows = [(c, i, 2, loud if x == "l" else quiet) for c, xs in levels.items() for i, x in enumerate(xs) if not (c == 3 and i == 100)]
    got = signal.silent_runs(spark.createDataFrame(rows, "clip_id int, block_idx long, n int, samples array<double>").repartition(5)).collect()
    assert {tuple(r) for r in got} == {(1, 0, 1, 2), (1, 3, 3, 1), (1, 6, 8, 3), (3, 0, 99, 100), (3, 101, 299, 199), (4, 0, 0, 1)}


def test_few_files_per_key(spark, tmp):
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("model_id"), F.floor(F.col("id") / 3).alias("frame_idx"),
                                  F.array(F.col("id").cast("float")).alias("values")).repartition(16)
    write_tensors(df, str(tmp / "t"), rows_per_file=500)
    for key in "012":
        assert len([f for f in os.listdir(tmp / "t" / "frames" / f"model_id={key}") if f.endswith(".parquet")]) <= 2
    assert spark.read.parquet(str(tmp / "t" / "frames")).count() == 3000


def test_silent_runs_over_the_edges_of_stretches(spark):
    """Runs that fill whole stretches, touch an edge, repeat a block or belong to no clip; few stretches are ordered at all."""
    quiet = {1: [*range(0, 13), 15, 16, 19, *range(20, 24), 30], 2: [3, 4, 8], None: [7, 8]}
    rows = [(c, b, 1, [0.0]) for c, bs in quiet.items() for b in bs] + [(1, 13, 1, [0.5]), (1, 4, 1, [0.0])]
    df = spark.createDataFrame(rows, "clip_id int, block_idx long, n int, samples array<double>").repartition(3)
    got = sorted(((r.clip_id or 0, r.first_block, r.last_block, r.blocks) for r in signal.silent_runs(df, span=4).collect()))
    assert got == [(0, 7, 8, 2), (1, 0, 12, 13), (1, 15, 16, 2), (1, 19, 23, 5), (1, 30, 30, 1), (2, 3, 4, 2), (2, 8, 8, 1)]
