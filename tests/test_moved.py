"""What operators move between tasks: payload once, not once per row that wants it."""

import numpy as np
from pyspark.sql import functions as F

from framewright.operators import signal as S
from framewright.schemas import SIGNAL_BLOCKS


def moved(spark, df) -> float:
    """Megabytes that all stages of a run write to shuffles."""
    def total():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(
            None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def _noise(spark, clips, n, hop=200):
    x = np.random.default_rng(1).uniform(-1, 1, n).astype(np.float32)
    rows = [(c, b // hop, len(x[b:b + hop]), x[b:b + hop].tolist()) for c in range(clips) for b in range(0, n, hop)]
    return x, spark.createDataFrame(rows, SIGNAL_BLOCKS)


def test_slices_move_requests_not_samples(spark):
    """Clips of 0.4 MB in all, 500 requests for 17 MB of samples."""
    _, blocks = _noise(spark, 5, 20_000)
    req = spark.range(500).select(F.col("id").alias("request_id"), (F.col("id") % 5).alias("clip_id"), F.lit(8).alias("start_frame"), F.lit(1).alias("batch"))
    assert moved(spark, S.slice_for_batch(blocks, req)) < 2


def test_long_slices_are_put_together_over_stripes(spark):
    x, blocks = _noise(spark, 1, 30_000)
    req = spark.createDataFrame([(b, 0, s, b) for b, s in [(1, 0), (2, 9), (5, 20), (30, 10), (31, 8)]], "request_id int, clip_id long, start_frame int, batch int")
    for span, reach in [(8, 8), (64, 60), (64, 64), (256, 64)]:
        for r in S.slice_for_batch(blocks, req, span=span, reach=reach).collect():
            start = max(0, {1: 0, 2: 9, 5: 20, 30: 10, 31: 8}[r.request_id] - 8) * 640
            np.testing.assert_array_equal(np.float32(r.samples), x[start:start + (r.request_id + 15) * 640])


def test_boxes_go_to_points_dealt_by_frame(spark):
    """1.6 million points of 15 000 frames stay where they are; only orders and boxes move."""
    from framewright.plans import registry

    assert moved(spark, registry.all_queries()["g06_denormalize_landmarks"](spark, "/root/testdata/sf0.01")) < 3


def test_samples_move_as_plain_numbers(spark):
    """3 million samples of few values, in order."""
    samples = spark.range(3_000_000).select((F.col("id") % 50).alias("clip_id"), F.floor(F.col("id") / 50).alias("sample_idx"), (F.col("id") % 7 / 8).alias("value"))
    assert moved(spark, S.to_blocks(samples)) < 18


def test_blocks_of_samples_with_gaps_copies_and_nulls(spark):
    rows = [("a", 3, 0.5), ("a", 1, None), ("a", 0, 0.25), ("a", 3, 0.125), ("a", 3, None), ("a", 5, 1.0), (None, 4, 2.0), ("b", None, 3.0), ("b", None, None)]
    got = S.to_blocks(spark.createDataFrame(rows, "clip_id string, sample_idx long, value double").repartition(4), 4).collect()
    assert {(r.clip_id, r.block_idx, r.n, tuple(r.samples)) for r in got} == {
        ("a", 0, 5, (0.25, None, None, 0.125, 0.5)), ("a", 1, 1, (1.0,)), (None, 1, 1, (2.0,)), ("b", None, 2, (None, 3.0))}


def test_totals_of_lists(spark):
    from framewright.plans.adapters import total_flat

    df = spark.createDataFrame([(1, [1.0, 2.5]), (2, []), (3, None), (4, [4.0])], "k int, v array<double>").coalesce(1)
    assert {r.k: r.t for r in df.select("k", total_flat("v").alias("t")).collect()} == {1: 3.5, 2: 0.0, 3: None, 4: 4.0}
