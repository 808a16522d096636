"""Pixel rows and pictures: odd rows, and plans that do not depend on guessed sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import raster as R
from framewright.plans import registry

SF = "/root/testdata/sf0.001"


def grid(spark, h, w, drop=(), frame=1):
    rows = [(frame, h, w, y, x, 10 * y + x, None if (y, x) == (1, 1) else 3 * x, 7) for y in range(h) for x in range(w) if (y, x) not in drop]
    return spark.createDataFrame(rows, "frame_idx long, h int, w int, y int, x int, b short, g short, r short")


@pytest.mark.parametrize("name", ["g12_resample_bilinear_long", "g14_composite_frames", "g15_label_guard", "g18_resample_nearest"])
def test_pictures_are_not_broadcast(spark, name):
    plan = registry.all_queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    wide = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert len(wide) <= (1 if name == "g14_composite_frames" else 0)  # ring sizes are numbers


def test_bilinear_of_missing_null_and_repeated_pixels(spark):
    px = grid(spark, 4, 4, drop=[(0, 0), (3, 3)])
    px = px.unionByName(px.where("y = 2 and x = 2").withColumn("b", F.lit(90).cast("short"))).unionByName(px.withColumn("frame_idx", F.lit(None).cast("long")))
    got = {(r.y, r.x): (r.b, r.g, r.r) for r in R.resample_bilinear_long(px.orderBy("x"), 4, 4).collect()}
    # Same size: each target has its own pixel and the three after it as neighbours.
    assert set(got) == {(y, x) for y in range(4) for x in range(4)} - {(3, 3)}
    assert got[0, 0] == (None, None, None) and got[1, 2] == (12, 6, 7) and got[1, 1][1] is None and got[1, 0][1] is None
    assert got[2, 2] == (None, None, None) and got[2, 1] == (21, 3, 7) and got[3, 1] == (31, 3, 7)


def test_nearest_is_the_truncated_quotient(spark):
    for (h, w), (th, tw) in [((16, 16), (9, 21)), ((7, 3), (49, 3)), ((1, 5), (4, 1))]:
        got = sorted((r.y, r.x, r.b) for r in R.resample_nearest(grid(spark, h, w), tw, th).collect())
        assert got == [(y, x, 10 * int(y * (h / th)) + int(x * (w / tw))) for y in range(th) for x in range(tw)]


def test_guard_meets_by_pixel_in_any_order(spark):
    px = grid(spark, 5, 6)
    pred = px.select("frame_idx", "y", "x", *[(F.lit(200) - F.coalesce(c, F.lit(0))).cast("short").alias(c) for c in "bgr"])
    lab = px.select("frame_idx", "y", "x", F.lit(0).alias("b"), F.lit(0).alias("g"), F.when(F.col("x") % 2 == 0, 255).otherwise(1).alias("r")).where("y <> 3")
    want = {(r.y, r.x): ((10 * r.y + r.x, None if (r.y, r.x) == (1, 1) else 3 * r.x, 7) if r.x % 2 == 0 else (200 - 10 * r.y - r.x, 200 - (0 if (r.y, r.x) == (1, 1) else 3 * r.x), 193))
            for r in px.collect() if r.y != 3}
    for order in ("y", "x"):
        out = R.label_guard(pred.orderBy(order), px, lab.orderBy("x")).collect()
        assert len(out) == len(want) and {(r.y, r.x): (r.b, r.g, r.r) for r in out} == want


def test_long_planes_with_odd_values(spark):
    rows = [(1, 1, 2, [0.5, float("nan"), -1.0, 2.0, None, 1.0]), (2, 1, 2, [0.5]), (3, 1, 1, None), (4, None, 2, [0.5] * 6)]
    got = sorted(tuple(r) for r in R.planes_to_long(spark.createDataFrame(rows, "frame_idx long, h int, w int, planes array<float>")).fillna(-9).collect())
    assert got == [(1, 1, 2, 0, 0, 127, 0, -9), (1, 1, 2, 0, 1, 255, 255, 255), (2, 1, 2, 0, 0, 127, -9, -9), (2, 1, 2, 0, 1, -9, -9, -9), (3, 1, 1, 0, 0, -9, -9, -9)]


def test_six_channels_and_masked_planes(spark):
    frames = spark.createDataFrame([(1, 2, 2, [i / 255 for i in range(12)]), (2, 1, 1, [1.0, 0.5, 0.0])], "frame_idx long, h int, w int, planes array<double>")
    ref = R.plane_bytes(frames)
    masked = R.mask_planes(ref, 1, 0, 1, 2)
    got = {r.frame_idx: np.array(r.channels) * 255 for r in R.six_channel_input(ref, masked).collect()}
    whole = [int(i / 255 * 255.0) for i in range(12)]
    assert np.allclose(got[1], whole + [0 if i % 2 else v for i, v in enumerate(whole)]) and np.allclose(got[2], [255, 127, 0, 255, 127, 0])
