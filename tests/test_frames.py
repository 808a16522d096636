import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import columns as C
from framewright.operators import compare as Q
from framewright.operators import frames as J
from framewright.operators import geometry as G
from framewright.operators import raster as R
from framewright.operators import scoring as M


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_pingpong_matches_the_walk(spark, n):
    want, idx, step = [], 0, 0
    for _ in range(40):
        if idx > n - 2:
            step = -1
        if idx < 1:
            step = 1
        idx += step
        want.append(idx)
    got = [r[0] for r in spark.range(40).orderBy("id").select(
        J.pingpong_index(F.col("id"), F.lit(n).cast("long"))).collect()]
    assert got == (want if n > 1 else [0] * 40)


def test_latest_checkpoint_ignores_names(spark):
    df = spark.createDataFrame([("m", "a/9.pth"), ("m", "a/10.pth"), ("m", "a/best.pth")], "model_id string, path string")
    assert J.latest_checkpoint(df).first().path == "a/10.pth"


def test_epoch_batches_cover_everything_once(spark):
    out = J.epoch_batches(spark.range(130).withColumnRenamed("id", "row"), "row", 32, seed=5).collect()
    assert sorted(r.row for r in out) == list(range(130))
    sizes = {b: sum(r.batch_id == b for r in out) for b in range(5)}
    assert sizes == {0: 32, 1: 32, 2: 32, 3: 32, 4: 2}
    again = J.epoch_batches(spark.range(130).repartition(7).withColumnRenamed("id", "row"), "row", 32, seed=5).collect()
    assert {(r.row, r.batch_id, r.batch_pos) for r in out} == {(r.row, r.batch_id, r.batch_pos) for r in again}


def test_nms_equals_plain_greedy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for img in range(6):
        # The last picture has more boxes than one stretch of the sweep.
        for b in range(60 if img < 5 else 700):
            x, y, w, h = rng.integers(0, 60 if img < 5 else 400, 2).tolist() + rng.integers(8, 40, 2).tolist()
            rows.append((img, img * 1000 + b, float(x), float(y), float(w), float(h), round(float(rng.random()), 2)))
    rows += [(0, 900 + i, 1.0, 1.0, 30.0, 30.0, 0.9) for i in range(50)]

    def iou(a, b):
        iw = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
        ih = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        inter = max(iw, 0) * max(ih, 0)
        return inter / (a[4] * a[5] + b[4] * b[5] - inter)

    want = set()
    for img in range(6):
        kept = []
        for r in sorted((r for r in rows if r[0] == img and r[6] >= 0.3), key=lambda r: (-r[6], r[1])):
            if all(iou(r, k) <= 0.4 for k in kept):
                kept.append(r)
        want |= {(r[0], r[1]) for r in kept}
    df = spark.createDataFrame(rows, "image_id int, box_id long, x double, y double, w double, h double, score double")
    got = {(r.image_id, r.box_id) for r in G.nms(df.repartition(7), 0.3, 0.4).collect()}
    assert got == want


def test_bounds_forms(spark):
    df = spark.createDataFrame([([1.0, 2.0, 5.0, 9.0],), ([1.0, 2.0, 5.0, 9.0, 4.0],), ([1.0, 2.0, 5.0, 9.0, 4.0, 6.0],), ([1.0],)], "b array<double>")
    got = [r.n and (r.n.width, r.n.height) for r in df.select(G.normalize_bounds(F.col("b")).alias("n")).collect()]
    assert got == [(4, 7), (4, 7), (4, 6), None]


def test_resample_corners_and_gradient():
    src = np.array([[[0] * 3, [100] * 3], [[200] * 3, [40] * 3]], dtype=np.int16)
    out = R.resample_array(src, 4, 4)
    assert out[0, 0, 0] == 0 and out[0, 1, 0] == 50 and out[0, 2, 0] == 100 and out[0, 3, 0] == 100
    assert out[1, 0, 0] == 100 and out[3, 3, 0] == 40
    np.testing.assert_array_equal(R.resample_array(src, 2, 2), src)


def test_composite_clips_at_the_border(spark):
    region = spark.createDataFrame([("m", 0, 1, 1, [0.0, 0.5, 1.0]), ("m", 1, 1, 1, [0.0, 0.0, 0.0])],
                                   "model_id string, frame_idx long, h int, w int, planes array<float>")
    rect = spark.createDataFrame([("m", 0, -1, -1, 1, 1)], "model_id string, frame_idx long, x1 int, y1 int, x2 int, y2 int")
    bg = spark.createDataFrame([("m", 0, 2, 2, bytes([7] * 12))], "model_id string, ring_idx long, bg_h int, bg_w int, bg binary")
    out = {r.frame_idx: r for r in R.composite_frames(region, rect, bg).collect()}
    assert list(out[0].rgb) == [255, 127, 0] + [7] * 9 and out[0].error is None
    assert out[1].rgb is None and out[1].error == "no crop rect for frame 1"


def test_pictures_as_bytes(spark):
    """Sizes that differ in one batch, planes of a wrong length, nulls and values out of range."""
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 1, 2, [0.0, 1.0, 0.5, 2.0, -1.0, 0.25]), (2, 1, 1, [nan, inf, -inf]), (3, 2, 2, [0.5]), (4, 1, 1, None)],
                               "frame_idx long, h int, w int, planes array<float>").coalesce(1)
    pics = R.bgr_planes_to_pixels(df)
    got = {r.frame_idx: None if r.rgb is None else list(r.rgb) for r in pics.collect()}
    assert got == {1: [0, 127, 0, 63, 255, 255], 2: [0, 255, 0], 3: None, 4: None}
    small = {r.frame_idx: (r.h, r.w, None if r.rgb is None else list(r.rgb)) for r in R.resample_bilinear(pics, 1, 1).collect()}
    assert small == {1: (1, 1, [0, 127, 0]), 2: (1, 1, [0, 255, 0]), 3: (1, 1, None), 4: (1, 1, None)}
    noise = {r.frame_idx: r.band for r in R.noise_level(pics.where("frame_idx > 2")).collect()}
    assert noise == {3: None, 4: None}


def test_clamp_infinities(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (-0.0,), (300.0,), (12.5,)], "v double")
    assert [r[0] for r in df.select(C.clamp(F.col("v"), 0.0, 255.0)).collect()] == [255.0, 0.0, 0.0, 255.0, 12.5]


def test_scoring_names_failed_rows_and_keeps_order(spark):
    df = spark.range(200, numPartitions=1).select("id", F.array(F.col("id").cast("float")).alias("v"))
    out = M.score_batches(df, "v", lambda: 2.0, lambda m, x: x[:, 0] * m, "id").collect()
    assert [(r.id, r.score) for r in out] == [(i, 2.0 * i) for i in range(200)]

    def fail(m, x):
        raise ValueError("boom")

    with pytest.raises(Exception, match=r"scoring failed in rows 0\.\.63: boom"):
        M.score_batches(df, "v", lambda: 0, fail, "id").collect()


def test_shape_mismatch_never_passes(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [0.0])], "tensor_id long, values array<float>")
    b = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 1.0])], "tensor_id long, values array<float>")
    got = {r.tensor_id: r for r in Q.tolerance_gate(Q.paired(a, b)).collect()}
    assert got[1].passed and got[1].identical
    assert not got[2].shape_ok and not got[2].passed and not got[3].passed
