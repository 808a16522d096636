import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import signal as S
from framewright.schemas import SIGNAL_BLOCKS


def blocks(spark, clips, hop=200):
    rows = []
    for cid, x in clips.items():
        for b in range(0, len(x), hop):
            part = [float(v) for v in x[b:b + hop]]
            rows.append((cid, b // hop, len(part), part))
    return spark.createDataFrame(rows, SIGNAL_BLOCKS).repartition(5)


def plain_mel(x):
    x = np.asarray(x, dtype=np.float32).astype(np.float64)
    y = np.concatenate([x[:1], x[1:] - 0.97 * x[:-1]])
    p = np.concatenate([np.zeros(400), y, np.zeros(400)])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(800) / 800)
    fr = np.stack([p[i * 200:i * 200 + 800] * w for i in range(1 + len(x) // 200)])
    mel = np.abs(np.fft.rfft(fr, axis=1)) @ S.mel_matrix().T
    return np.clip(8 * (20 * np.log10(np.maximum(1e-5, mel)) - 20 + 100) / 100 - 4, -4, 4)


# The lengths include exact multiples of the hop and of the segment (64 blocks).
@pytest.mark.parametrize("n", [1, 200, 1000, 10240, 12800, 12801, 25600, 51201])
def test_mel_equals_whole_clip_computation(spark, n):
    x = np.random.default_rng(n).uniform(-1, 1, n)
    rows = S.mel_spectrogram(blocks(spark, {7: x}), dtype="double").orderBy("frame_idx").collect()
    assert [r.frame_idx for r in rows] == list(range(1 + n // 200))
    np.testing.assert_allclose(np.array([r.mel for r in rows]), plain_mel(x), atol=1e-9)


def test_640_ms_gives_52_frames(spark):
    b = blocks(spark, {1: np.full(10240, 0.5)})
    assert S.mel_spectrogram(b).count() == 52
    assert S.frame_counts(b).first().centered == 52


@pytest.mark.parametrize("k", [0.97, 0.5, -0.9, 0.0])
def test_inverse_emphasis_over_segments(spark, k):
    x = np.random.default_rng(3).uniform(-1, 1, 30011)
    y, want = 0.0, []
    for v in x.astype(np.float32).astype(np.float64):
        y = v + k * y
        want.append(y)
    out = S.inverse_pre_emphasis(blocks(spark, {1: x}), k).orderBy("block_idx").collect()
    np.testing.assert_allclose(np.concatenate([r.samples for r in out]), want, atol=1e-12)
    assert sum(r.n for r in out) == len(x)


def test_emphasis_identity_and_first_sample(spark):
    b = blocks(spark, {1: [1.0, 2.0, 4.0]}, hop=2)
    got = S.pre_emphasis(b, 0.5).orderBy("block_idx").collect()
    assert [list(r.samples) for r in got] == [[1.0, 1.5], [3.0]]
    assert [list(r.samples) for r in S.pre_emphasis(b, 0.0).orderBy("block_idx").collect()] == [[1.0, 2.0], [4.0]]


def test_filter_forms_agree(spark):
    dense = S.mel_matrix()
    rows = S.mel_filterbank(spark).collect()
    got = np.zeros_like(dense)
    for r in rows:
        got[r.mel, r.bin] = r.w
    np.testing.assert_allclose(got, dense, atol=1e-12)
    assert dense.shape == (80, 401)


def test_projection_forms_agree(spark):
    spec = S.stft_magnitude(blocks(spark, {1: np.sin(np.arange(4000) / 9)}))
    rows = S.mel_project(spec, S.mel_matrix()).orderBy("frame_idx").collect()
    long = S.mel_project_long(spec.select("clip_id", "frame_idx", F.posexplode("mag").alias("bin", "mag")),
                              S.mel_filterbank(spark)).collect()
    for r in long:
        assert math.isclose(rows[r.frame_idx].mel[r.mel], r.value, rel_tol=1e-9, abs_tol=1e-12)


def test_validity_and_silence(spark):
    b = blocks(spark, {1: [0.0, 0.0005], 2: [float("nan"), 1.0], 3: [float("inf")], 4: [0.5]})
    errors = {r.clip_id: r.error for r in S.validity_check(b).collect()}
    assert errors[1] is None and errors[4] is None and "finite" in errors[2] and "finite" in errors[3]
    assert {r.clip_id for r in S.silence_gate(b.filter("clip_id in (1, 4)")).collect()} == {4}


def test_slice_wraps_and_truncates(spark):
    x = np.arange(5000) / 8192
    req = spark.createDataFrame([(1, 7, 0, 1), (2, 7, 20, 1), (3, 7, 12, 1)], "request_id int, clip_id long, start_frame int, batch int")
    got = {r.request_id: r for r in S.slice_for_batch(blocks(spark, {7: x}), req).collect()}
    assert (got[1].start, got[1].stop) == (0, 5000)
    assert (got[2].start, got[2].stop) == ((12 * 640) % 5000, 5000)
    assert (got[3].start, got[3].stop) == (4 * 640, 5000)
    np.testing.assert_allclose(got[3].samples, x[2560:], atol=1e-6)


def test_db_variants(spark):
    df = spark.createDataFrame([(-100.0,), (-50.0,), (0.0,), (10.0,)], "s double")
    row = lambda *a: [r[0] for r in df.select(S.normalize_db(F.col("s"), *a)).collect()]
    assert row(True, True) == [-4.0, 0.0, 4.0, 4.0]
    assert row(False, True) == [0.0, 2.0, 4.0, 4.0]
    assert row(True, False)[3] == pytest.approx(4.8)
    assert [r[0] for r in df.select(S.db_range_error(F.col("s"))).collect()] == [False, False, False, True]
    back = df.filter("s <= 0").select("s", S.denormalize_db(S.normalize_db(F.col("s"))).alias("d")).collect()
    assert all(r.s == pytest.approx(r.d) for r in back)


def test_mel_of_whole_frames_moves_no_frame(spark):
    """Long form of whole frames: the same values as by the join, odd frames by filter, and no shuffle."""
    bank = S.mel_matrix(16000, 80, 20, 55.0, 7600.0)
    rng = np.random.default_rng(3)
    frames = [(1, i, rng.random(41).tolist()) for i in range(30)]
    whole = spark.createDataFrame(frames, "clip_id long, frame_idx long, mag array<double>")
    got = {(r.frame_idx, r.mel): r.value for r in S.mel_project_long(whole, bank).collect()}
    joined = S.mel_project_long(whole.select("clip_id", "frame_idx", F.posexplode("mag").alias("bin", "mag")), S.mel_filterbank(spark, 16000, 80, 20, 55.0, 7600.0))
    want = {(r.frame_idx, r.mel): r.value for r in joined.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "Exchange" not in S.mel_project_long(whole, bank)._jdf.queryExecution().executedPlan().toString()
    x = frames[0][2]
    odd = spark.createDataFrame([(1, 0, x), (1, 1, x[:20]), (1, 2, [*x[:30], None, *x[31:]]), (1, 3, [*x[:30], float("nan"), *x[31:]]), (1, 4, None), (1, 5, x + [9.0])],
                                "clip_id long, frame_idx long, mag array<double>")
    mel = {r.frame_idx: r.mel for r in S.mel_project(odd, bank).collect()}
    at30, past = bank[:, 30] != 0, (bank[:, 20:] != 0).any(1)
    assert np.allclose(mel[5], mel[0]) and mel[4] == [None] * 20
    assert [v is None for v in mel[1]] == past.tolist() and [v is None for v in mel[2]] == at30.tolist()
    assert [bool(np.isnan(v)) for v in mel[3]] == at30.tolist()
