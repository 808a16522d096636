import pytest
from pyspark.sql import functions as F

from framewright.operators import windows as W


def ramp(spark, lens):
    rows = [(c, i, [float(i)]) for c, n in lens.items() for i in range(n)]
    return spark.createDataFrame(rows, "clip_id int, frame_idx long, vec array<float>").repartition(4)


def as_dict(df, idx="window_idx"):
    return {(r["clip_id"], r[idx]): [v[0] for v in r["window"]] for r in df.collect()}


LENS = {1: 1, 2: 15, 3: 16, 4: 52, 5: 100, 6: 600}


@pytest.mark.parametrize("pad,lo,hi", [("edge", 0, 16), ("edge", -8, 8), ("zero", -8, 8), ("zero", -8, 0), ("drop", 0, 16), ("drop", -3, 2)])
def test_gather_equals_direct_indexing(spark, pad, lo, hi):
    got = as_dict(W.gather_windows(ramp(spark, LENS), "vec", lo, hi, pad, span=32))
    want = {}
    for c, n in LENS.items():
        for i in range(n):
            idx = range(i + lo, i + hi)
            if pad == "edge":
                want[c, i] = [float(min(max(j, 0), n - 1)) for j in idx]
            elif pad == "zero":
                want[c, i] = [float(j) if 0 <= j < n else 0.0 for j in idx]
            elif min(idx) >= 0 and max(idx) < n:
                want[c, i] = [float(j) for j in idx]
    assert got == want


def test_complete_windows_on_an_index_with_gaps(spark):
    have = {1: [0, 1, 2, 3, 4, 5, 9, 10, 11, 12, 13], 2: [3], 3: [i for i in range(200) if i % 31 != 30]}
    rows = [(c, i, [float(i)]) for c, idx in have.items() for i in idx]
    df = spark.createDataFrame(rows, "clip_id int, frame_idx long, vec array<float>").repartition(4)
    got = {(r.clip_id, r.window_idx): None if r.window is None else [v[0] for v in r.window] for r in W.complete_windows(df, "vec", span=16).collect()}
    assert got == {(c, i): [float(j) for j in range(i, i + 5)] if set(range(i, i + 5)) <= set(idx) else None for c, idx in have.items() for i in idx}


def test_known_clock_starts(spark):
    got = as_dict(W.clock_aligned_windows(ramp(spark, {1: 100}), "vec", mode="offline"), "video_frame")
    assert {f: got[1, f][0] for f in (0, 1, 10, 24)} == {0: 0.0, 1: 3.0, 10: 32.0, 24: 76.0}
    assert got[1, 27][0] == 84.0 and got[1, 27][-1] == 99.0


@pytest.mark.parametrize("mode", ["online", "offline"])
def test_clock_windows_over_segments(spark, mode):
    lens = {n: n for n in (5, 10, 15, 16, 17, 50, 52, 63, 64, 65, 300, 1000)}
    got = as_dict(W.clock_aligned_windows(ramp(spark, lens), "vec", mode=mode, span=48), "video_frame")
    want = {}
    for n in lens:
        count = max(0, (n - 16) * 25 // 80) if mode == "online" else max(0, int((n - 16) / 80. * 25.) + 2)
        for f in range(count):
            start = int(80. * f / 25.)
            if start + 16 > n:
                start = n - 16
            start = max(start, 0)
            want[n, f] = [float(min(start + j, n - 1)) for j in range(16)]
    assert got == want


def test_counts_differ_by_two(spark):
    row = spark.createDataFrame([(52,)], "n long").select(
        W.video_frame_count(F.col("n")), W.video_frame_count(F.col("n"), "offline")).first()
    assert tuple(row) == (11, 13)


def test_center_pad_and_edge_pad(spark):
    df = ramp(spark, {1: 3, 2: 21})
    got = {r.clip_id: [v[0] for v in r.window] for r in W.center_window(df, "vec").collect()}
    assert got[1] == [0.0, 1.0, 2.0] + [0.0] * 13
    assert got[2] == [float(i) for i in range(2, 18)]
    padded = sorted((r.clip_id, r.frame_idx, r.vec[0]) for r in W.edge_pad(df.filter("clip_id = 1"), "vec").collect())
    assert padded == [(1, 0, 0.0), (1, 1, 0.0), (1, 2, 1.0), (1, 3, 2.0), (1, 4, 2.0)]


def test_batch_windows_errors_and_tail(spark):
    out = W.batch_windows(ramp(spark, {1: 4, 2: 10}), "vec", batch=3, start=8, size=4).collect()
    bad = [r for r in out if r.error]
    assert [(r.clip_id, r.error) for r in bad] == [(1, "a start at 8 does not lie in a clip of 4")]
    rest = {r.window_idx: [v[0] for v in r.window] for r in out if not r.error}
    assert rest == {8: [8.0, 9.0, 9.0, 9.0], 9: [9.0] * 4, 10: [9.0] * 4}


def test_segmented_windows_need_a_full_clip(spark):
    out = W.segmented_windows(ramp(spark, {1: 14, 2: 40}), "vec").collect()
    short = [r for r in out if r.clip_id == 1]
    assert short and all(r.window is None for r in short)
    frame2 = next(r for r in out if r.clip_id == 2 and r.video_frame == 2)
    assert [w[0][0] for w in frame2.window] == [3.0, 6.0, 9.0, 12.0, 16.0]


def test_chunk_windows_reject(spark):
    chunks = spark.createDataFrame([(r, i, [float(i)]) for r, n in {1: 17, 2: 16}.items() for i in range(n)],
                                   "request_id int, chunk_idx long, vec array<float>")
    req = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "request_id int, frames int")
    out = W.chunk_windows(chunks, req, "vec").collect()
    assert {r.request_id: r.error for r in out if r.error} == {
        2: "wants 17 chunks, has 16", 3: "wants 16 chunks, has 0"}
    assert sorted((r.window_idx, r.window[0][0], r.saved_share) for r in out if not r.error) == [
        (0, 0.0, 15 / 32), (1, 1.0, 15 / 32)]


def test_transposed_windows_of_known_steps(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]), (2, None)], "k int, window array<array<double>>")
    got = {r.k: r.t for r in df.select("k", W.transpose_window(F.col("window"), 2, 3).alias("t")).collect()}
    assert got == {1: [[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]], 2: None}
    assert "lambda" not in df.select(W.transpose_window(F.col("window"), 2, 3))._jdf.queryExecution().optimizedPlan().toString()


def test_weighed_grids(spark):
    from framewright.plans.adapters import weigh_flat, weigh_grid

    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, []), (3, None), (4, [5.0]), (5, [1.0, None])]
    df = spark.createDataFrame(rows, "k int, v array<double>").coalesce(1)
    got = {r.k: (r.a, r.b) for r in df.select("k", weigh_flat("v").alias("a"), weigh_grid(2, 2)("v").alias("b")).collect()}
    assert got[1] == (30.0, 1 + 4 + 6 + 16) and got[2] == (0.0, 0.0) and got[3] == (None, None) and got[4] == (5.0, 5.0)
