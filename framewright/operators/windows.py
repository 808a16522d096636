"""Context windows over dense series (clip_id, frame_idx, vector).

All windows are cut inside bounded halo segments (see ``segments``): one shuffle,
no row is copied once per window it appears in before that shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.segments import halo_segments, salted_attach, with_bounds

KEY = "clip_id"
IDX = "frame_idx"


def _zero_like(v: Column) -> Column:
    return F.transform(v, lambda x: x * 0)


def _window_rows(segs: DataFrame, first: Column, last: Column, idx_name: str, window: Column) -> DataFrame:
    """One row per index from ``first`` to ``last`` of each segment, with its ``window`` read from the segment's rows.

    Only the indexes are exploded; ``window`` uses ``w`` for the index and takes its rows by position, so no row ever
    holds more than one window.
    """
    return segs.select("*", F.explode(F.sequence(first, last)).alias("w")).select(KEY, F.col("w").alias(idx_name), window.alias("window"))


def gather_windows(df: DataFrame, vec: str, lo: int, hi: int, pad: str = "edge",
                   span: int = 256, idx_name: str = "window_idx") -> DataFrame:
    """Rows ``[i+lo, i+hi)`` for each row i.

    ``pad``: ``edge`` repeats the end rows, ``zero`` inserts zero rows, ``drop``
    leaves out windows that would need padding.
    """
    before, after = max(0, -lo), max(0, hi - 1)
    span = max(span, before, after)
    segs = with_bounds(halo_segments(df, F.col(vec), span, before, after, KEY, IDX), span) \
        .filter("hi >= core_lo and lo <= core_hi")
    first, last = F.greatest("core_lo", "lo"), F.least("core_hi", "hi")
    if pad == "drop":
        first = F.greatest(first, F.col("lo") - lo) if lo < 0 else first
        last = F.least(last, F.col("hi") - (hi - 1)) if hi > 1 else last
    segs = segs.filter(first <= last)

    def row(off: int) -> Column:
        pos = (F.col("w") + off - F.col("lo")).cast("int")
        if pad == "zero":
            return F.coalesce(F.get("rows", pos)["v"], _zero_like(F.col("rows")[0]["v"]))
        top = (F.col("hi") - F.col("lo")).cast("int")
        return F.get("rows", F.least(F.greatest(pos, F.lit(0)), top))["v"]

    return _window_rows(segs, first, last, idx_name, F.array(*[row(off) for off in range(lo, hi)]))


def sliding_windows(df: DataFrame, vec: str, size: int = 16, strict: bool = False) -> DataFrame:
    """Strict: n-size+1 full windows.  Otherwise n windows, last row repeated."""
    return gather_windows(df, vec, 0, size, "drop" if strict else "edge")


def complete_windows(df: DataFrame, vec: str, size: int = 5, span: int = 256) -> DataFrame:
    """For each row the ``size`` rows from its index on, null where one of them is missing.

    The index may have gaps; it is unique in a clip.  Of a sorted segment the row ``size - 1`` places on tells whether the
    window is complete.
    """
    span = max(span, size)
    segs = halo_segments(df, F.col(vec), span, 0, size - 1, KEY, IDX)
    rows = segs.select("*", F.explode(F.sequence(F.lit(0), F.size("rows") - 1)).alias("p")).withColumn("w", F.get("rows", F.col("p"))["i"])
    whole = F.get("rows", F.col("p") + size - 1)["i"] == F.col("w") + size - 1
    window = F.array(*[F.get("rows", F.col("p") + k)["v"] for k in range(size)])
    return rows.where(F.floor(F.col("w") / F.lit(span)) == F.col("seg")).select(
        KEY, F.col("w").alias("window_idx"), F.when(whole, window).alias("window"))


def too_short(df: DataFrame, size: int = 16) -> DataFrame:
    """Clips a strict windowing must refuse."""
    return df.groupBy(KEY).agg((F.max(IDX) + 1).alias("n")).filter(F.col("n") < size).select(
        KEY, "n", F.concat(F.col("n").cast("string"),
                           F.lit(f" of {size} frames")).alias("error"))


def batch_windows(df: DataFrame, vec: str, batch: int, start: int, size: int = 16) -> DataFrame:
    """Windows start..start+batch-1 of each clip, last row repeated; error when start is outside.

    Only rows the batch can touch are gathered, at most ``batch + size`` per clip.
    """
    need = F.col(IDX).between(start, start + batch + size - 2)
    per_clip = df.groupBy(KEY).agg(
        (F.max(IDX) + 1).alias("n"),
        F.sort_array(F.collect_list(F.when(need, F.struct(IDX, vec)))).alias("rows"))
    ok = (F.lit(start) >= 0) & (F.lit(start) < F.col("n"))
    top = F.size("rows") - 1
    windows = F.transform(F.sequence(F.lit(0), F.lit(batch - 1)), lambda w: F.struct(
        (w + start).cast("long").alias("idx"),
        F.array(*[F.get("rows", F.least(w + o, top))[vec] for o in range(size)]).alias("window")))
    return (
        per_clip.withColumn("error", F.when(~ok, F.concat(
            F.lit(f"a start at {start} does not lie in a clip of "), F.col("n").cast("string"))))
        .withColumn("w", F.explode_outer(F.when(ok, windows)))
        .select(KEY, F.col("w.idx").alias("window_idx"), F.col("w.window").alias("window"), "error")
    )


def video_frame_count(n: Column, mode: str = "online", rate: int = 80, fps: int = 25,
                      size: int = 16, batch: int | None = None) -> Column:
    """Video frames a series of ``n`` steps yields.

    ``online`` floors at 0 and may be capped at ``batch + 16``; ``offline``
    truncates towards zero and adds 2.
    """
    if mode == "online":
        count = F.greatest(F.floor((n - size) * F.lit(fps) / F.lit(rate)), F.lit(0)).cast("long")
        return F.least(count, F.lit(batch + 16).cast("long")) if batch is not None else count
    count = ((n - size) / F.lit(float(rate)) * F.lit(float(fps))).cast("long") + 2
    return F.greatest(count, F.lit(0).cast("long"))


def _clock_segments(df: DataFrame, vec: str, rate: int, fps: int, size: int, ahead: int, span: int,
                    mode: str, cap: int | None):
    step = -(-rate // fps)
    before, after = size + step, size + (ahead + 2) * step
    span = max(span, before, after)
    if cap is not None:
        df = df.filter(F.col(IDX) < size + -(-cap * rate // fps) + step)
    segs = with_bounds(halo_segments(df, F.col(vec), span, before, after, KEY, IDX), span) \
        .filter("hi >= core_lo and lo <= core_hi")
    count = video_frame_count(F.col("hi") + 1, mode, rate, fps, size)
    if cap is not None:
        count = F.least(count, F.lit(cap).cast("long"))
    f_lo = F.floor((F.greatest("core_lo", "lo") * fps + (rate - 1)) / F.lit(rate)).cast("long")
    f_hi = F.least(F.floor(((F.least("core_hi", "hi") + 1) * fps - 1) / F.lit(rate)).cast("long"), count - 1)
    return segs.filter(f_lo <= f_hi), f_lo, f_hi


def _clock_start(f: Column, rate: int, fps: int, size: int) -> Column:
    """First row of clock frame f's window: moved back at the clip's end, 0 at least."""
    n = F.col("hi") + 1
    nominal = F.floor(f * rate / F.lit(fps)).cast("long")
    return F.greatest(F.when(nominal + size > n, n - size).otherwise(nominal), F.lit(0))


def _clock_rows(f: Column, rate: int, fps: int, size: int) -> list[Column]:
    """The ``size`` vectors of clock frame f: end-clamped, start floored at 0, last row repeated."""
    start = _clock_start(f, rate, fps, size)
    top = (F.col("hi") - F.col("lo")).cast("int")
    return [F.get("rows", F.least((start + j - F.col("lo")).cast("int"), top))["v"] for j in range(size)]


def clock_aligned_windows(df: DataFrame, vec: str, rate: int = 80, fps: int = 25, size: int = 16,
                          mode: str = "online", batch: int | None = None, span: int = 256) -> DataFrame:
    """For video frame f the ``size`` steps from ``int(rate*f/fps)``, shifted back at the clip's end."""
    cap = batch + 16 if batch is not None else None
    segs, f_lo, f_hi = _clock_segments(df, vec, rate, fps, size, 0, span, mode, cap)
    return _window_rows(segs, f_lo, f_hi, "video_frame", F.array(*_clock_rows(F.col("w"), rate, fps, size)))


def segmented_windows(df: DataFrame, vec: str, t: int = 5, rate: int = 80, fps: int = 25,
                      size: int = 16, span: int = 256) -> DataFrame:
    """For frame i the windows at clock frames i-1 .. i+3; null at i=0 or for clips shorter than a window."""
    segs, f_lo, f_hi = _clock_segments(df, vec, rate, fps, size, t - 1, span, "offline", None)
    ok = (F.col("w") >= 1) & (F.col("hi") + 1 >= size)
    # Clips of a window or more have all its rows, so each window is a slice.
    window = F.when(ok, F.array(*[F.slice("rows.v", (_clock_start(F.col("w") - 1 + k, rate, fps, size) - F.col("lo") + 1).cast("int"), size) for k in range(t)]))
    return _window_rows(segs, f_lo, f_hi, "video_frame", window)


def center_window(df: DataFrame, vec: str, size: int = 16) -> DataFrame:
    """Middle ``size`` rows of each clip, zero rows at the end of short clips.

    The wanted keys are joined on (clip, index), so long clips stay spread.
    """
    lens = df.groupBy(KEY).agg((F.max(IDX) + 1).alias("n"))
    start = F.greatest(F.floor((F.col("n") - size) / 2).cast("long"), F.lit(0))
    wanted = lens.select(KEY, F.explode(F.sequence(
        start, F.least(start + size, F.col("n")) - 1)).alias(IDX))
    rows = df.select(KEY, IDX, F.col(vec).alias("v")).join(wanted, [KEY, IDX], "left_semi")
    got = rows.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(IDX, "v"))).alias("rows"))
    kept = F.transform("rows", lambda x: x["v"])
    pad = F.array_repeat(_zero_like(F.col("rows")[0]["v"]), size)
    return got.select(KEY, F.slice(F.concat(kept, pad), 1, size).alias("window"))


def edge_pad(df: DataFrame, vec: str, span: int = 256) -> DataFrame:
    """One copy of the first row before and of the last row after; indexes shift by one.

    A row is the last of its clip if its segment, which also holds the first row of the next, has none after it.
    """
    segs = with_bounds(halo_segments(df, F.col(vec), span, 0, 1, KEY, IDX), span)
    rows = segs.select(KEY, "seg", "hi", F.explode("rows").alias("r")).where(F.floor(F.col("r.i") / F.lit(span)) == F.col("seg"))
    i = F.col("r.i")
    at = F.array_compact(F.array(i + 1, F.when(i == 0, F.lit(0).cast("long")), F.when(i == F.col("hi"), i + 2)))
    return rows.select(KEY, F.explode(at).alias(IDX), F.col("r.v").alias(vec))


def context_windows(df: DataFrame, vec: str, before: int = 8, after: int = 8,
                    pad: str = "zero") -> DataFrame:
    """Rows ``[i-before, i+after)``, always ``before + after`` of them."""
    return gather_windows(df, vec, -before, after, pad)


def causal_windows(df: DataFrame, vec: str, before: int = 8) -> DataFrame:
    """Rows ``[i-before, i)``, zero rows on the left."""
    return gather_windows(df, vec, -before, 0, "zero")


def forward_slice(df: DataFrame, vec: str, size: int = 3) -> DataFrame:
    """Rows ``[i, i+size)`` of the edge-padded series."""
    return gather_windows(df, vec, -1, size - 1, "edge")


def transpose_window(window: Column, width: int, steps: int | None = None) -> Column:
    """[steps][width] to [width][steps].  With ``steps``, for windows that all have so many, the places are taken one by one in compiled code."""
    if steps is not None:
        return F.when(window.isNotNull(), F.array(*[F.array(*[F.get(F.get(window, j), m) for j in range(steps)]) for m in range(width)]))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                       lambda m: F.transform(window, lambda row: F.get(row, m)))


# Feature shape of each mode.
FEATURE_MODES = {"ave": (32, 16, 16), "hubert": (32, 32, 32), "wenet": (256, 16, 32)}


def reshape_check(flat: Column, mode: Column) -> Column:
    """Error text when a flat feature cannot take the shape of its mode, else null."""
    want = F.lit(None).cast("int")
    for name, (a, b, c) in FEATURE_MODES.items():
        want = F.when(mode == name, F.lit(a * b * c)).otherwise(want)
    return F.when(want.isNull(), F.concat(F.lit("no layout for "), mode)).when(
        F.size(flat) != want,
        F.concat(F.size(flat).cast("string"), F.lit(" values do not fill "),
                 want.cast("string")))


def tile_feature(flat: Column, times: int = 16) -> Column:
    """Each value repeated ``times`` along a new last axis."""
    return F.flatten(F.transform(flat, lambda v: F.array_repeat(v, times)))


def clamped_features(requests: DataFrame, feats: DataFrame, vec: str) -> DataFrame:
    """Feature row of each requested frame; an index past the end takes the last row.

    Many requests may end at a last row, so that row is repeated per salt and its requests are dealt over the copies.
    """
    salts = 32
    lens = feats.groupBy(KEY).agg(F.max(IDX).alias("_last"))
    keyed = salted_attach(requests, lens, [KEY], [IDX]).withColumn("src_idx", F.least(IDX, "_last")).withColumn(
        "_copy", F.when(F.col("src_idx") == F.col("_last"), F.pmod(F.xxhash64(*requests.columns), F.lit(salts))).otherwise(0)).drop("_last")
    rows = salted_attach(feats, lens, [KEY], [IDX]).withColumn("_copy", F.explode(F.when(
        F.col(IDX) == F.col("_last"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return keyed.join(rows.select(KEY, F.col(IDX).alias("src_idx"), "_copy", vec), [KEY, "src_idx", "_copy"]).drop("_copy")


def replicate_feature(feats: DataFrame, batch: Column) -> DataFrame:
    """One feature row copied to every frame of a batch."""
    return feats.withColumn("batch_frame", F.explode(F.sequence(F.lit(0), batch - 1)))


def chunk_windows(chunks: DataFrame, requests: DataFrame, vec: str, size: int = 16) -> DataFrame:
    """Frame i of a batch uses chunks [i, i+16) of its request.

    ``chunks`` is (request_id, chunk_idx, ..), ``requests`` (request_id, frames).
    Requests with fewer than ``frames + 15`` chunks give one error row.  Windows
    are cut in segments, then matched to their request on (request, chunk).
    """
    have = chunks.groupBy("request_id").agg(F.count("*").alias("chunks"))
    status = requests.join(have, "request_id", "left").select(
        "request_id", "frames", F.coalesce("chunks", F.lit(0)).alias("chunks")).withColumn(
        "error", F.when(F.col("chunks") < F.col("frames") + (size - 1), F.concat(
            F.lit("wants "), (F.col("frames") + (size - 1)).cast("string"),
            F.lit(" chunks, has "), F.col("chunks").cast("string"))))
    series = chunks.select(F.col("request_id").alias(KEY), F.col("chunk_idx").alias(IDX), vec)
    windows = gather_windows(series, vec, 0, size, "drop").withColumnRenamed(KEY, "request_id")
    frames = status.withColumn("window_idx", F.explode_outer(
        F.when(F.col("error").isNull() & (F.col("frames") > 0),
               F.sequence(F.lit(0).cast("long"), F.col("frames").cast("long") - 1))))
    saved = (F.col("frames") * size - F.col("chunks")) / (F.col("frames") * size)
    return frames.join(windows, ["request_id", "window_idx"], "left").withColumn(
        "saved_share", F.when(F.col("error").isNull() & (F.col("frames") > 0), saved))
