"""Signal operators over ``signal_blocks`` (clip_id, block_idx, n, samples).

Blocks hold ``hop`` samples (the last may be short).  Everything per sample is
either a JVM array expression or a numpy kernel over bounded segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators.segments import OrderedParts, halo_segments, salted_attach, spread_join

KEY = "clip_id"


# ---------------------------------------------------------------- layout

def to_blocks(samples: DataFrame, hop: int = 200) -> DataFrame:
    """Long form (clip_id, sample_idx, value) to blocks of ``hop`` samples.

    Places and values are collected as two lists of plain numbers, 8 bytes a sample, and paired after the shuffle; the place of a
    value that is null is stored as ``-1 - place``, because lists leave nulls out.  With a column ``empty``, rows that have it
    set are no samples: their block is there, and has none if no other row is in it.
    """
    place = F.coalesce(F.col("sample_idx") - F.col("block_idx") * hop, F.lit(0)).cast("int")
    value = F.col("value").cast("float")
    at, level = F.when(value.isNull(), -1 - place).otherwise(place), F.coalesce(value, F.lit(0).cast("float"))
    if "empty" in samples.columns:
        at, level = F.when(~F.col("empty"), at), F.when(~F.col("empty"), level)
    pair = lambda p, v: F.struct(F.when(p < 0, -1 - p).otherwise(p).alias("p"), F.when(p >= 0, v).alias("v"))
    first = F.get("p", F.lit(0))
    in_order = (first >= 0) & (F.col("p") == F.sequence(first, first + F.size("p") - 1))
    pairs = F.when(F.array_min("p") >= 0, F.arrays_zip("p", "v")).otherwise(F.zip_with("p", "v", pair))
    return (
        samples.withColumn("block_idx", F.floor(F.col("sample_idx") / F.lit(hop)).cast("long"))
        .select(KEY, "block_idx", at.alias("p"), level.alias("v"))
        .groupBy(KEY, "block_idx")
        .agg(F.collect_list("p").alias("p"), F.collect_list("v").alias("v"))
        .select(KEY, "block_idx", F.size("p").alias("n"),
                F.when((F.size("p") == 0) | in_order, F.col("v")).otherwise(F.transform(F.sort_array(pairs), lambda s: s["v"])).alias("samples"))
    )


def to_samples(blocks: DataFrame, hop: int = 200, mark_empty: bool = False) -> DataFrame:
    """Blocks to long form.

    ``mark_empty`` adds the column ``empty`` and, for each block without samples, one row that has it set, at the place of the
    block's first sample and without a value; otherwise such blocks have no rows.
    """
    if not mark_empty:
        return blocks.select(KEY, "block_idx", F.posexplode("samples").alias("pos", "v")).select(
            KEY, (F.col("block_idx") * hop + F.col("pos")).alias("sample_idx"), F.col("v").cast("double").alias("value"))
    return blocks.where("samples is not null").select(KEY, "block_idx", F.posexplode_outer("samples").alias("pos", "v")).select(
        KEY, (F.col("block_idx") * hop + F.coalesce("pos", F.lit(0))).alias("sample_idx"),
        F.col("v").cast("double").alias("value"), F.col("pos").isNull().alias("empty"))


# ---------------------------------------------------------------- time domain

def pre_emphasis(blocks: DataFrame, k: float = 0.97, span: int = 256) -> DataFrame:
    """``y[0]=x[0]``, ``y[i]=x[i]-k*x[i-1]`` across block edges; after a missing block the signal starts anew.

    Blocks meet their predecessor inside stretches of ``span`` blocks; only the last sample of a stretch is copied to the next.
    A block with null samples is no block.
    """
    last = F.struct("block_idx", F.try_element_at("samples", F.lit(-1)).alias("v"))
    at = F.floor(F.col("block_idx") / F.lit(span)).cast("long")
    rows = blocks.select(KEY, "block_idx", "n", "samples", at.alias("_at"), last.alias("_last"))
    edges = rows.where((F.col("block_idx") + 1) % span == 0).select(
        KEY, "block_idx", F.lit(None).cast("int").alias("n"), F.lit(None).cast(blocks.schema["samples"].dataType).alias("samples"), (F.col("_at") + 1).alias("_at"), "_last")
    prev = F.lag("_last").over(Window.partitionBy(KEY, "_at").orderBy("block_idx"))
    met = rows.unionByName(edges).withColumn("_prev", prev).where(F.col("samples").isNotNull())
    before = F.when(F.col("_prev.block_idx") == F.col("block_idx") - 1, F.col("_prev.v").cast("double"))
    kept = met.select(KEY, "block_idx", "n", "samples", F.coalesce(before, F.lit(0.0)).alias("_before"))

    def emphasise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            ends, flat = _list_rows(rows)
            x = flat[ends[0]:ends[-1]].astype(np.float64)
            shifted = np.concatenate([[0.0], x[:-1]])[:len(x)]
            first = ends - ends[0]
            some = np.diff(first) > 0
            shifted[first[:-1][some]] = rows.column("_before").to_numpy()[some]
            yield pa.RecordBatch.from_arrays(
                [rows.column(KEY), rows.column("block_idx"), rows.column("n"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x - k * shifted))],
                names=[KEY, "block_idx", "n", "samples"])

    types = {f.name: f.dataType.simpleString() for f in blocks.schema}
    return kept.mapInArrow(emphasise, f"{KEY} {types[KEY]}, block_idx {types['block_idx']}, n {types['n']}, samples array<double>")


def _segment_rows(blocks: DataFrame, span: int, before: int, after: int) -> DataFrame:
    segs = halo_segments(blocks, F.col("samples"), span, before, after, KEY, "block_idx")
    return segs.select(
        KEY, "seg", F.col("rows")[0]["i"].alias("lo"),
        F.flatten(F.transform("rows", lambda r: r["v"])).alias("samples"))


def _list_rows(batch: pa.RecordBatch, name: str = "samples") -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(name)
    return (col.offsets.to_numpy(zero_copy_only=False),
            col.values.to_numpy(zero_copy_only=False))


def _emit(keys: pa.Array, owner: list[int], counts: list[int], idx: list[np.ndarray],
          vectors: list[np.ndarray], names: list[str], dtype: type) -> pa.RecordBatch:
    flat = np.concatenate([v.reshape(-1) for v in vectors]).astype(dtype, copy=False)
    width = vectors[0].shape[1]
    total = sum(counts)
    offsets = pa.array(np.arange(0, total * width + 1, width, dtype=np.int32))
    take = pa.array(np.repeat(np.asarray(owner, dtype=np.int64), counts))
    return pa.RecordBatch.from_arrays(
        [keys.take(take), pa.array(np.concatenate(idx)),
         pa.ListArray.from_arrays(offsets, pa.array(flat))], names=names)


def inverse_pre_emphasis(blocks: DataFrame, k: float = 0.97, hop: int = 200,
                         span: int = 64) -> DataFrame:
    """``y[n]=x[n]+k*y[n-1]``.

    The recursion forgets: a halo whose length makes ``k**len`` vanish below
    double rounding gives each segment the same values as the whole clip.
    """
    if not abs(k) < 1:
        raise ValueError("the recursion needs |k| < 1")
    warm = 1 if k == 0 else max(1, math.ceil(60 * math.log(2) / -math.log(abs(k)) / hop))
    span = max(span, warm)
    segs = _segment_rows(blocks, span, warm, 0)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lags = np.subtract.outer(np.arange(hop), np.arange(hop))
        lower = np.where(lags >= 0, np.power(float(k), np.maximum(lags, 0)), 0.0)
        decay = np.power(float(k), np.arange(1, hop + 1))
        for batch in batches:
            offs, vals = _list_rows(batch)
            seg, lo = batch.column("seg").to_numpy(), batch.column("lo").to_numpy()
            for r in range(batch.num_rows):
                x = vals[offs[r]:offs[r + 1]].astype(np.float64)
                skip = int(seg[r] * span - lo[r])
                m = -(-len(x) // hop)
                if m <= skip:
                    continue
                grid = np.zeros((m, hop))
                grid.reshape(-1)[:len(x)] = x
                y = grid @ lower.T
                carry = 0.0
                for b in range(m):
                    y[b] += decay * carry
                    carry = y[b, -1]
                n_out = np.full(m - skip, hop, dtype=np.int32)
                n_out[-1] = len(x) - (m - 1) * hop
                flat = y.reshape(-1)[skip * hop:len(x)]
                offsets = np.concatenate([[0], np.cumsum(n_out)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(KEY).take(pa.array(np.full(m - skip, r))),
                     pa.array(np.arange(lo[r] + skip, lo[r] + m)), pa.array(n_out),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=[KEY, "block_idx", "n", "samples"])

    key_type = blocks.schema[KEY].dataType.simpleString()
    return segs.mapInArrow(kernel, f"{KEY} {key_type}, block_idx long, n int, samples array<double>")


def clip_lengths(blocks: DataFrame) -> DataFrame:
    """Samples and last block index per clip."""
    return blocks.groupBy(KEY).agg(F.sum(F.col("n").cast("long")).alias("n_samples"),
                                   F.max("block_idx").alias("last_block"))


def peak_normalize(blocks: DataFrame) -> DataFrame:
    """``x*32767/max(0.01, max|x|)`` per clip, truncated to int16."""
    peaks = blocks.groupBy(KEY).agg(
        F.max(F.array_max(F.transform("samples", lambda v: F.abs(v.cast("double"))))).alias("peak"),
        F.max("block_idx").alias("last_block"))
    gain = F.lit(32767.0) / F.greatest(F.lit(0.01), F.col("peak"))
    return spread_join(blocks, peaks, "last_block").select(
        KEY, "block_idx", "n",
        F.transform("samples", lambda v: (v.cast("double") * gain).cast("int").cast("short")).alias("samples"))


def silence_gate(blocks: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Keep blocks with at least one sample louder than ``threshold``."""
    return blocks.filter(F.exists("samples", lambda v: F.abs(v) > F.lit(threshold)))


def silent_runs(blocks: DataFrame, threshold: float = 0.001, span: int = 1024) -> DataFrame:
    """Runs of silent blocks: (clip, first block, last block, blocks).

    Runs are found inside stretches of ``span`` blocks.  Only those that touch the edge of their stretch may go on in the next: of
    these a run starts where none ends just before and ends where none starts just after, each an anti join, and an end
    meets its start as the last start before it, over range parts, so no clip is ordered in one task.
    """
    at = F.floor(F.col("block_idx") / F.lit(span)).cast("long")
    quiet = blocks.where(~F.exists("samples", lambda v: F.abs(v) > F.lit(threshold))).select(KEY, "block_idx", at.alias("_at")).repartition(
        KEY, "_at").dropDuplicates([KEY, "_at", "block_idx"])
    place = F.row_number().over(Window.partitionBy(KEY, "_at").orderBy("block_idx"))
    runs = quiet.withColumn("_run", F.col("block_idx") - place).groupBy(KEY, "_at", "_run").agg(
        F.min("block_idx").alias("first_block"), F.max("block_idx").alias("last_block")).select(KEY, "first_block", "last_block")
    edge = (F.pmod("first_block", F.lit(span)) == 0) | (F.pmod(F.col("last_block") + 1, F.lit(span)) == 0)
    touching = runs.where(edge)
    # A clip that is null is one like any other.
    same = F.col(KEY).eqNullSafe(F.col("_clip"))
    other = touching.select(F.col(KEY).alias("_clip"), F.col("first_block").alias("_first"), F.col("last_block").alias("_last"))
    starts = touching.join(other, same & (F.col("_last") + 1 == F.col("first_block")), "left_anti").select(
        KEY, F.col("first_block").alias("block_idx"), F.lit(0).alias("_kind"), F.col("first_block").alias("_start"))
    ends = touching.join(other, same & (F.col("_first") - 1 == F.col("last_block")), "left_anti").select(
        KEY, F.col("last_block").alias("block_idx"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_start"))
    paired = OrderedParts(starts.unionByName(ends), [KEY], ["block_idx", "_kind"]).running("_start", "first_block", "last")
    whole = paired.where("_kind = 1").select(KEY, "first_block", F.col("block_idx").alias("last_block"))
    return whole.unionByName(runs.where(~edge)).withColumn("blocks", F.col("last_block") - F.col("first_block") + 1)


def fit_length(column: Column, n: int, zero: Column | None = None) -> Column:
    """Pad with zero or truncate an array to ``n`` items."""
    fill = F.lit(0.0).cast("float") if zero is None else zero
    return F.slice(F.concat(column, F.array_repeat(fill, n)), 1, n)


def fit_clip_blocks(blocks: DataFrame, n: int) -> DataFrame:
    """First ``n`` samples of each block-held chunk, zero-padded, with a flag and how many are the chunk's own."""
    return blocks.select(KEY, "block_idx", F.size(F.slice("samples", 1, n)).alias("n"), fit_length(F.col("samples"), n).alias("samples"),
                         (F.size("samples") != n).alias("length_differed"))


def validity_check(blocks: DataFrame) -> DataFrame:
    """Per clip: why it must be rejected, or null."""
    bad = lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return blocks.groupBy(KEY).agg(
        F.sum(F.size("samples")).alias("n_samples"),
        F.bool_or(F.exists("samples", bad)).alias("_bad"),
    ).select(
        KEY, "n_samples",
        F.when(F.col("n_samples") <= 0, "no samples")
        .when(F.col("_bad"), "samples that are not finite").alias("error"))


# ---------------------------------------------------------------- spectra

def hann(n: int, periodic: bool = True) -> np.ndarray:
    """Hann window; periodic (divisor n) or symmetric (divisor n-1)."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n if periodic else n - 1))


def _hz_to_mel(f: float) -> float:
    return f * 3 / 200 if f < 1000 else 15 + 27 * math.log(f / 1000) / math.log(6.4)


def mel_filterbank(spark: SparkSession, sr: int = 16000, n_fft: int = 800, n_mels: int = 80,
                   fmin: float = 55.0, fmax: float = 7600.0) -> DataFrame:
    """Slaney-normalised triangular filters (mel, bin, w), zero weights dropped.

    Fixed size: at most two filters overlap on a bin, so about ``n_fft`` rows.
    """
    lo, hi = _hz_to_mel(fmin), _hz_to_mel(fmax)

    def edge(j: Column) -> Column:
        m = F.lit(lo) + j * F.lit((hi - lo) / (n_mels + 1))
        return F.when(m < 15, m * F.lit(200.0 / 3)).otherwise(
            F.lit(1000.0) * F.exp((m - 15) * F.lit(math.log(6.4) / 27)))

    mels = spark.range(n_mels).select(
        F.col("id").cast("int").alias("mel"), edge(F.col("id")).alias("a"),
        edge(F.col("id") + 1).alias("b"), edge(F.col("id") + 2).alias("c"))
    freq = F.col("bin") * F.lit(sr / n_fft)
    tri = F.least((freq - F.col("a")) / (F.col("b") - F.col("a")),
                  (F.col("c") - freq) / (F.col("c") - F.col("b")))
    return (
        mels.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_fft // 2))))
        .select("mel", "bin", (tri * 2.0 / (F.col("c") - F.col("a"))).alias("w"))
        .filter("w > 0")
    )


def mel_matrix(sr: int = 16000, n_fft: int = 800, n_mels: int = 80,
               fmin: float = 55.0, fmax: float = 7600.0) -> np.ndarray:
    """The same filters as a dense [n_mels][n_fft/2+1] array, for the kernel."""
    m = np.linspace(_hz_to_mel(fmin), _hz_to_mel(fmax), n_mels + 2)
    f = np.where(m < 15, m * 200.0 / 3, 1000.0 * np.exp((m - 15) * math.log(6.4) / 27))
    bins = np.arange(n_fft // 2 + 1) * (sr / n_fft)
    a, b, c = f[:-2, None], f[1:-1, None], f[2:, None]
    return np.maximum(0, np.minimum((bins - a) / (b - a), (c - bins) / (c - b))) * 2.0 / (c - a)


def _spectral(blocks: DataFrame, make, out: str, *, k: float, win: int, hop: int,
              center: bool, span: int, dtype: str) -> DataFrame:
    """Cut frames inside bounded segments and apply a frame-matrix function.

    ``make()`` runs once per Python worker and returns a function from a
    [frames][win] matrix to a [frames][width] matrix.
    """
    pad = win // 2 if center else 0
    before = -(-pad // hop) + 1
    after = max(1, -(-(win - pad) // hop))
    span = max(span, before, after)
    segs = _segment_rows(blocks, span, before, after)
    np_type = np.float32 if dtype == "float" else np.float64
    names = [KEY, "frame_idx", out]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            offs, vals = _list_rows(batch)
            seg, lo = batch.column("seg").to_numpy(), batch.column("lo").to_numpy()
            owner, counts, idx, vecs, rows = [], [], [], [], 0
            for r in range(batch.num_rows):
                x = vals[offs[r]:offs[r + 1]].astype(np.float64)
                if k:
                    x[1:] -= k * x[:-1].copy()
                end = int(lo[r]) * hop + len(x)
                first = int(seg[r]) * span
                last = min(first + span - 1, (end + 2 * pad - win) // hop)
                m = last - first + 1
                if m <= 0:
                    continue
                start = first * hop - pad - int(lo[r]) * hop
                left = max(0, -start)
                need = start + left + (m - 1) * hop + win
                buf = np.zeros(max(need, left + len(x)))
                buf[left:left + len(x)] = x
                frames = np.lib.stride_tricks.sliding_window_view(buf, win)[start + left::hop][:m]
                owner.append(r)
                counts.append(m)
                idx.append(np.arange(first, last + 1))
                vecs.append(apply(frames))
                rows += m
                if rows >= 4096:
                    yield _emit(batch.column(KEY), owner, counts, idx, vecs, names, np_type)
                    owner, counts, idx, vecs, rows = [], [], [], [], 0
            if rows:
                yield _emit(batch.column(KEY), owner, counts, idx, vecs, names, np_type)

    key_type = blocks.schema[KEY].dataType.simpleString()
    return segs.mapInArrow(kernel, f"{KEY} {key_type}, frame_idx long, {out} array<{dtype}>")


def frame_signal(blocks: DataFrame, win: int = 800, hop: int = 200, center: bool = True,
                 span: int = 64, dtype: str = "float") -> DataFrame:
    """Overlapping frames; centred frames see ``win/2`` zeros at both clip ends."""
    return _spectral(blocks, lambda: (lambda frames: frames), "frame", k=0.0, win=win, hop=hop,
                     center=center, span=span, dtype=dtype)


def stft_magnitude(blocks: DataFrame, n_fft: int = 800, hop: int = 200, center: bool = True,
                   periodic: bool = True, k: float = 0.0, span: int = 64,
                   dtype: str = "double") -> DataFrame:
    """Hann-windowed real DFT magnitudes, ``n_fft/2+1`` per frame."""
    def make():
        w = hann(n_fft, periodic)
        return lambda frames: np.abs(np.fft.rfft(frames * w, axis=1))

    return _spectral(blocks, make, "mag", k=k, win=n_fft, hop=hop, center=center,
                     span=span, dtype=dtype)


def _mel_kernel(bank: np.ndarray):
    """Function from the lists of a column to [rows][mels] values and where they are null, for a :func:`mel_matrix`."""
    width, reach = bank.shape[1], bank != 0

    def project(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        size = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, np.diff(col.offsets.to_numpy()))
        flat = col.flatten()
        gone = flat.is_null().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0).to_numpy().astype(np.float64, copy=False)
        if (size == width).all():
            mag, missing = values.reshape(-1, width), gone.reshape(-1, width)
        else:
            mag, missing = np.zeros((len(size), width)), np.ones((len(size), width), bool)
            i = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
            row, use = np.repeat(np.arange(len(size)), size), i < width
            mag[row[use], i[use]], missing[row[use], i[use]] = values[use], gone[use]
        out, null = mag @ bank.T, np.zeros((len(mag), len(bank)), bool)
        # A value that is not finite or not there touches only the filters that reach it.
        for r in np.nonzero(missing.any(1) | ~np.isfinite(mag).all(1))[0]:
            null[r] = (reach & missing[r]).any(1)
            out[r] = [np.dot(mag[r][on], w[on]) for w, on in zip(bank, reach)]
        return out, null

    return project


def mel_project(spec: DataFrame, bank: np.ndarray) -> DataFrame:
    """``mel[j] = sum_k mag[k]*w[j][k]`` on magnitudes, without leaving the row.

    ``bank`` is :func:`mel_matrix`.  Filters that reach past the magnitudes of a frame are null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _mel_kernel(bank)
        for rows in batches:
            out, null = project(rows.column("mag"))
            ends = pa.array(np.arange(0, out.size + 1, len(bank), np.int32))
            yield pa.RecordBatch.from_arrays([rows.column(KEY), rows.column("frame_idx"), pa.ListArray.from_arrays(
                ends, pa.array(out.reshape(-1), mask=null.reshape(-1)))], names=[KEY, "frame_idx", "mel"])

    kind = {c: spec.schema[c].dataType.simpleString() for c in (KEY, "frame_idx")}
    return spec.select(KEY, "frame_idx", "mag").mapInArrow(run, f"{KEY} {kind[KEY]}, frame_idx {kind['frame_idx']}, mel array<double>")


def mel_project_long(spec: DataFrame, filters: DataFrame | np.ndarray) -> DataFrame:
    """The same in long form, (clip_id, frame_idx, mel, value).

    Whole frames (clip_id, frame_idx, mag[]) with a :func:`mel_matrix` are projected in their row and nothing is shuffled; a filter
    without a value has no row.  Rows (clip_id, frame_idx, bin, mag) with a :func:`mel_filterbank` are joined and summed: bins of a frame
    combine before the shuffle, which moves a row per frame and filter; Spark broadcasts the filters if they are small.
    """
    if isinstance(filters, np.ndarray):
        wide = mel_project(spec, filters[filters.any(axis=1)])
        number = F.array(*[F.lit(int(j)) for j in np.flatnonzero(filters.any(axis=1))])
        return wide.select(KEY, "frame_idx", F.posexplode("mel").alias("at", "value")).where("value is not null").select(
            KEY, "frame_idx", F.get(number, F.col("at")).alias("mel"), "value")
    return (
        spec.join(filters, "bin")
        .groupBy(KEY, "frame_idx", "mel").agg(F.sum(F.col("mag") * F.col("w")).alias("value"))
    )


# ---------------------------------------------------------------- levels

def amp_to_db(x: Column, min_db: float = -100.0, ref_db: float = 20.0) -> Column:
    """``20*log10(max(10^(min_db/20), x)) - ref_db`` for one value."""
    return F.lit(20.0) * F.log10(F.greatest(F.lit(10.0 ** (min_db / 20)), x)) - F.lit(ref_db)


def db_to_amp(x: Column) -> Column:
    return F.pow(F.lit(10.0), x * F.lit(0.05))


def normalize_db(s: Column, symmetric: bool = True, clip: bool = True,
                 min_db: float = -100.0, max_abs: float = 4.0) -> Column:
    """dB to the feature range; the four variants of the two flags."""
    unit = (s - F.lit(min_db)) / F.lit(-min_db)
    y = F.lit(2 * max_abs) * unit - F.lit(max_abs) if symmetric else F.lit(max_abs) * unit
    if clip:
        low = -max_abs if symmetric else 0.0
        y = F.least(F.greatest(y, F.lit(low)), F.lit(max_abs))
    return y


def db_range_error(s: Column, min_db: float = -100.0) -> Column:
    """True where the non-clipping variants of :func:`normalize_db` must refuse."""
    return (s > 0) | (s - F.lit(min_db) < 0)


def denormalize_db(d: Column, symmetric: bool = True, clip: bool = True,
                   min_db: float = -100.0, max_abs: float = 4.0) -> Column:
    """Inverse of :func:`normalize_db`."""
    if clip:
        low = -max_abs if symmetric else 0.0
        d = F.least(F.greatest(d, F.lit(low)), F.lit(max_abs))
    if symmetric:
        return (d + F.lit(max_abs)) * F.lit(-min_db) / F.lit(2 * max_abs) + F.lit(min_db)
    return d * F.lit(-min_db) / F.lit(max_abs) + F.lit(min_db)


def _db_norm(x: np.ndarray) -> np.ndarray:
    return np.clip(8.0 * (20.0 * np.log10(np.maximum(1e-5, x)) - 20.0 + 100.0) / 100.0 - 4.0, -4.0, 4.0)


def linear_spectrogram(blocks: DataFrame, n_fft: int = 800, hop: int = 200, k: float = 0.97,
                       dtype: str = "float", span: int = 64) -> DataFrame:
    """Emphasis, STFT, dB and normalisation without a mel step."""
    def make():
        w = hann(n_fft)
        return lambda frames: _db_norm(np.abs(np.fft.rfft(frames * w, axis=1)))

    return _spectral(blocks, make, "spec", k=k, win=n_fft, hop=hop, center=True,
                     span=span, dtype=dtype)


def mel_spectrogram(blocks: DataFrame, n_fft: int = 800, hop: int = 200, k: float = 0.97,
                    sr: int = 16000, n_mels: int = 80, fmin: float = 55.0, fmax: float = 7600.0,
                    dtype: str = "float", span: int = 64) -> DataFrame:
    """Emphasis, framing, STFT, mel, dB and normalisation: one shuffle, one Arrow pass."""
    def make():
        w, bank = hann(n_fft), mel_matrix(sr, n_fft, n_mels, fmin, fmax).T.copy()
        return lambda frames: _db_norm(np.abs(np.fft.rfft(frames * w, axis=1)) @ bank)

    return _spectral(blocks, make, "mel", k=k, win=n_fft, hop=hop, center=True,
                     span=span, dtype=dtype)


# ---------------------------------------------------------------- counts and slices

def frame_counts(blocks: DataFrame, win: int = 800, hop: int = 200) -> DataFrame:
    """Expected frames per clip under each counting rule, and the paddings."""
    n = F.col("n_samples")
    pad = win - hop
    lws = F.floor((n + (2 * pad - win)) / F.lit(hop)).cast("long") + \
        F.when(n % hop == 0, 1).otherwise(2)
    return clip_lengths(blocks).select(
        KEY, n,
        (F.floor(n / F.lit(hop)) + 1).cast("long").alias("centered"),
        lws.alias("lws"),
        ((F.floor(n / F.lit(hop)) + 1) * hop - n).cast("long").alias("librosa_pad_right"),
        F.lit(pad).cast("long").alias("lws_pad_left"),
        (F.lit(pad) + (lws - 1) * hop + win - (n + 2 * pad)).cast("long").alias("lws_pad_right"))


def validate_length(blocks: DataFrame, batch: int, win: int = 800, hop: int = 200) -> DataFrame:
    """Reject clips that yield fewer than ``batch + 15`` frames."""
    counts = frame_counts(blocks, win, hop)
    need = batch + 15
    return counts.select(
        KEY, "n_samples", F.col("centered").alias("expected_frames"),
        (F.col("centered") >= need).alias("ok"),
        F.when(F.col("centered") < need,
               F.concat(F.col("centered").cast("string"), F.lit(f" frames; a batch of {batch} takes {need}"))).alias("error"))


def slice_for_batch(blocks: DataFrame, requests: DataFrame, sr: int = 16000,
                    hop: int = 200, span: int = 256, reach: int = 64) -> DataFrame:
    """Samples for ``batch + 15`` video frames, starting 8 frames early.

    ``requests`` is (request_id, clip_id, start_frame, batch).  A start past the
    end wraps modulo the clip length; the end is cut at the clip's end.  A request
    for an unknown or empty clip is one row with an error and no samples.

    Blocks are gathered once into stripes of ``span`` blocks that also hold the next ``reach`` blocks, so a request for up to ``reach``
    blocks is cut out of the one stripe it starts in: requests travel, samples do not.  Only the parts of longer requests are gathered.
    """
    spf, width = sr * 40 // 1000, span * hop
    stripes = _segment_rows(blocks, span, 0, reach).select(KEY, F.col("seg").alias("_at"), "samples")
    lengths = blocks.select(KEY, F.size("samples").cast("long").alias("n")).groupBy(KEY).agg(F.sum("n").alias("n_samples"))
    raw = F.greatest(F.col("start_frame") - 8, F.lit(0)).cast("long") * spf
    req = (
        salted_attach(requests, lengths, [KEY], ["request_id"], how="left")
        .withColumn("error", F.when(F.col("n_samples").isNull(), "no such clip").when(F.col("n_samples") == 0, "empty clip"))
        .withColumn("start", F.when(raw >= F.col("n_samples"), F.try_mod(raw, F.col("n_samples"))).otherwise(raw))
        .withColumn("stop", F.least(F.col("start") + (F.col("batch") + 15).cast("long") * spf,
                                    F.col("n_samples")))
    )
    refused = req.filter("error is not null").select("request_id", KEY, F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"),
                                                     F.lit(None).cast("array<float>").alias("samples"), "error")
    good = req.filter("error is null").select("request_id", KEY, "start", "stop")
    first = F.floor(F.col("start") / F.lit(width)).cast("long")
    one = F.col("stop") - first * width <= width + reach * hop

    def cut(wanted: DataFrame, last: Column) -> DataFrame:
        """Wanted rows, up to sample ``last`` of their stripe, with their samples of it."""
        a = F.greatest(F.col("start") - F.col("_at") * width, F.lit(0)).cast("int")
        b = (F.least(F.col("stop"), last) - F.col("_at") * width).cast("int")
        return wanted.join(stripes, [KEY, "_at"]).select("request_id", KEY, "start", "stop", "_at", F.slice("samples", a + 1, b - a).alias("part"))

    whole = cut(good.where(one).withColumn("_at", first), F.col("stop"))
    parts = cut(good.where(~one).withColumn("_at", F.explode(F.sequence(first, F.floor((F.col("stop") - 1) / F.lit(width)).cast("long")))),
                (F.col("_at") + 1) * width)
    joined = (
        parts.repartition("request_id")
        .groupBy("request_id", KEY, "start", "stop")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "part"))).alias("parts"))
        .select("request_id", KEY, "start", "stop", F.flatten(F.transform("parts", lambda p: p["part"])).alias("samples"))
    )
    return whole.select("request_id", KEY, "start", "stop", F.col("part").alias("samples")).unionByName(joined).withColumn(
        "error", F.lit(None).cast("string")).unionByName(refused)


def rate_check(clips: DataFrame, expected: int = 16000) -> DataFrame:
    """Flag clips sampled at another rate than the feature settings expect."""
    return clips.withColumn("rate_ok", F.col("sample_rate") == F.lit(expected))
