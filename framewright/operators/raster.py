"""Raster operators.

Two layouts: *long* (frame_idx, y, x, b, g, r), one row per pixel, for relational
work; *array*, one row per frame, for volume.  ``planes`` is CHW BGR in [0,1] as
floats, ``rgb`` is HWC bytes as BINARY, which numpy reads in place.  A frame row is
bounded by the picture size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators.frames import cyclic_join, strict_lookup


def to_byte(v: Column) -> Column:
    """[0,1] to 0..255: times 255, clamped, truncated."""
    scaled = v * F.lit(255.0).cast("float")
    return F.when(scaled < 0, F.lit(0)).when(scaled > 255, F.lit(255)).otherwise(scaled.cast("int")).cast("short")


def _with_column(rows: pa.RecordBatch, drop: list[str], **new: pa.Array) -> pa.RecordBatch:
    kept = [c for c in rows.schema.names if c not in drop and c not in new]
    return pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], *new.values()], names=[*kept, *new])


def bgr_planes_to_pixels(frames: DataFrame, order: str = "bgr") -> DataFrame:
    """``planes`` to ``rgb`` bytes, interleaved; ``order`` names the plane order.

    Values are times 255, clamped and truncated, NaN is 0.  Planes that are null or not of the frame's size give null.
    """
    picks = [order.index(c) for c in "rgb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            planes = rows.column("planes")
            ends, flat, null = planes.offsets.to_numpy(), planes.values.to_numpy(zero_copy_only=False), planes.is_null().to_pylist()
            out = []
            for k, (h, w) in enumerate(zip(rows.column("h").to_pylist(), rows.column("w").to_pylist())):
                p = flat[ends[k]:ends[k + 1]]
                if null[k] or len(p) != 3 * h * w:
                    out.append(None)
                    continue
                level = np.clip(np.nan_to_num(p.astype(np.float32) * np.float32(255), nan=0.0, posinf=255.0, neginf=0.0), 0, 255).astype(np.uint8)
                out.append(level.reshape(3, h, w)[picks].transpose(1, 2, 0).tobytes())
            yield _with_column(rows, ["planes"], rgb=pa.array(out, pa.binary()))

    schema = T.StructType([*[f for f in frames.schema if f.name not in ("planes", "rgb")], T.StructField("rgb", T.BinaryType())])
    return frames.mapInArrow(run, schema)


def _levels(flat: np.ndarray) -> np.ndarray:
    """:func:`to_byte` of an array; NaN is 255."""
    v = flat * np.float32(255)
    return np.clip(np.where(np.isnan(v), 255, v), 0, 255).astype(np.int16)


def _listed(rows: pa.RecordBatch, name: str, values: np.ndarray, null: np.ndarray | None) -> pa.ListArray:
    """Lists like those of the column, with other values."""
    col = rows.column(name)
    sizes = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, np.diff(col.offsets.to_numpy()))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values, mask=null), mask=col.is_null())


def plane_bytes(frames: DataFrame) -> DataFrame:
    """``planes`` in [0,1] to 0..255 as :func:`to_byte` gives them; other columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            flat = rows.column("planes").flatten()
            null = flat.is_null().to_numpy(zero_copy_only=False)
            yield _with_column(rows, [], planes=_listed(rows, "planes", _levels(flat.fill_null(0).to_numpy()), null))

    rest = [f for f in frames.schema if f.name != "planes"]
    return frames.mapInArrow(run, T.StructType([*rest, T.StructField("planes", T.ArrayType(T.ShortType()))]))


def mask_planes(frames: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Zero the pixels of a rectangle in every plane (bytes, with the frame's ``h`` and ``w``); :func:`mask_region` on pixel rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            col = rows.column("planes")
            sizes = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, np.diff(col.offsets.to_numpy()))
            flat = col.flatten()
            i = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ph, pw = (np.repeat(np.maximum(rows.column(c).cast(pa.int64()).fill_null(0).to_numpy(), 1), sizes) for c in "hw")
            py, px = i % (ph * pw) // pw, i % pw
            inside = (px >= x) & (px < x + w) & (py >= y) & (py < y + h)
            null = flat.is_null().to_numpy(zero_copy_only=False) & ~inside
            yield _with_column(rows, [], planes=_listed(rows, "planes", np.where(inside, 0, flat.fill_null(0).to_numpy()).astype(np.int16), null))

    rest = [f for f in frames.schema if f.name != "planes"]
    return frames.mapInArrow(run, T.StructType([*rest, T.StructField("planes", T.ArrayType(T.ShortType()))]))


PIXELS = 1 << 18  # pixel rows of one Arrow batch, about


def planes_to_long(frames: DataFrame) -> DataFrame:
    """Array planes to one row per pixel, bytes per channel; other columns stay.

    Values are times 255, clamped and truncated, NaN is 255.  A value that is null or not there gives a null channel; a frame
    without a size has no pixel.
    """
    rest = [c for c in frames.columns if c != "planes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            h, w = (rows.column(c).cast(pa.int64()).fill_null(0).to_numpy() for c in "hw")
            count = np.maximum(h, 0) * np.maximum(w, 0)
            planes = rows.column("planes")
            ends = planes.offsets.to_numpy()
            held = np.where(planes.is_null().to_numpy(zero_copy_only=False), 0, np.diff(ends))
            values = planes.values
            absent = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
            flat = values.to_numpy(zero_copy_only=False)
            flat = flat if flat.dtype in (np.float32, np.float64) else flat.astype(np.float64)
            total = np.cumsum(count)
            lo = 0
            while lo < rows.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PIXELS, "right")))
                own = np.repeat(np.arange(lo, hi), count[lo:hi])
                i = np.arange(len(own)) - np.repeat(np.cumsum(count[lo:hi]) - count[lo:hi], count[lo:hi])
                out = [rows.column(c).take(pa.array(own)) for c in rest]
                out += [pa.array((i // w[own]).astype(np.int32)), pa.array((i % w[own]).astype(np.int32))]
                for p in range(3):
                    at = count[own] * p + i
                    missing = at >= held[own]
                    at = np.where(missing, 0, ends[own] + at)
                    level = _levels(flat[at]) if len(flat) else np.zeros(len(at), np.int16)
                    if absent is not None:
                        missing |= absent[at]
                    out.append(pa.array(level, mask=missing))
                if len(own):
                    yield pa.RecordBatch.from_arrays(out, names=[*rest, "y", "x", "b", "g", "r"])
                lo = hi

    schema = T.StructType([*[frames.schema[c] for c in rest], *[T.StructField(c, T.IntegerType()) for c in "yx"],
                           *[T.StructField(c, T.ShortType()) for c in "bgr"]])
    return frames.mapInArrow(run, schema)


_FIXED = {T.ByteType(): np.int8, T.ShortType(): np.int16, T.IntegerType(): np.int32, T.LongType(): np.int64, T.FloatType(): np.float32,
          T.DoubleType(): np.float64, T.BooleanType(): np.bool_}


def _gathered(long: DataFrame, cols: list[str], tops: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, type]]:
    """(frame_idx, chunks): the ``cols`` of a frame's pixel rows, in chunks, and the largest of each of ``tops``; and their numpy types.

    A chunk holds a column as the bytes of its values, and a byte a value for nulls.  Pixels that stand together in an Arrow
    batch become one chunk before they move, so that a frame whose pixels come together moves as one row; in any other
    order chunks are smaller.  A frame is bounded by its picture.
    """
    rows = long.where("frame_idx is not null").select("frame_idx", *tops, *cols)
    kinds = {c: _FIXED[rows.schema[c].dataType] for c in cols}
    parts = [*cols, *[f"{c}_null" for c in cols]]

    def raw(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            frame = part.column("frame_idx").to_numpy(zero_copy_only=False)
            if (frame[1:] < frame[:-1]).any():
                order = np.argsort(frame, kind="stable")
                part, frame = part.take(pa.array(order)), frame[order]
            first = np.append(0, np.nonzero(frame[1:] != frame[:-1])[0] + 1)
            ends, none = np.append(first, len(frame)), np.zeros(len(first) + 1, np.int64)
            out = [part.column("frame_idx").take(pa.array(first))]
            out += [pa.array(np.maximum.reduceat(part.column(c).cast(pa.int64()).fill_null(0).to_numpy(), first)) for c in tops]
            out += [raw(np.ascontiguousarray(part.column(c).fill_null(kinds[c](0)).to_numpy(zero_copy_only=False).astype(kinds[c], copy=False)), ends) for c in cols]
            # Columns without a null send no bytes for them.
            out += [raw(part.column(c).is_null().to_numpy(zero_copy_only=False), ends) if part.column(c).null_count else raw(np.zeros(0, bool), none) for c in cols]
            yield pa.RecordBatch.from_arrays(out, names=["frame_idx", *tops, *parts])

    schema = T.StructType([rows.schema["frame_idx"], *[T.StructField(c, T.LongType()) for c in tops], *[T.StructField(c, T.BinaryType()) for c in parts]])
    return rows.mapInArrow(run, schema).groupBy("frame_idx").agg(*[F.max(c).alias(c) for c in tops], F.collect_list(F.struct(*parts)).alias("chunks")), kinds


def _chunk_values(rows: pa.RecordBatch, name: str, kinds: dict[str, type]) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray | None]]:
    """Row of each gathered pixel, its values by column, and where they are null (nothing for a column without nulls)."""
    chunks = rows.column(name)
    held = chunks.flatten()
    owner = np.repeat(np.arange(rows.num_rows), np.diff(chunks.offsets.to_numpy()))

    def raw(c: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        col = held.field(c)
        ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int32)
        data = col.buffers()[2]
        values = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].copy().view(kind) if data is not None else np.zeros(0, kind)
        return values, np.diff(ends) // np.dtype(kind).itemsize

    values, nulls = {}, {}
    for c, kind in kinds.items():
        values[c], size = raw(c, kind)
        flags, known = raw(f"{c}_null", np.bool_)
        nulls[c] = None
        if len(flags):
            nulls[c] = np.zeros(len(values[c]), bool)
            nulls[c][np.repeat(known > 0, size)] = flags
    return np.repeat(owner, size), values, nulls


def resample_array(src: np.ndarray, w: int, h: int, kind: type = np.int16, any_of: bool = False) -> np.ndarray:
    """[..][h][w][c] bytes to another size: corner-aligned bilinear in float32, truncated; ``any_of`` takes the largest of the four."""
    sh, sw = src.shape[-3:-1]
    fx = np.arange(w, dtype=np.float32) * np.float32(np.float32(sw) / np.float32(w))
    fy = np.arange(h, dtype=np.float32) * np.float32(np.float32(sh) / np.float32(h))
    x0, y0 = fx.astype(np.int64), fy.astype(np.int64)
    wx, wy = (fx - x0.astype(np.float32))[None, :, None], (fy - y0.astype(np.float32))[:, None, None]
    x1, y1 = np.minimum(x0 + 1, sw - 1), np.minimum(y0 + 1, sh - 1)
    f = src.astype(np.float32)
    one = np.float32(1)
    upper, lower = f.take(y0, -3), f.take(y1, -3)
    if any_of:
        return np.maximum(np.maximum(upper.take(x0, -2), upper.take(x1, -2)), np.maximum(lower.take(x0, -2), lower.take(x1, -2)))
    top = upper.take(x0, -2) * (one - wx) + upper.take(x1, -2) * wx
    bottom = lower.take(x0, -2) * (one - wx) + lower.take(x1, -2) * wx
    return (top * (one - wy) + bottom * wy).astype(kind)


def resample_bilinear(frames: DataFrame, w: int, h: int) -> DataFrame:
    """Resize ``rgb`` of every frame row; no shuffle.  Pictures of one size are resized together; a null stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            rgb = rows.column("rgb")
            shape = np.stack([rows.column("h").to_numpy(), rows.column("w").to_numpy()], axis=1)
            null, out = np.array(rgb.is_null().to_pylist(), bool), np.full(rows.num_rows, None, object)
            for sh, sw in np.unique(shape[~null], axis=0).tolist():
                same = np.nonzero(~null & (shape == (sh, sw)).all(1))[0]
                for at in np.array_split(same, max(1, len(same) * max(sh * sw, h * w) >> 20)):
                    src = np.frombuffer(b"".join(rgb[i].as_buffer() for i in at.tolist()), np.uint8).reshape(len(at), sh, sw, 3)
                    small = resample_array(src, w, h).astype(np.uint8)
                    for i, picture in zip(at, small):
                        out[i] = picture.tobytes()
            size = lambda v, c: pa.array(np.full(rows.num_rows, v), rows.schema.field(c).type)
            yield pa.RecordBatch.from_arrays([{"rgb": lambda: pa.array(out.tolist(), pa.binary()), "h": lambda: size(h, "h"), "w": lambda: size(w, "w")}.get(
                c, lambda c=c: rows.column(c))() for c in rows.schema.names], names=rows.schema.names)

    return frames.mapInArrow(run, frames.schema)


def resample_bilinear_long(long: DataFrame, w: int, h: int) -> DataFrame:
    """The same on pixel rows (with their frame's ``h`` and ``w``).

    A target pixel is there if one of its four neighbours is; a channel is null where one of them is missing or null.
    """
    cols = ["y", "x", "b", "g", "r"]
    frames, kinds = _gathered(long, cols, ("h", "w"))

    def pictures(at: np.ndarray, y: np.ndarray, x: np.ndarray, bgr: np.ndarray, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        """[frames][sh][sw][b, g, r] with NaN for what is missing, and which pixels are there; of repeated pixels the largest counts."""
        src, there = np.full((*shape, 3), np.nan, np.float32), np.zeros(shape, bool)
        there[at, y, x] = True
        if there.sum() == len(at):
            src[at, y, x] = bgr
        else:
            np.fmax.at(src, (at, y, x), bgr)
        return src, there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            owner, v, null = _chunk_values(rows, "chunks", kinds)
            size = np.stack([rows.column(c).to_numpy() for c in "hw"], axis=1)
            y, x = (v[c] if null[c] is None else np.where(null[c], -1, v[c]) for c in "yx")
            inside = (y >= 0) & (x >= 0) & (y < size[owner, 0]) & (x < size[owner, 1])
            bgr = np.stack([v[c].astype(np.float32) if null[c] is None else np.where(null[c], np.nan, v[c]).astype(np.float32) for c in "bgr"], axis=1)
            for sh, sw in np.unique(size[(size > 0).all(1)], axis=0).tolist():
                same = np.nonzero((size == (sh, sw)).all(1))[0]
                for part in np.array_split(same, max(1, len(same) * max(sh * sw, h * w) >> 18)):
                    place = np.full(rows.num_rows, -1)
                    place[part] = np.arange(len(part))
                    lo, hi = np.searchsorted(owner, (part[0], part[-1] + 1))
                    use = lo + np.nonzero(inside[lo:hi] & (place[owner[lo:hi]] >= 0))[0]
                    src, there = pictures(place[owner[use]], y[use], x[use], bgr[use], (len(part), sh, sw))
                    with np.errstate(invalid="ignore"):
                        out = resample_array(src, w, h, np.float32).reshape(-1, 3)
                    some = np.ones(len(out), bool) if there.all() else resample_array(
                        there[..., None] * np.float32(1), w, h, np.float32, any_of=True).reshape(-1) > 0
                    frame, (ty, tx) = np.repeat(part, h * w), np.divmod(np.tile(np.arange(h * w), len(part)), w)
                    frame, ty, tx, out = frame[some], ty[some], tx[some], out[some]
                    gone = np.isnan(out)
                    level = np.where(gone, 0, out).astype(np.int16)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("frame_idx").take(pa.array(frame)), *[pa.array(np.full(len(frame), n, np.int32)) for n in (h, w)],
                         pa.array(ty.astype(np.int32)), pa.array(tx.astype(np.int32)), *[pa.array(level[:, k], mask=gone[:, k]) for k in range(3)]],
                        names=["frame_idx", "h", "w", *cols])

    schema = T.StructType([long.schema["frame_idx"], *[T.StructField(c, T.IntegerType()) for c in ("h", "w", "y", "x")],
                           *[T.StructField(c, T.ShortType()) for c in "bgr"]])
    return frames.mapInArrow(run, schema)


def _targets(at: Column, source: Column, n: int) -> Column:
    """Targets of 0 to n - 1 whose source position, ``int(target * (source / n))``, is ``at``; null if there are none."""
    ratio = source.cast("double") / F.lit(float(n))

    def first(p: Column) -> Column:
        """Least target whose position is ``p`` or more; the quotient may be off by one."""
        near = F.ceil(p / ratio).cast("int")
        reach = lambda t: (t * ratio).cast("int") >= p
        return F.greatest(F.when(reach(near - 1), near - 1).when(reach(near), near).otherwise(near + 1), F.lit(0))

    lo, hi = first(at), F.least(first(at + 1) - 1, F.lit(n - 1))
    return F.when(lo <= hi, F.sequence(lo, hi))


def resample_nearest(long: DataFrame, w: int, h: int) -> DataFrame:
    """Source pixel ``int(dst*ratio)`` per axis: each pixel row (with its frame's ``h`` and ``w``) is copied to its targets, without a join."""
    inside = (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") < F.col("w"))
    rows = long.where(inside & F.col("frame_idx").isNotNull())
    down = rows.withColumn("ty", F.explode(_targets(F.col("y"), F.col("h"), h)))
    return down.withColumn("tx", F.explode(_targets(F.col("x"), F.col("w"), w))).select(
        "frame_idx", F.lit(h).alias("h"), F.lit(w).alias("w"), F.col("ty").alias("y"), F.col("tx").alias("x"), "b", "g", "r")


def center_crop(long: DataFrame, lo: int = 4, hi: int = 324) -> DataFrame:
    """Pixels of ``[lo,hi)`` on both axes, re-based to 0."""
    inside = F.col("y").between(lo, hi - 1) & F.col("x").between(lo, hi - 1)
    return long.filter(inside).withColumns({
        "y": F.col("y") - lo, "x": F.col("x") - lo, "h": F.lit(hi - lo), "w": F.lit(hi - lo)})


def mask_region(long: DataFrame, x: int = 5, y: int = 5, w: int = 310, h: int = 305) -> DataFrame:
    """Zero the pixels of a rectangle."""
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return long.withColumns({c: F.when(inside, F.lit(0).cast("short")).otherwise(F.col(c)) for c in "bgr"})


def label_guard(pred: DataFrame, original: DataFrame, labels: DataFrame) -> DataFrame:
    """Keep the original where the label pixel is (0,0,255) or white; pixels that are not in all three are left out.

    The three meet by frame, as rows of whole pictures, not by pixel.
    """
    keep = F.coalesce((F.col("r") == 255) & (F.col("b") == F.col("g")) & F.col("b").isin(0, 255), F.lit(False))
    key, bgr = ["y", "x"], ["b", "g", "r"]
    (new, new_kinds), (old, old_kinds) = _gathered(pred, [*key, *bgr]), _gathered(original, [*key, *bgr])
    lab, lab_kinds = _gathered(labels.select("frame_idx", *key, keep.alias("keep")), [*key, "keep"])
    sides = new.withColumnRenamed("chunks", "new").join(old.withColumnRenamed("chunks", "old").hint("merge"), "frame_idx").join(
        lab.withColumnRenamed("chunks", "lab").hint("merge"), "frame_idx")
    wide = [(T.ByteType(), pa.int8()), (T.ShortType(), pa.int16()), (T.IntegerType(), pa.int32()), (T.LongType(), pa.int64())]
    rank = {c: max([k for k, _ in wide].index(df.schema[c].dataType) for df in (pred, original)) for c in bgr}
    kinds = {c: wide[k][1] for c, k in rank.items()}
    schema = T.StructType([pred.schema["frame_idx"], *[pred.schema[c] for c in key], *[T.StructField(c, wide[rank[c]][0]) for c in bgr]])

    def pixels(rows: pa.RecordBatch, name: str, kinds: dict[str, type]) -> pa.Table:
        owner, v, null = _chunk_values(rows, name, kinds)
        return pa.table({"f": owner, **{c: pa.array(v[c], mask=null[c]) for c in kinds}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = ["f", *key]
        for rows in batches:
            if not rows.num_rows:
                continue
            new, old, mark = pixels(rows, "new", new_kinds), pixels(rows, "old", old_kinds), pixels(rows, "lab", lab_kinds)
            if all(t.select(at).equals(new.select(at)) for t in (old, mark)) and _ordered(new, at):
                met = new.append_column("keep", mark.column("keep"))
                for c in bgr:
                    met = met.append_column(f"_{c}", old.column(c))
            else:
                met = new.join(old.rename_columns([*at, *[f"_{c}" for c in bgr]]), at, join_type="inner").join(mark, at, join_type="inner")
            picked = [pc.if_else(met.column("keep"), met.column(f"_{c}").cast(kinds[c]), met.column(c).cast(kinds[c])) for c in bgr]
            done = pa.table([rows.column("frame_idx").take(met.column("f").combine_chunks()), *[met.column(c) for c in key], *picked],
                            names=["frame_idx", *key, *bgr])
            yield from done.combine_chunks().to_batches(max_chunksize=PIXELS)

    return sides.mapInArrow(run, schema)


def _ordered(pixels: pa.Table, at: list[str]) -> bool:
    """Whether the columns ``at`` rise from row to row, so that no pixel occurs twice, and hold no null."""
    if any(pixels.column(c).null_count for c in at):
        return False
    more, same = np.zeros(max(len(pixels) - 1, 0), bool), np.ones(max(len(pixels) - 1, 0), bool)
    for step in (np.diff(pixels.column(c).to_numpy()) for c in at):
        more |= same & (step > 0)
        same &= step == 0
    return bool(more.all())


def six_channel_input(reference: DataFrame, masked: DataFrame, key: str = "frame_idx") -> DataFrame:
    """Reference planes then masked planes, bytes over 255."""
    both = reference.select(key, F.col("planes").alias("_a")).join(masked.select(key, F.col("planes").alias("_b")).hint("merge"), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            a, b = rows.column("_a"), rows.column("_b")
            size = lambda c: np.where(c.is_null().to_numpy(zero_copy_only=False), 0, np.diff(c.offsets.to_numpy()))
            na, nb = size(a), size(b)
            ends = np.append(0, np.cumsum(na + nb))
            # Where a value goes: behind the values of earlier rows, those of ``_b`` behind the row's ``_a``.
            to = np.concatenate([np.repeat(ends[:-1] - (np.cumsum(na) - na), na) + np.arange(na.sum()),
                                 np.repeat(ends[:-1] + na - (np.cumsum(nb) - nb), nb) + np.arange(nb.sum())])
            values = pa.concat_arrays([a.flatten(), b.flatten()])
            null = values.is_null().to_numpy(zero_copy_only=False)
            flat, gone = np.empty(len(values), np.float32), np.empty(len(values), bool)
            flat[to] = (values.cast(pa.float64()).fill_null(0).to_numpy() / 255.0).astype(np.float32)
            gone[to] = null
            whole = (a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([rows.column(key), pa.ListArray.from_arrays(
                pa.array(ends.astype(np.int32)), pa.array(flat, mask=gone), mask=pa.array(whole))], names=[key, "channels"])

    return both.mapInArrow(run, T.StructType([reference.schema[key], T.StructField("channels", T.ArrayType(T.FloatType()))]))


def pixel_stats(long: DataFrame) -> DataFrame:
    """Brightness mean and standard deviation over all channels, and the raw size."""
    s = (F.col("b") + F.col("g") + F.col("r")).cast("long")
    q = F.col("b").cast("long") * F.col("b") + F.col("g").cast("long") * F.col("g") + F.col("r").cast("long") * F.col("r")
    out = long.groupBy("frame_idx").agg(F.sum(s).alias("_s"), F.sum(q).alias("_q"), F.count("*").alias("_n"))
    n = F.col("_n") * 3
    mean = F.col("_s") / n
    return out.select("frame_idx", mean.alias("mean"),
                      F.sqrt(F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0))).alias("std"), n.alias("bytes"))


def region_means(long: DataFrame, corner: int = 10, size: int = 20, half: int = 20) -> DataFrame:
    """Mean B,G,R in the top-left corner, the centre and the bottom-right corner."""
    h, w = F.col("h"), F.col("w")
    cy, cx = F.floor(h / 2), F.floor(w / 2)
    inside = lambda v, lo, hi: (v >= lo) & (v < hi)
    y, x = F.col("y"), F.col("x")
    near, far = corner, corner + size
    areas = {"top_left": inside(y, near, far) & inside(x, near, far),
             "center": inside(y, cy - half, cy + half) & inside(x, cx - half, cx + half),
             "bottom_right": inside(y, h - far, h - near) & inside(x, w - far, w - near)}
    hits = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in areas.items()]))
    return long.where(areas["top_left"] | areas["center"] | areas["bottom_right"]).withColumn("region", F.explode(hits)).groupBy("frame_idx", "region").agg(
        *[F.avg(c).alias(c) for c in "bgr"])


def composite_frames(regions: DataFrame, rects: DataFrame, backgrounds: DataFrame,
                     border: int = 0) -> DataFrame:
    """Paste each region, resized to its rect, on its ring background.

    ``regions``: model_id, frame_idx, h, w, planes.  ``rects`` as in J2, and
    ``backgrounds``: model_id, ring_idx, bg_h, bg_w, bg (rgb bytes).  A frame without a
    rect keeps an error and no picture.  With ``border`` the region replaces the
    inside of the crop enlarged to ``w + 2*border`` first.

    Rect and ring index are settled on (model, frame) first; regions become bytes before they move.
    """
    # Sizes of made payloads are guessed far too low, so no side of these joins may be broadcast.
    plan = cyclic_join(strict_lookup(regions.select("model_id", "frame_idx").distinct(), rects.hint("merge")), backgrounds.select("model_id", "ring_idx").hint("merge"))
    looked = bgr_planes_to_pixels(regions).join(plan.hint("merge"), ["model_id", "frame_idx"]).join(backgrounds.hint("merge"), ["model_id", "ring_idx"])
    schema = T.StructType([looked.schema["model_id"], looked.schema["frame_idx"],
                           T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()),
                           T.StructField("rgb", T.BinaryType()), T.StructField("error", T.StringType())])

    def paste(out: np.ndarray, patch: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> bytes:
        left, top = max(x1, 0), max(y1, 0)
        right, bottom = min(x2, out.shape[1]), min(y2, out.shape[0])
        if right > left and bottom > top:
            if border:
                h, w = patch.shape[:2]
                box = resample_array(out[top:bottom, left:right], w + 2 * border, h + 2 * border)
                box[border:border + h, border:border + w] = patch
                patch = box
            out[top:bottom, left:right] = resample_array(patch, x2 - x1, y2 - y1)[top - y1:bottom - y1, left - x1:right - x1]
        return out.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ints = {c: rows.column(c).to_pylist() for c in ("h", "w", "bg_h", "bg_w", "x1", "y1", "x2", "y2")}
            bg, rgb, failed = rows.column("bg"), rows.column("rgb"), rows.column("error").is_valid().to_pylist()
            out = []
            for k in range(rows.num_rows):
                if failed[k] or not rgb[k].is_valid or not bg[k].is_valid:
                    out.append(None)
                    continue
                at = {c: v[k] for c, v in ints.items()}
                base = np.frombuffer(bg[k].as_buffer(), np.uint8).reshape(at["bg_h"], at["bg_w"], 3).copy()
                patch = np.frombuffer(rgb[k].as_buffer(), np.uint8).reshape(at["h"], at["w"], 3)
                out.append(paste(base, patch, *[at[c] for c in ("x1", "y1", "x2", "y2")]))
            yield pa.RecordBatch.from_arrays(
                [rows.column("model_id"), rows.column("frame_idx"), rows.column("bg_h").cast(pa.int32()), rows.column("bg_w").cast(pa.int32()),
                 pa.array(out, pa.binary()), rows.column("error")], names=["model_id", "frame_idx", "h", "w", "rgb", "error"])

    return looked.mapInArrow(run, schema)


# ---------------------------------------------------------------- picture quality

def gray(b: Column, g: Column, r: Column) -> Column:
    """Luma in 14-bit fixed point, rounded."""
    # 0.114, 0.587, 0.299 times 16384.
    total = b.cast("int") * 1868 + g.cast("int") * 9617 + r.cast("int") * 4899
    return F.shiftright(total + 8192, 14)


def tint_check(long: DataFrame) -> DataFrame:
    """Channel means, blue-tint class and whether R > G > B."""
    m = long.groupBy("frame_idx").agg(*[F.avg(c).alias(c) for c in "bgr"])
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    return m.withColumns({
        "tint": F.when((b > g + 20) & (b > r + 20), "strong").when(b > g + 10, "slight").otherwise("none"),
        "order": F.when(b > r, "blue").when((r > g) & (g > b), "normal").otherwise("unusual")})


def noise_of(g: np.ndarray) -> float:
    """Mean absolute difference from a 5×5 binomial blur with mirrored borders."""
    taps = np.array([1, 4, 6, 4, 1], dtype=np.float64) / 16  # Fixed values.
    p = np.pad(g.astype(np.float64), 2, mode="reflect")
    h, w = g.shape
    rows = sum(t * p[:, k:k + w] for k, t in enumerate(taps))
    blur = sum(t * rows[k:k + h] for k, t in enumerate(taps))
    return float(np.abs(g - blur).mean())


def gray_array(rgb: np.ndarray) -> np.ndarray:
    """:func:`gray` of [h][w][3] bytes."""
    return (rgb.astype(np.int32) @ np.array([4899, 9617, 1868], np.int32) + 8192) >> 14  # Fixed values, as in gray.


def noise_level(frames: DataFrame) -> DataFrame:
    """Noise of each frame row (frame_idx, h, w, rgb bytes) with its band; null without a picture."""
    @F.pandas_udf("double")
    def noise(rgb: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else noise_of(gray_array(np.frombuffer(v, np.uint8).reshape(a, b, 3)))
                          for v, a, b in zip(rgb, h, w)], dtype="float64")

    n = F.col("noise")
    return frames.select("frame_idx", noise("rgb", "h", "w").alias("noise")).withColumn(
        "band", F.when(n > 10, "high").when(n > 5, "moderate").when(n.isNotNull(), "low"))


def contrast_and_concentration(long: DataFrame) -> DataFrame:
    """Standard deviation over channels, and the largest share of one grey level."""
    # Sums by grey level first, then by frame: one pass over the pixels.
    total = (F.col("b") + F.col("g") + F.col("r")).cast("long")
    squares = sum((F.col(c).cast("long") * F.col(c) for c in "bgr"), F.lit(0).cast("long"))
    levels = long.groupBy("frame_idx", gray(F.col("b"), F.col("g"), F.col("r")).alias("level")).agg(
        F.count("*").alias("n"), F.sum(total).alias("t"), F.sum(squares).alias("q"))
    n = F.sum("n") * 3
    mean = F.sum("t") / n
    out = levels.groupBy("frame_idx").agg(F.sqrt(F.greatest(F.sum("q") / n - mean * mean, F.lit(0.0))).alias("std"),
                                          (F.max("n") * 100.0 / F.sum("n")).alias("top_percent"))
    s, p = F.col("std"), F.col("top_percent")
    return out.withColumns({
        "contrast": F.when(s < 10, "very low").when(s < 30, "low").otherwise("good"),
        "concentration": F.when(p > 50, "very concentrated").when(p > 20, "concentrated").otherwise("good")})
