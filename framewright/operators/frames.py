"""Frame-key joins and selection over (model_id, frame_idx) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.segments import OrderedParts, salted_attach

MODEL = "model_id"
IDX = "frame_idx"


def ring_sizes(ring: DataFrame) -> DataFrame:
    return ring.groupBy(MODEL).agg((F.max("ring_idx") + 1).alias("ring_size"))


def _ring_join(frames: DataFrame, ring: DataFrame, position) -> DataFrame:
    keyed = salted_attach(frames, ring_sizes(ring), [MODEL], [IDX])
    return keyed.withColumn("ring_idx", position(F.col("ring_size"))).drop("ring_size") \
        .join(ring, [MODEL, "ring_idx"])


def cyclic_join(frames: DataFrame, ring: DataFrame) -> DataFrame:
    """Ring row ``frame_idx mod ring_size`` of the same model."""
    return _ring_join(frames, ring, lambda n: F.pmod(F.col(IDX), n))


def pingpong_index(i: Column, n: Column, start: int = 0) -> Column:
    """Forward and back over ``0..n-1`` starting at 1; a ring of one stays at 0."""
    top = n - 1
    p = F.pmod(i + 1, F.greatest(top * 2, F.lit(1)))
    return F.when(n <= 1, F.lit(0).cast("long")).when(p <= top, p).otherwise(top * 2 - p) + start


def pingpong_join(frames: DataFrame, ring: DataFrame, start_frame: int = 0) -> DataFrame:
    """Ring row on a back-and-forth walk; ``ring_idx`` counts from ``start_frame``."""
    moved = ring.withColumn("ring_idx", F.col("ring_idx") - start_frame)
    return _ring_join(frames, moved, lambda n: pingpong_index(F.col(IDX), n)) \
        .withColumn("ring_idx", F.col("ring_idx") + start_frame)


def strict_lookup(frames: DataFrame, rects: DataFrame) -> DataFrame:
    """Rect of each frame, or an error for a frame without one."""
    found = rects.withColumn("_hit", F.lit(True))
    return frames.join(found, [MODEL, IDX], "left").withColumn(
        "error", F.when(F.col("_hit").isNull(), F.concat(
            F.lit("no crop rect for frame "), F.col(IDX).cast("string")))).drop("_hit")


def batch_status(looked_up: DataFrame, batch_cols: list[str]) -> DataFrame:
    """A batch fails when any frame does; the first error is reported."""
    bad = F.col("error").isNotNull()
    return looked_up.groupBy(*batch_cols).agg(
        (~F.bool_or(bad)).alias("success"), F.count_if(bad).alias("failed"),
        F.min_by("error", F.when(bad, F.col(IDX))).alias("first_error"))


def align_modalities(images: DataFrame, landmarks: DataFrame, contexts: DataFrame,
                     features: DataFrame) -> DataFrame:
    """Training rows: image i, landmarks i and the context window at i, for i < features - 1."""
    length = features.groupBy(MODEL).agg(F.max(IDX).alias("_limit"))
    rows = images.join(landmarks, [MODEL, IDX]).join(contexts, [MODEL, IDX])
    return salted_attach(rows, length, [MODEL], [IDX]).filter(F.col(IDX) < F.col("_limit")).drop("_limit")


def hash_order(seed: int, *cols: str) -> Column:
    """60 reproducible random bits per row."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def exemplar_pairs(frames: DataFrame, seed: int = 0) -> DataFrame:
    """Each row with a random row of its model (``exemplar_idx``); same seed, same pairs."""
    sizes = frames.groupBy(MODEL).agg((F.max(IDX) + 1).alias("_n"))
    keyed = salted_attach(frames, sizes, [MODEL], [IDX]).withColumn(
        "exemplar_idx", F.pmod(hash_order(seed, MODEL, IDX), F.col("_n"))).drop("_n")
    other = frames.select(MODEL, F.col(IDX).alias("exemplar_idx"),
                          *[F.col(c).alias(f"exemplar_{c}") for c in frames.columns if c not in (MODEL, IDX)])
    return keyed.join(other, [MODEL, "exemplar_idx"])


def lookup_with_default(frames: DataFrame, rects: DataFrame, bounds_only: bool = False,
                        half: int = 164) -> DataFrame:
    """Rect of each frame; without one a centred square, or a fixed corner square."""
    if bounds_only:
        default = {"x1": F.lit(0), "y1": F.lit(0), "x2": F.lit(2 * half), "y2": F.lit(2 * half)}
    else:
        cx, cy = F.floor(F.col("width") / 2), F.floor(F.col("height") / 2)
        default = {"x1": cx - half, "y1": cy - half, "x2": cx + half, "y2": cy + half}
    joined = frames.join(rects, [MODEL, IDX], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), v.cast("int")) for c, v in default.items()})


def clamp_into_frame(boxes: DataFrame) -> DataFrame:
    """Shift x1,y1,x2,y2 inside width × height, size kept."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    x1 = F.greatest(F.lit(0), F.least(F.col("x1"), F.col("width") - w))
    y1 = F.greatest(F.lit(0), F.least(F.col("y1"), F.col("height") - h))
    return boxes.withColumns({"x1": x1, "y1": y1, "x2": x1 + w, "y2": y1 + h})


def playback_index(elapsed_ms: Column, frame_ms: int = 40, ring: int | None = None) -> Column:
    """Frame shown at a playback time, on a ring when given."""
    idx = F.floor(elapsed_ms / F.lit(frame_ms)).cast("long")
    return F.pmod(idx, F.lit(ring)) if ring else idx


def playback_lookup(events: DataFrame, frames: DataFrame, stream: str = "stream_id",
                    frame_ms: int = 40, ring: int | None = None) -> DataFrame:
    """Events with the frame at their playback index, null when it is not there."""
    keyed = events.withColumn(IDX, playback_index(F.col("elapsed_ms"), frame_ms, ring))
    return keyed.join(frames, [stream, IDX], "left")


def playback_latest(events: DataFrame, frames: DataFrame, stream: str, ts: str, event_id: str,
                    frame_value: str, bucket_s: int = 3600) -> DataFrame:
    """Events with the latest frame available at their time (as-of, ties see the frame of highest value).

    Both sides meet by (stream, time bucket), so a busy stream spreads and nothing is ordered beyond a bucket.  A bucket also
    gets one row with the last frame before it, found among the buckets' own last frames.  Events of a stream without a frame
    so far have null; rows without a time see no frame and are none.
    """
    slot = F.floor(F.unix_micros(ts) / F.lit(bucket_s * 1_000_000)).cast("long")
    kind = frames.schema[frame_value].dataType
    asked = events.select(stream, slot.alias("_slot"), ts, F.lit(2).alias("_kind"), F.col(event_id).alias("_id"), F.lit(None).cast(kind).alias("_v"))
    shown = frames.where(F.col(ts).isNotNull()).select(stream, slot.alias("_slot"), ts, F.lit(1).alias("_kind"), F.lit(None).cast(events.schema[event_id].dataType).alias("_id"),
                                                       F.col(frame_value).alias("_v"))
    # The last frame of every bucket that has any row, and from these the last frame before each bucket.
    ends = asked.select(stream, "_slot", ts, "_v").unionByName(shown.select(stream, "_slot", ts, "_v")).groupBy(stream, "_slot").agg(
        F.max(F.when(F.col("_v").isNotNull(), F.struct(ts, "_v"))).alias("_end"))
    carried = OrderedParts(ends, [stream], ["_slot"]).running("_end", "_before", "last", inclusive=False).where("_before is not null").select(
        stream, "_slot", F.col(f"_before.{ts}").alias(ts), F.lit(0).alias("_kind"), F.lit(None).cast(events.schema[event_id].dataType).alias("_id"), F.col("_before._v").alias("_v"))
    inside = Window.partitionBy(stream, "_slot").orderBy(F.col(ts).asc_nulls_first(), "_kind", F.col("_v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0)
    both = asked.unionByName(shown).unionByName(carried)
    return both.withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).where("_kind = 2").select(
        stream, ts, F.col("_id").alias(event_id), F.col("_v").alias(frame_value))


def catalog_with_stats(catalog: DataFrame, stats: DataFrame, key: str = MODEL) -> DataFrame:
    """Every configured entry, its statistics when loaded."""
    return catalog.join(stats.withColumn("_loaded", F.lit(True)), key, "left").withColumn(
        "loaded", F.coalesce("_loaded", F.lit(False))).drop("_loaded")


def list_only_unready(ready: DataFrame, archived: DataFrame, key: str = MODEL) -> DataFrame:
    """Ready entries, then archived ones that are not ready."""
    waiting = archived.select(key).join(ready.select(key), key, "left_anti")
    return ready.select(key, F.lit("ready").alias("status")).unionByName(
        waiting.select(key, F.lit("archived").alias("status")))


def completeness(files: DataFrame, required: list[str], key: str = MODEL, name: str = "file") -> DataFrame:
    """A package is ready only if it holds every required file; else what is missing."""
    need = F.array(*[F.lit(f) for f in required])
    return files.groupBy(key).agg(
        F.collect_set(F.when(F.col(name).isin(required), F.col(name))).alias("_have")).select(
        key, F.array_sort(F.array_except(need, "_have")).alias("missing")).withColumn(
        "ready", F.size("missing") == 0)


def latest_checkpoint(files: DataFrame, key: str = MODEL, path: str = "path") -> DataFrame:
    """Path with the highest integer file stem; other names are ignored."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1).try_cast("long")
    return files.withColumn("_stem", stem).filter(F.col("_stem").isNotNull()).groupBy(key).agg(
        F.max_by(path, "_stem").alias(path), F.max("_stem").alias("step"))


def uncached(frames: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Frames that are not materialised yet."""
    return frames.join(cache.select(*keys), keys, "left_anti")


def epoch_batches(rows: DataFrame, unique: str, batch: int, seed: int = 0) -> DataFrame:
    """Shuffled order with batch ids over the whole set; the last batch may be short."""
    keyed = rows.withColumn("_order", hash_order(seed, unique))
    numbered = OrderedParts(keyed, [], ["_order", unique]).row_number("_rn")
    return numbered.select(
        *rows.columns, F.floor((F.col("_rn") - 1) / F.lit(batch)).cast("long").alias("batch_id"),
        ((F.col("_rn") - 1) % batch).alias("batch_pos"))
