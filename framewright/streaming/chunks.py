"""Chunk streams: operators that work on a stream and on a table alike, and batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.segments import OrderedParts, halo_segments
from framewright.session import scratch_path
from framewright.streaming.run import VersionedTable

STREAM = "stream_id"
CHUNK = "chunk_idx"


def chunk_stream(messages: DataFrame, chunk_ms: int = 40) -> DataFrame:
    """Decode base64 PCM16 messages; the chunk number is the message time on the chunk clock."""
    data = F.coalesce("data", "audio_data")
    return messages.select(
        STREAM, F.floor(F.col("timestamp") / F.lit(chunk_ms)).cast("long").alias(CHUNK),
        F.timestamp_millis("timestamp").alias("event_ts"), F.unbase64(data).alias("pcm"),
        F.col("sampleRate").alias("sample_rate")).withColumn(
        "n_samples", F.floor(F.octet_length("pcm") / 2).cast("int"))


def number_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Chunk numbers by arrival order, from 0 per stream (batch form)."""
    return OrderedParts(chunks, [STREAM], order).row_number("_rn").withColumn(
        CHUNK, F.col("_rn") - 1).drop("_rn")


def number_chunks_stream(chunks: DataFrame, order: list[str], tag: str = "numbers") -> DataFrame:
    """Chunk numbers by arrival on a stream, from 0 per stream: triggers as they come, rows of a trigger by ``order``.

    How many chunks of each stream have come is a versioned table.  A trigger numbers its own rows, over range parts, so a busy
    stream is split, and adds the counts before it; both it and the new counts are written under the trigger's number, so a
    trigger that runs again gives the same numbers.  Runs to the end of the input.
    """
    spark = chunks.sparkSession
    base = scratch_path(spark, tag)
    counts = VersionedTable(spark, f"{base}/counts", [STREAM], chunks.select(STREAM, F.lit(0).cast("long").alias("n")).schema)

    def number(batch: DataFrame, at: int) -> None:
        seen = counts.current(before=at).select(F.col(STREAM).alias("_s"), F.col("n").alias("_before"))
        known = lambda rows: rows.join(seen, F.col(STREAM).eqNullSafe(F.col("_s")), "left").withColumn("_before", F.coalesce("_before", F.lit(0))).drop("_s")
        rows = known(OrderedParts(batch, [STREAM], order).row_number("_rn"))
        rows.withColumn(CHUNK, F.col("_rn") - 1 + F.col("_before")).drop("_rn", "_before").write.mode("overwrite").parquet(f"{base}/rows/_batch={at}")
        more = known(batch.groupBy(STREAM).agg(F.count("*").alias("_n")))
        counts.put(more.select(STREAM, (F.col("_n") + F.col("_before")).alias("n")), at)

    chunks.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(number).start().awaitTermination()
    return spark.read.schema(chunks.withColumn(CHUNK, F.lit(0).cast("long")).schema).parquet(f"{base}/rows").drop("_batch")


def tumbling_stats(df: DataFrame, width: str = "40 milliseconds", ts: str = "ts", value: str = "value",
                   watermark: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Count, min, max and sum in fixed windows of any width."""
    src = df.withWatermark(ts, watermark) if watermark else df
    return src.groupBy(F.window(ts, width).alias("w"), *(by or [STREAM])).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum")
    ).select(*(by or [STREAM]), F.col("w.start").alias("start"), "n", "min", "max", "sum")


def lookahead_context(chunks: DataFrame, value: str, before: int = 8, after: int = 8,
                      span: int = 64) -> DataFrame:
    """Frames whose chunks ``i-before .. i+after-1`` are all present, with the context (batch form).

    Of a chunk that arrived twice the smallest value counts.
    """
    segs = halo_segments(chunks.groupBy(STREAM, CHUNK).agg(F.min(value).alias(value)), F.col(value), span, before, after - 1, STREAM, CHUNK)
    index = F.map_from_entries(F.transform("rows", lambda r: F.struct(r["i"], r["v"])))
    core = F.filter(F.transform("rows", lambda r: r["i"]), lambda i: F.floor(i / span) == F.col("seg"))
    windows = F.transform(core, lambda i: F.struct(
        i.alias("i"), F.array(*[F.try_element_at("m", i + off) for off in range(-before, after)]).alias("context")))
    full = F.filter("w", lambda w: F.forall(w["context"], lambda v: v.isNotNull()))
    return segs.withColumn("m", index).withColumn("w", windows).select(
        STREAM, F.explode(full).alias("f")).select(STREAM, F.col("f.i").alias(CHUNK), "f.context")


def gap_detect(chunks: DataFrame, first: int = 0) -> DataFrame:
    """Last chunk of the unbroken run that starts at chunk ``first``; one before it if that chunk is missing.

    A run ends where the next chunk is missing, which is an anti join on the
    next index; no stream is ordered as a whole.
    """
    keys = chunks.select(STREAM, CHUNK).filter(F.col(CHUNK) >= first).distinct()
    follow = keys.select(STREAM, (F.col(CHUNK) - 1).alias(CHUNK))
    ends = keys.join(follow, [STREAM, CHUNK], "left_anti").groupBy(STREAM).agg(
        F.min(CHUNK).alias("run_end"), (F.count("*") - 1).alias("gaps"))
    starts = keys.groupBy(STREAM).agg(F.min(CHUNK).alias("low"))
    reached = F.when(F.col("low") == first, F.col("run_end")).otherwise(F.lit(first - 1).cast("long"))
    return starts.join(ends, STREAM).select(STREAM, F.lit(first).cast("long").alias("run_start"), reached.alias("run_end"), "gaps")


def playback_start(chunks: DataFrame, order: list[str], ts: str = "ts", fill: int = 20,
                   delay_ms: int = 380) -> DataFrame:
    """Time at which ``fill`` chunks have arrived, and playback after the delay.

    Each range part offers at most ``fill`` rows, so the final choice is bounded.
    """
    nth = OrderedParts(chunks.select(STREAM, *order), [STREAM], order).row_number("_rn").filter(F.col("_rn") == fill)
    return nth.select(STREAM, F.col(ts).alias("ready_ts"),
                      F.timestamp_micros(F.unix_micros(ts) + delay_ms * 1000).alias("start_ts"))


def status_of(fill: Column, critical: int = 3, low: int = 8, high: int = 25) -> Column:
    return F.when(fill <= critical, "critical").when(fill < low, "low").when(fill > high, "high").otherwise("optimal")


def buffer_status(events: DataFrame, order: list[str], delta: str, target: int = 15) -> DataFrame:
    """Fill after each event (produced minus consumed), its status and percent of target."""
    run = OrderedParts(events.select(STREAM, *order, delta), [STREAM], order).running(delta, "fill", "sum")
    return run.withColumns({"status": status_of(F.col("fill")), "percent": F.col("fill") / F.lit(target) * 100})


def bounded_history(chunks: DataFrame, n: int = 3000) -> DataFrame:
    """Latest n chunks per stream (batch form)."""
    keyed = chunks.withColumn("_neg", -F.col(CHUNK))
    return OrderedParts(keyed, [STREAM], ["_neg"]).row_number("_rn").filter(F.col("_rn") <= n).drop("_neg", "_rn")


def ttl_cache_keys(sets: DataFrame, key: str, ts: str, unique: str, ttl_s: int) -> DataFrame:
    """Whether the key was still valid when it was set again (batch form)."""
    prev = OrderedParts(sets.select(key, ts, unique), [key], [ts, unique]).lag(ts, "prev_ts")
    age = F.unix_micros(ts) - F.unix_micros("prev_ts")
    return prev.withColumn("valid", F.coalesce(age <= ttl_s * 1_000_000, F.lit(False)))


def content_dedup(df: DataFrame, content: str, keep: list[str], ts: str | None = None,
                  watermark: str | None = None) -> DataFrame:
    """One row per content (MD5); on a stream, within the watermark."""
    hashed = df.withColumn("content_md5", F.md5(F.col(content).cast("binary")))
    if ts and watermark:
        return hashed.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["content_md5"]).select("content_md5", *keep)
    return hashed.groupBy("content_md5").agg(*[F.min(c).alias(c) for c in keep], F.count("*").alias("copies"))


def session_activity(df: DataFrame, gap_ms: int, ts: str = "ts", by: str = STREAM,
                     watermark: str | None = None) -> DataFrame:
    """Runs of activity separated by at least the gap.

    A stream uses a session window.  A table is first counted into buckets one
    gap wide (rows of a bucket always share a session); the buckets are then
    linked in order, so a busy key is reduced before anything is ordered.
    """
    if df.isStreaming:
        src = df.withWatermark(ts, watermark) if watermark else df
        return src.groupBy(F.session_window(ts, f"{gap_ms} milliseconds").alias("w"), by).agg(
            F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    us, gap = F.unix_micros(ts), gap_ms * 1000
    buckets = df.groupBy(by, F.floor(us / F.lit(gap)).cast("long").alias("_b")).agg(
        F.min(us).alias("_lo"), F.max(us).alias("_hi"), F.count("*").alias("_n"))
    linked = OrderedParts(buckets, [by], ["_b"]).lag("_hi", "_prev").withColumn(
        "_new", F.when(F.col("_prev").isNull() | (F.col("_lo") >= F.col("_prev") + gap), 1).otherwise(0))
    numbered = OrderedParts(linked, [by], ["_b"]).running("_new", "_session", "sum")
    return numbered.groupBy(by, "_session").agg(
        F.timestamp_micros(F.min("_lo")).alias("start"), F.timestamp_micros(F.max("_hi") + gap).alias("end"),
        F.sum("_n").alias("n")).drop("_session")


def fps_counter(df: DataFrame, ts: str = "ts", by: str = STREAM, watermark: str | None = None,
                width: str = "1 second") -> DataFrame:
    """Frames per interval."""
    src = df.withWatermark(ts, watermark) if watermark else df
    return src.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("frames")).select(
        by, F.col("w.start").alias("start"), "frames")


def generation_rate(batches: DataFrame, ts: str, unique: str, count: str) -> DataFrame:
    """Frames of a batch over the seconds since the previous batch (batch form)."""
    prev = OrderedParts(batches.select(STREAM, ts, unique, count), [STREAM], [ts, unique]).lag(ts, "prev_ts")
    seconds = (F.unix_micros(ts) - F.unix_micros("prev_ts")) / F.lit(1e6)
    return prev.withColumn("fps", F.when(seconds > 0, F.col(count) / seconds))


def periodic_stats(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Running totals; a stream of them is published on a clock by ``run.publish``."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak"))
