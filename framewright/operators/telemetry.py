"""Analytics over ``request_log`` and related logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.segments import OrderedParts

STAGES = ["audio_ms", "inference_ms", "composite_ms"]


def _ratio(a: Column, b: Column) -> Column:
    """a/b, 0 when b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def model_stats(log: DataFrame, by: str = "model_id") -> DataFrame:
    """Requests, total and average time (0 when none), last use and memory."""
    out = log.groupBy(by).agg(
        F.count("*").alias("requests"), F.coalesce(F.sum("total_ms"), F.lit(0.0)).alias("total_ms"),
        F.max("ts").alias("last_used"), F.sum("bytes").alias("memory_bytes"))
    return out.withColumn("avg_ms", _ratio(F.col("total_ms"), F.col("requests")))


_SKETCH, _MARGIN = 10_000, 0.001  # sketch: rank error below n/_SKETCH; brackets reach _MARGIN to each side


def exact_quantiles(log: DataFrame, by: list[str], value: str, percents: list[float],
                    rule: str = "linear") -> DataFrame:
    """Exact percentiles per group of the values that are not null, one row per (group, percent).

    ``rank`` takes the item at ``int((n-1)*p/100)``; ``linear`` interpolates.  Two passes, for all percents at once.  A
    mergeable sketch gives each percent a bracket that surely holds its ranks (in groups too small for the margin the bracket
    is the whole group).  Then the values below each bracket are counted and only those inside, about 0.2 % of a group, are
    counted by value and ordered, over range parts.  A null group is a group.
    """
    rows = log.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    shares = [p / 100.0 for p in percents]
    probes = [min(1.0, max(0.0, q + d)) for q in shares for d in (-_MARGIN, _MARGIN)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                   F.percentile_approx("_v", probes, _SKETCH).alias("_q"))
    safe = F.col("_n") * (_MARGIN - 1.0 / _SKETCH) >= 2
    brackets = sketch.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], "_n", F.array(*[F.struct(
        F.lit(i).alias("i"), ((F.col("_n") - 1) * F.lit(q)).alias("pos"),
        F.when(safe, F.get("_q", 2 * i)).otherwise(F.col("_min")).alias("lo"),
        F.when(safe, F.get("_q", 2 * i + 1)).otherwise(F.col("_max")).alias("hi")) for i, q in enumerate(shares)]).alias("_w"))
    cond = F.lit(True)
    for i, b in enumerate(by):
        same = F.col(b).eqNullSafe(F.col(f"_b{i}"))
        cond = cond & same
    met = rows.join(brackets, cond)

    # Values below a bracket are counted as one null, which comes first in the order of the values inside.
    counts = met.select(*by, F.explode(F.transform(F.filter("_w", lambda w: F.col("_v") <= w["hi"]), lambda w: F.struct(
        w["i"].alias("i"), w["pos"].alias("pos"), F.when(F.col("_v") >= w["lo"], F.col("_v")).alias("v")))).alias("w")).groupBy(
        *by, F.col("w.i").alias("i"), F.col("w.v").alias("_v")).agg(F.count("*").alias("_c"), F.first("w.pos").alias("pos"))
    ranked = OrderedParts(counts, [*by, "i"], ["_v"]).running("_c", "upto").withColumn("from", F.col("upto") - F.col("_c"))
    lo = F.floor(F.col("pos")).cast("long")
    holds = lambda rank: (F.col("from") <= rank) & (rank < F.col("upto"))
    frac = F.max("pos") - F.floor(F.max("pos"))
    low, high = F.max(F.when(holds(lo), F.col("_v"))), F.max(F.when(holds(lo + 1), F.col("_v")))
    picked = ranked.where(holds(lo) | holds(lo + 1)).groupBy(*by, "i").agg(
        (low + F.when(frac > 0, (high - low) * frac).otherwise(F.lit(0.0)) if rule == "linear" else low).alias("value"))
    return picked.select(*by, F.get(F.array(*[F.lit(float(p)) for p in percents]), F.col("i")).alias("p"), "value")


def latency_summary(log: DataFrame, by: list[str], value: str = "total_ms", rule: str = "linear") -> DataFrame:
    """mean, median, population std, min, max, p95, p99 and fps = 1000/mean."""
    base = log.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    own = [F.col(b).alias(f"_o{i}") for i, b in enumerate(by)]
    middle = exact_quantiles(log, by, value, [50.0], "linear") if rule != "linear" else None
    tails = exact_quantiles(log, by, value, [50.0, 95.0, 99.0] if middle is None else [95.0, 99.0], rule)
    q = tails if middle is None else tails.unionByName(middle)
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    wide = q.groupBy(*by).agg(at(50.0).alias("median"), at(95.0).alias("p95"), at(99.0).alias("p99")).select(*own, "median", "p95", "p99")
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_o{i}"))
    return base.join(wide, same, "left").drop(*[f"_o{i}" for i in range(len(by))]).withColumn("fps", F.lit(1000.0) / F.col("mean"))


def approx_latency(log: DataFrame, by: list[str], value: str = "total_ms", accuracy: int = 10000) -> DataFrame:
    """Mergeable sketch percentiles, one pass."""
    return log.groupBy(*by).agg(F.percentile_approx(value, [0.5, 0.95, 0.99], accuracy).alias("q")).select(
        *by, F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))


def sketch_rank_errors(log: DataFrame, by: list[str], value: str = "total_ms", accuracy: int = 10000) -> DataFrame:
    """Whether each percentile of :func:`approx_latency` has a rank within ``n/accuracy`` of its own, by counting."""
    shares = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    found = approx_latency(log, by, value, accuracy).select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], *shares)
    cond = F.lit(True)
    for i, b in enumerate(by):
        cond = cond & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    met = log.where(F.col(value).isNotNull()).join(found, cond)
    n = F.count("*")
    return met.groupBy(*by).agg(*[
        ((F.count_if(F.col(value) < F.col(c)) <= F.lit(q) * n + n / accuracy) & (F.count_if(F.col(value) <= F.col(c)) >= F.lit(q) * n - n / accuracy)).alias(f"{c}_close")
        for c, q in shares.items()])


def warm_summary(log: DataFrame, by: str = "batch_size", order: tuple[str, ...] = ("ts", "request_id")) -> DataFrame:
    """Stage averages per batch size without its first (cold) request.

    The cold row is subtracted from the sums, so no ordering of the group is needed.
    """
    stages = [*STAGES, "total_ms"]
    first = F.min_by(F.struct(*stages), F.struct(*order))
    out = log.groupBy(by).agg(F.count("*").alias("_n"), first.alias("_cold"), *[F.sum(s).alias(s) for s in stages])
    n = F.col("_n") - 1
    out = out.filter(n > 0).select(by, n.alias("iterations"), *[((F.col(s) - F.col(f"_cold.{s}")) / n).alias(s) for s in stages])
    return out.withColumns({
        "ms_per_frame": _ratio(F.col("total_ms"), F.col(by)),
        "fps": _ratio(F.col(by) * 1000.0, F.col("total_ms"))})


def stage_breakdown(log: DataFrame, by: str = "model_id") -> DataFrame:
    """Sum of each stage and its share of all stages."""
    sums = log.groupBy(by).agg(*[F.sum(s).alias(s) for s in STAGES])
    total = sum((F.col(s) for s in STAGES), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("ms"), _ratio(F.col(s), total).alias("share")) for s in STAGES])
    return sums.select(by, F.explode(rows).alias("r")).select(by, "r.*")


def overhead(log: DataFrame, by: str, processing: Column) -> DataFrame:
    """Average total and processing time, their gap and share, mean size, outcomes."""
    ok = F.col("success")
    out = log.groupBy(by).agg(
        F.avg(F.when(ok, F.col("total_ms"))).alias("avg_total"), F.avg(F.when(ok, processing)).alias("avg_processing"),
        F.avg(F.when(ok, F.col("bytes"))).alias("avg_bytes"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    gap = F.col("avg_total") - F.col("avg_processing")
    return out.withColumns({"overhead_ms": gap, "overhead_pct": gap / F.col("avg_total") * 100})


def speedup(runs: DataFrame, group: str, variant: str, workers: str, ms: str, baseline: str) -> DataFrame:
    """Ratio of the baseline's mean time to each variant's, and parallel efficiency in percent; null in groups without a baseline."""
    means = runs.groupBy(group, variant, workers).agg(F.avg(ms).alias("mean_ms"))
    base = means.filter(F.col(variant) == baseline).groupBy(group).agg(F.min("mean_ms").alias("base_ms"))
    return means.join(base, group, "left").withColumn("speedup", F.col("base_ms") / F.col("mean_ms")).withColumn(
        "efficiency_pct", F.col("speedup") / F.col(workers) * 100)


def gpu_usage(models: DataFrame, gpus: int, memory_gb: int = 24) -> DataFrame:
    """Models and memory per GPU, idle GPUs included; models on other numbers or none are listed under theirs."""
    used = models.groupBy("gpu_id").agg(F.countDistinct("model_id").alias("models"), F.sum("bytes").alias("used"))
    ids = models.sparkSession.range(gpus).select(F.col("id").cast("int").alias("gpu_id"))
    every = ids.union(used.select(F.col("gpu_id").cast("int"))).distinct()
    return every.join(used, every["gpu_id"].eqNullSafe(used["gpu_id"]), "left").select(
        every["gpu_id"], F.coalesce("models", F.lit(0)).alias("models"), F.coalesce("used", F.lit(0)).alias("used_bytes"),
        F.lit(memory_gb * 1024 ** 3).cast("long").alias("total_bytes"))


def backend_health(log: DataFrame, order: tuple[str, ...] = ("ts", "request_id")) -> DataFrame:
    """Requests, errors, error rate, and health by the last outcome."""
    out = log.groupBy("backend").agg(
        F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("errors"),
        F.max_by("success", F.struct(*order)).alias("healthy"))
    return out.withColumn("error_rate", _ratio(F.col("errors"), F.col("requests")))


def health_summary(backends: DataFrame) -> DataFrame:
    """Healthy when any backend is; counts over all."""
    return backends.agg(
        F.coalesce(F.bool_or("healthy"), F.lit(False)).alias("healthy"), F.count_if("healthy").alias("healthy_backends"),
        F.count("*").alias("backends"), F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))


def cache_hit_ratio(events: DataFrame, by: str = "model_id") -> DataFrame:
    """hits/(hits+misses) per model and overall (null model), 0 when none."""
    out = events.rollup(by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
                                F.grouping(by).cast("boolean").alias("overall"))
    return out.withColumn("ratio", _ratio(F.col("hits"), F.col("hits") + F.col("misses")))


def eviction_candidates(stats: DataFrame, capacity: int, policy: str = "lfu", key: str = "model_id") -> DataFrame:
    """Entries beyond capacity, least used (``lfu``) or longest unused (``lru``) first."""
    value = "requests" if policy == "lfu" else "last_used"
    total = stats.agg(F.count("*").alias("_total")).withColumn("_one", F.lit(1))
    ranked = OrderedParts(stats.select(key, value), [], [value, key]).row_number("evict_rank").withColumn("_one", F.lit(1))
    # One total row joins by equality; its size is fixed.
    return ranked.join(F.broadcast(total), "_one").filter(
        F.col("evict_rank") <= F.col("_total") - capacity).drop("_total", "_one")


def sample_requests(log: DataFrame, n: int, number: str = "request_id") -> DataFrame:
    """Every n-th request by number; 0 keeps all."""
    return log if n == 0 else log.filter(F.pmod(F.col(number), F.lit(n)) == 0)


def cold_start_flag(log: DataFrame, limit_ms: float = 100.0) -> DataFrame:
    return log.withColumn("cold_start", F.col("model_load_ms") > F.lit(limit_ms))


def queue_metrics(log: DataFrame, worker: str = "gpu_id") -> DataFrame:
    """Jobs, mean queue, wait and inference times per worker."""
    return log.groupBy(worker).agg(
        F.count("*").alias("jobs"), F.avg("queue_ms").alias("avg_queue_ms"), F.max("queue_ms").alias("max_queue_ms"),
        F.avg("wait_ms").alias("avg_wait_ms"), F.avg("inference_ms").alias("avg_inference_ms"))


def memory_delta(probes: DataFrame, by: list[str]) -> DataFrame:
    """Memory after minus before, per operation; ``phase`` is before or after."""
    at = lambda p: F.max(F.when(F.col("phase") == p, F.col("bytes")))
    return probes.groupBy(*by).agg(at("before").alias("before"), at("after").alias("after")).withColumn(
        "delta", F.col("after") - F.col("before"))


def extraction_report(frames: DataFrame, videos: DataFrame, limit_mb: int = 500) -> DataFrame:
    """Frames, MB, average KB, frames/s and status per model.

    ``frames`` is (model_id, bytes); ``videos`` (model_id, video_bytes, elapsed_s, cached).
    """
    mb = lambda b: b / F.lit(1024.0 * 1024.0)
    size = frames.groupBy("model_id").agg(F.count("*").alias("num_frames"), F.sum("bytes").alias("_b"))
    big = mb(F.col("video_bytes")) > limit_mb
    out = videos.join(size, "model_id", "left").withColumn("num_frames", F.coalesce("num_frames", F.lit(0)))
    return out.select(
        "model_id", "num_frames", F.round(mb(F.coalesce("_b", F.lit(0))), 2).alias("size_mb"),
        F.round(_ratio(F.coalesce("_b", F.lit(0)) / 1024.0, F.col("num_frames")), 1).alias("avg_frame_kb"),
        F.round(F.when(F.col("cached"), F.lit(0.0)).otherwise(_ratio(F.col("num_frames"), F.col("elapsed_s"))), 1).alias("frames_per_sec"),
        "cached", F.when(big, F.concat(F.lit("above the limit: "), F.round(mb(F.col("video_bytes")), 1).cast("string"),
                                       F.lit(f" MB of {limit_mb} MB"))).alias("error"))


def cache_size_report(keys: DataFrame, key: str = "key") -> DataFrame:
    """Cached items per model from ``kind:model:id``."""
    part = F.split(key, ":", 3)
    return keys.filter(F.size(part) >= 2).groupBy(
        part[0].alias("kind"), part[1].alias("model_id")).agg(F.count("*").alias("items"))


def protocol_mix(log: DataFrame, by: list[str]) -> DataFrame:
    """Total, binary and JSON requests, binary percent, average time (0 when none)."""
    n = F.count("*")
    return log.groupBy(*by).agg(
        n.alias("total"), F.count_if("is_binary").alias("binary"), F.count_if(~F.col("is_binary")).alias("json"),
        (F.count_if("is_binary") * 100.0 / F.greatest(n, F.lit(1))).alias("binary_pct"),
        (F.coalesce(F.sum("total_ms"), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("avg_ms"))

