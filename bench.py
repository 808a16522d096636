"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from framewright.operators import signal as S  # noqa: E402
from framewright.operators.raster import bgr_planes_to_pixels, resample_bilinear  # noqa: E402
from framewright.plans import registry  # noqa: E402
from framewright.plans.adapters import table, text_blocks  # noqa: E402
from framewright.session import local_session  # noqa: E402

HEADLINE = [
    "a02_pre_emphasis", "a08_frame_signal", "a17_mel_spectrogram", "a20_slice_for_batch",
    "w01_sliding_windows", "w03_clock_aligned_windows", "w07_context_windows_zero",
    "j01_cyclic_join", "j03_pingpong_join", "g01_landmarks_to_rect", "g09_nms", "g12_resample_bilinear",
    "g14_composite_frames", "m01_score_batches", "q02_tensor_diff", "q08_first_matches",
    "t01_model_stats", "t02_latency_summary", "t10_cache_hit_ratio", "r02_tumbling_stats",
    "r03_lookahead_context", "r05_gap_detect", "r10_content_dedup",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def pictures(spark, sf_dir: str) -> tuple[int, float]:
    """Planes of 320x320, one picture per supplier, to bytes and down to half their size; (source pixels, seconds)."""
    n = 3 * 320 * 320
    ring = F.lit([float(i % 256) / 255 for i in range(256)]).cast("array<float>")
    planes = table(spark, sf_dir, "supplier").repartition(spark.sparkContext.defaultParallelism * 2).select(
        F.col("s_suppkey").alias("frame_idx"), F.lit(320).alias("h"), F.lit(320).alias("w"), F.flatten(F.array_repeat(ring, n // 256)).alias("planes"))
    t0 = time.perf_counter()
    run(resample_bilinear(bgr_planes_to_pixels(planes), 160, 160))
    seconds = time.perf_counter() - t0
    return planes.count() * 320 * 320, seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    queries = registry.all_queries()
    run(queries["t01_model_stats"](spark, sf_dir))  # start the JVM and the Python workers
    run(queries["m01_score_batches"](spark, sf_dir))
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        run(queries[name](spark, sf_dir))
        timings[name] = round(time.perf_counter() - t0, 3)
    blocks = text_blocks(spark, sf_dir)
    samples = blocks.selectExpr("sum(n)").first()[0]
    t0 = time.perf_counter()
    run(S.mel_spectrogram(blocks))
    mel_s = time.perf_counter() - t0
    pixels, picture_s = pictures(spark, sf_dir)
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": Path(sf_dir).name,
        "mel": {"samples": int(samples), "seconds": round(mel_s, 3),
                "audio_seconds_per_second_at_16khz": round(samples / 16000 / mel_s, 1),
                "video_frames_per_second": round(samples / 640 / mel_s, 1)},
        "pictures_320": {"pictures": pixels // 320 ** 2, "seconds": round(picture_s, 3), "megapixels_per_second": round(pixels / 1e6 / picture_s, 1)},
        "cores": spark.sparkContext.defaultParallelism,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))


if __name__ == "__main__":
    main()
