"""Sinks for frames, tensors and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.compare import tensor_stats


def write_tensors(df: DataFrame, path: str, key: str = "model_id", idx: str = "frame_idx", rows_per_file: int = 100_000) -> DataFrame:
    """One record per frame, partitioned by ``key`` and ordered by frame inside files.

    Rows are first dealt by key and stripe of ``rows_per_file`` frame numbers, so a key has one file a stripe however many
    tasks wrote, and a large key is written by many tasks.  Writes ``<path>/frames`` and per-frame statistics to
    ``<path>/stats``; returns the statistics as read back.
    """
    stripe = F.floor(F.col(idx) / F.lit(rows_per_file)).cast("long")
    df.repartition(F.col(key), stripe).sortWithinPartitions(key, idx).write.partitionBy(key).parquet(f"{path}/frames")
    spark = df.sparkSession
    stored = spark.read.schema(df.schema).parquet(f"{path}/frames")
    tensor_stats(stored, [key, idx]).write.parquet(f"{path}/stats")
    return spark.read.parquet(f"{path}/stats")


def write_report(summary: DataFrame, path: str) -> None:
    """Summary rows as JSON lines."""
    summary.write.json(path)
