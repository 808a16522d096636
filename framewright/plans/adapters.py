"""Driver tables as inputs, and the same mappings as SQL text.

Every index is derived from a dense key or from positions inside a text, so
nothing has to be ranked per group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.schemas import SIGNAL_BLOCKS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Files without a time zone read as TIMESTAMP_NTZ; the operators use session time.
    ntz = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over the session's shuffle partitions, at every size.

    The number is given, so that adaptive execution does not merge partitions whose rows are small but cost much work.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def div(a: Column, n: int) -> Column:
    """Integer quotient of a non-negative long."""
    return F.floor(a / F.lit(n)).cast("long")


BATCH = 1 << 20  # samples of one Arrow batch, about


def _levels(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all texts behind each other, and the number of each text's."""
    codes = [np.frombuffer(t.encode("utf-32-le"), dtype="<u4") for t in texts]
    flat = np.concatenate(codes).astype(np.int32) if codes else np.zeros(0, np.int32)
    return ((flat % 256 - 128) / np.float32(128)).astype(np.float32), np.array([len(c) for c in codes], np.int64)


def _text_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """(clip ids, texts) of about ``BATCH`` characters together, one text at least."""
    for rows in batches:
        clips, texts, size = [], [], 0
        for clip, text in zip(rows.column("clip_id").to_pylist(), rows.column("text")):
            clips.append(clip)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= BATCH:
                yield clips, texts
                clips, texts, size = [], [], 0
        if clips:
            yield clips, texts


def _clip_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.coalesce("text", F.lit("")).alias("text")), "clip_id")


def _within(counts: np.ndarray) -> np.ndarray:
    """0 .. count-1 for each count, behind each other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def text_blocks(spark: SparkSession, sf_dir: str, hop: int = 200) -> DataFrame:
    """``documents`` as signal blocks: a clip is a text, a sample is a character.

    Fixed mapping: code point modulo 256, centred, over 128 (exact in float32).  An empty or null text is one empty block.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for clips, texts in _text_groups(batches):
            level, n = _levels(texts)
            blocks = np.maximum(1, -(-n // hop))
            index = _within(blocks)
            size = np.minimum(hop, np.repeat(n, blocks) - index * hop).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(clips, np.int64), blocks)), pa.array(index), pa.array(size),
                 pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(level))],
                names=["clip_id", "block_idx", "n", "samples"])

    return _clip_texts(spark, sf_dir).mapInArrow(cut, SIGNAL_BLOCKS)


CLIPS_SQL = """clips AS (SELECT doc_id AS clip_id, list_transform(CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, '') END,
  lambda c: ((unicode(c) % 256) - 128) / 128.0::DOUBLE) AS s FROM documents)"""


def blocks_sql(hop: int = 200) -> str:
    return f"""{CLIPS_SQL},
blocks AS (SELECT clip_id, b AS block_idx, s[b*{hop}+1:b*{hop}+{hop}] AS x, s[b*{hop}] AS prev FROM
  (SELECT clip_id, s, unnest(range(greatest(1, (len(s) + {hop - 1}) // {hop}))) AS b FROM clips))"""


SAMPLES_SQL = f"""{CLIPS_SQL},
samples AS (SELECT clip_id, unnest(range(len(s))) AS sample_idx, unnest(s) AS value FROM clips)"""


STEP = 40


def step_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature steps (clip_id, frame_idx, vec[4]): sums of ten samples each, so a vector holds all 40 samples of its step."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for clips, texts in _text_groups(batches):
            level, n = _levels(texts)
            steps = -(-n // STEP)
            # Samples go where their step has room for STEP of them; missing ones stay 0, which the sums do not see.
            room = np.zeros(int(steps.sum()) * STEP)
            room[np.repeat((np.cumsum(steps) - steps) * STEP, n) + _within(n)] = level
            vec = room.reshape(-1, STEP // 4).sum(1).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(clips, np.int64), steps)), pa.array(_within(steps)),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, len(vec) + 1, 4, np.int32)), pa.array(vec))], names=["clip_id", "frame_idx", "vec"])

    return _clip_texts(spark, sf_dir).mapInArrow(sums, "clip_id long, frame_idx long, vec array<float>")


# One row per step with v = 1*vec[0] + 2*vec[1] + 3*vec[2] + 4*vec[3], exact in binary.  An empty text has no step.
STEPS_SQL = f"""{CLIPS_SQL},
steps AS (SELECT clip_id, frame_idx, q, q[1] + 2 * q[2] + 3 * q[3] + 4 * q[4] AS v FROM (SELECT clip_id, f AS frame_idx,
  [{", ".join(f"coalesce(list_sum(s[f*{STEP}+{k * STEP // 4 + 1}:f*{STEP}+{(k + 1) * STEP // 4}]), 0)" for k in range(4))}] AS q FROM
  (SELECT clip_id, s, unnest(range((len(s) + {STEP - 1}) // {STEP})) AS f FROM clips))),
lens AS (SELECT clip_id, count(*) AS n FROM steps GROUP BY clip_id)"""


def weigh(vec: Column) -> Column:
    """``sum (d+1)*vec[d]`` in double; exact for the step series."""
    return F.aggregate(
        F.transform(vec, lambda v, d: v.cast("double") * (d + 1)),
        F.lit(0.0), lambda a, b: a + b)


def _weighed(col: pa.Array, weights: np.ndarray | None) -> pa.Array:
    """Sum of each list's values times ``weights``, or times their places from 1 on; null for a null list."""
    null = col.is_null().to_numpy(zero_copy_only=False)
    size = np.where(null, 0, np.diff(col.offsets.to_numpy()))
    flat, at = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64), _within(size)
    out, some = np.zeros(len(size)), size > 0
    if len(flat):
        out[some] = np.add.reduceat(flat * (at + 1 if weights is None else weights[at]), (np.cumsum(size) - size)[some])
    return pa.array(out, mask=null)


@F.arrow_udf(T.DoubleType())
def weigh_flat(col: pa.Array) -> pa.Array:
    """:func:`weigh` for long flat arrays, over Arrow."""
    return _weighed(col, None)


@F.arrow_udf(T.DoubleType())
def total_flat(col: pa.Array) -> pa.Array:
    """Sum of each list, over Arrow."""
    return _weighed(col, np.ones(int(np.diff(col.offsets.to_numpy()).max(initial=0))))


def weigh_grid(*shape: int):
    """Function of a flattened grid of (up to) this shape: the sum of its values, each times its places from 1 on along all axes."""
    weights = np.ones(1)
    for n in shape:
        weights = np.multiply.outer(weights, np.arange(1, n + 1)).reshape(-1)

    @F.arrow_udf(T.DoubleType())
    def weighed(col: pa.Array) -> pa.Array:
        return _weighed(col, weights)

    return weighed


@F.pandas_udf(T.LongType())
def weigh_bytes(col: pd.Series) -> pd.Series:
    """``sum (i+1)*byte[i]`` of each binary value, read in place."""
    return pd.Series([None if v is None else int(np.frombuffer(v, np.uint8).astype(np.int64) @ np.arange(1, len(v) + 1)) for v in col], dtype="Int64")


FEATURE_SPAN = 50


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as feature rows: 50 consecutive vectors form a clip."""
    return table(spark, sf_dir, "embeddings").select(
        div(F.col("vec_id"), FEATURE_SPAN).alias("clip_id"),
        (F.col("vec_id") % FEATURE_SPAN).alias("frame_idx"),
        F.col("embedding").alias("feature"), "label", "vec_id")


FEATURES_SQL = f"""feats AS (SELECT vec_id // {FEATURE_SPAN} AS clip_id, vec_id % {FEATURE_SPAN} AS frame_idx,
  embedding AS feature, label, vec_id FROM embeddings)"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a serving log: type is the model, user modulo 4 the backend."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    return ev.select(
        F.col("event_id").alias("request_id"), "ts", F.col("event_type").alias("model_id"),
        F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("backend"),
        (k % 40).alias("batch_size"), (v * 0.125).alias("audio_ms"), (v * 0.5).alias("inference_ms"),
        (v * 0.25).alias("composite_ms"), v.alias("total_ms"), (k % 3).alias("gpu_id"),
        (v * 4).alias("model_load_ms"), (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
        (k.cast("long") * 1024).alias("bytes"), "user_id", k.alias("k"))


REQUEST_SQL = """req AS (SELECT event_id AS request_id, ts, event_type AS model_id,
  'b' || (user_id % 4)::VARCHAR AS backend, k % 40 AS batch_size, value*0.125::DOUBLE AS audio_ms,
  value*0.5::DOUBLE AS inference_ms, value*0.25::DOUBLE AS composite_ms, value AS total_ms, k % 3 AS gpu_id,
  value*4::DOUBLE AS model_load_ms, event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' THEN 'failed' END AS error, k::BIGINT*1024 AS bytes, user_id, k
  FROM (SELECT *, (props->>'$.k')::INT AS k FROM events))"""


def r(expr: str, digits: int = 6) -> str:
    """Rounded SQL expression without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0::DOUBLE)"


def rnd(col: Column, digits: int = 6) -> Column:
    return F.round(col, digits) + F.lit(0.0)
