"""Readers for clips, landmarks, rects, manifests, features and chunk messages."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.binary import bytes_to_floats, matrix_from_bytes
from framewright.schemas import CHUNK_MESSAGE, MANIFEST

_CLIP_SCHEMA = ("clip_id string, sample_rate int, block_idx long, n int, samples array<float>, error string")


def _pcm(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono int16 samples of a RIFF/WAVE file; ValueError says why there are none."""
    try:
        # Recorders that stream leave the total size wrong; the file's own length is what counts.
        with wave.open(io.BytesIO(data[:4] + max(0, len(data) - 8).to_bytes(4, "little") + data[8:])) as f:
            rate, width, channels = f.getframerate(), f.getsampwidth(), f.getnchannels()
            frames = f.readframes(f.getnframes())
    except (wave.Error, EOFError) as e:
        raise ValueError(f"no readable wave file: {e or 'it ends too soon'}") from e
    if width != 2 or channels > 2:
        raise ValueError(f"{8 * width} bits and {channels} channels; 16 bits in one or two channels are read")
    whole = len(frames) // (2 * channels) * channels
    pcm = np.frombuffer(frames, "<i2", whole).reshape(-1, channels).astype(np.int32)
    return rate, np.trunc(pcm.sum(axis=1) / channels).astype(np.int16)


def parse_pcm_clips(files: DataFrame, hop: int = 200) -> DataFrame:
    """(path, content) rows to blocks of ``hop`` float samples; a bad file is one error row, one without samples an empty block.

    Batches hold about a million samples, so a long file never becomes one batch.
    """
    names = ["clip_id", "sample_rate", "block_idx", "n", "samples", "error"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float32()), pa.string()]
    step = max(1, 2 ** 20 // hop)

    def batch(path: str, rate: int, first: int, x: np.ndarray) -> pa.RecordBatch:
        m = max(1, -(-len(x) // hop))
        ends = np.minimum(np.arange(m + 1) * hop, len(x)).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array([path] * m, pa.string()), pa.array([rate] * m, pa.int32()), pa.array(np.arange(first, first + m)),
            pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(x)), pa.nulls(m, pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, content in zip(rows.column("path"), rows.column("content")):
                try:
                    rate, pcm = _pcm(content.as_py())
                except ValueError as e:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip([path.as_py(), None, None, None, None, str(e)], types)], names=names)
                    continue
                for first in range(0, max(1, -(-len(pcm) // hop)), step):
                    part = pcm[first * hop:(first + step) * hop]
                    yield batch(path.as_py(), rate, first, (part / np.float32(32768)).astype(np.float32))

    return files.select("path", "content").mapInArrow(run, _CLIP_SCHEMA)


def read_pcm_clips(spark: SparkSession, path: str, hop: int = 200) -> DataFrame:
    """WAV corpus to signal blocks: 16-bit, stereo averaged with integers, over 32768."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return parse_pcm_clips(files, hop)


def read_landmarks(spark: SparkSession, path: str, frame_pattern: str = r"(\d+)\.lms$",
                   model_pattern: str | None = None, packed: bool = False) -> DataFrame:
    """One text file per frame, one ``x y`` line per point; floats truncated to int.

    The frame and model come from the file path by the given patterns.  ``packed`` says that ``path`` is Parquet whose rows
    (path, value) are such files, which spares a large set the cost of opening each.
    """
    if packed:
        files = spark.read.schema("path string, value string").parquet(path)
    else:
        files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return parse_landmarks(files, frame_pattern, model_pattern)


def parse_landmarks(files: DataFrame, frame_pattern: str = r"(\d+)\.lms$", model_pattern: str | None = None) -> DataFrame:
    """The points of (path, value) rows that are landmark files."""
    name = F.col("path")
    model = F.regexp_extract(name, model_pattern, 1) if model_pattern else F.lit("default")
    lines = F.filter(F.split("value", r"\r?\n"), lambda v: F.trim(v) != "")
    points = files.select(model.alias("model_id"), F.regexp_extract(name, frame_pattern, 1).cast("long").alias("frame_idx"),
                          F.posexplode(lines).alias("point_idx", "line"))
    at = lambda i: F.split(F.trim("line"), " +")[i].cast("double").cast("int")
    return points.select("model_id", "frame_idx", "point_idx", at(0).alias("x"), at(1).alias("y"))


def rects_from_json(docs: DataFrame, text: str = "value") -> DataFrame:
    """List form ``[[x1,y1,x2,y2],…]`` and keyed form ``{"<frame>":{"rect":[…]}}`` to one schema."""
    box = lambda r: [F.get(r, F.lit(i)).cast("int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    keyed = F.ltrim(F.col(text)).startswith("{")
    rest = [c for c in docs.columns if c != text]
    as_list = docs.filter(~keyed).select(
        *rest, F.posexplode(F.from_json(text, "array<array<double>>")).alias("frame_idx", "r"))
    as_map = docs.filter(keyed).select(
        *rest, F.explode(F.from_json(text, "map<string, struct<rect: array<double>>>")).alias("frame_idx", "s"))
    return as_list.select(*rest, F.col("frame_idx").cast("long").alias("frame_idx"), *box(F.col("r"))).unionByName(
        as_map.select(*rest, F.col("frame_idx").cast("long").alias("frame_idx"), *box(F.col("s.rect"))))


def rejected_rects(docs: DataFrame, text: str = "value") -> DataFrame:
    """Texts that :func:`rects_from_json` takes no rect from, with the reason."""
    keyed = F.ltrim(F.col(text)).startswith("{")
    n = F.when(keyed, F.size(F.from_json(text, "map<string, struct<rect: array<double>>>"))).otherwise(F.size(F.from_json(text, "array<array<double>>")))
    reason = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(n.isNull(), "not readable").when(n <= 0, "no rects")
    return docs.withColumn("reason", reason).filter("reason is not null")


def read_crop_rects(spark: SparkSession, path: str, model_pattern: str = r"([^/]+)/[^/]*$") -> DataFrame:
    """Crop rect files of both forms; the model comes from the path."""
    docs = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rects_from_json(docs.select(F.regexp_extract(F.input_file_name(), model_pattern, 1).alias("model_id"), "value"))


def manifest_columns(docs: DataFrame) -> DataFrame:
    """Version and frame count with their fallbacks."""
    empty_as_null = lambda c: F.nullif(F.col(c), F.lit(""))
    count = F.when(F.try_element_at("videos", F.lit("model_inputs")).isNotNull(),
                   F.try_element_at("videos", F.lit("model_inputs"))["frame_count"]).otherwise(
        F.coalesce("source_video.processed_frames", "source_video.total_frames"))
    return docs.select("dataset_name", F.coalesce(empty_as_null("package_version"), "version", F.lit("unknown")).alias("version"),
                       count.alias("frame_count"), "videos")


def read_manifests(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Package JSON files, one object per file; ``packed`` ones hold an object per line."""
    docs = spark.read.schema(MANIFEST).option("multiLine", str(not packed).lower()).option("recursiveFileLookup", "true").json(path)
    return manifest_columns(docs)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and size of every file; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def frame_manifest(files: DataFrame, key: str = "model_id") -> DataFrame:
    """Best file per frame: png, jpg, jpeg in that order, then padded before plain names."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    digits, ext = F.regexp_extract(name, r"^frame_(\d+)\.", 1), F.regexp_extract(name, r"\.(png|jpg|jpeg)$", 1)
    idx = digits.try_cast("long")
    padded = (digits == F.lpad(idx.cast("string"), 4, "0")) | ((F.length(digits) > 4) & (digits == idx.cast("string")))
    plain = digits == idx.cast("string")
    rank = F.array_position(F.array(F.lit("png"), F.lit("jpg"), F.lit("jpeg")), ext) * 2 + F.when(padded, 0).otherwise(1)
    return files.withColumns({"frame_idx": idx, "ext": ext, "_rank": rank}).filter(
        F.col("frame_idx").isNotNull() & (F.col("ext") != "") & (padded | plain)).groupBy(key, "frame_idx").agg(
        F.min_by(F.struct("path", "ext"), F.struct("_rank", "path")).alias("f")).select(key, "frame_idx", "f.*")


def missing_frames(manifest: DataFrame, counts: DataFrame, key: str = "model_id", span: int = 4096) -> DataFrame:
    """Indexes below ``num_frames`` that have no file; ``counts`` is (key, num_frames).

    Wanted indexes are generated in stretches of ``span``, so a long video does
    not become one row's array.
    """
    starts = counts.filter("num_frames > 0").withColumn("_s", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("num_frames").cast("long") - 1, F.lit(span).cast("long"))))
    wanted = starts.select(key, F.explode(F.sequence(
        F.col("_s"), F.least(F.col("_s") + span, F.col("num_frames").cast("long")) - 1)).alias("frame_idx"))
    return wanted.join(manifest.select(key, "frame_idx"), [key, "frame_idx"], "left_anti")


def read_feature_table(spark: SparkSession, path: str, clip: Column | None = None, idx: str = "frame_idx",
                       feature: str = "feature") -> DataFrame:
    """Parquet features keyed by frame, cast to float32; a column stored as float32 bytes is unpacked."""
    df = spark.read.parquet(path)
    raw = isinstance(df.schema[feature].dataType, T.BinaryType)
    vec = bytes_to_floats(feature) if raw else F.col(feature).cast("array<float>")
    return df.select((clip if clip is not None else F.col("clip_id")).alias("clip_id"), F.col(idx).cast("long").alias("frame_idx"),
                     vec.alias("feature"))


def read_feature_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Matrix dumps (int32 rows, cols, float32 values), one feature row per matrix row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    m = files.select(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("clip_id"), matrix_from_bytes("content").alias("m"))
    rows = F.transform(F.sequence(F.lit(0), F.col("m.rows") - 1), lambda i: F.struct(
        i.cast("long").alias("frame_idx"), F.slice(F.col("m.values"), i * F.col("m.cols") + 1, F.col("m.cols")).alias("feature")))
    return m.filter("m.rows > 0").select("clip_id", F.explode(rows).alias("r")).select("clip_id", "r.*")


def read_chunk_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON chunk messages as a stream."""
    reader = spark.readStream.schema(CHUNK_MESSAGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def parse_chunk_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """The same messages out of a text or Kafka value column."""
    return raw.select(F.from_json(F.col(value).cast("string"), CHUNK_MESSAGE).alias("m")).select("m.*")


_PATHS = ("model_path", "background_dir", "crop_rects_path")


def model_catalog(rows: DataFrame, root: str = "", default_frames: int = 0) -> DataFrame:
    """Config rows with defaults; relative paths are put under ``root``."""
    def resolve(c: str) -> Column:
        p = F.col(c)
        keep = p.startswith("/") if c == "model_path" else (p.isNull() | (p == "") | p.startswith("/"))
        return F.when(keep, p).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), p)) if root else p

    out = rows.withColumns({c: resolve(c) for c in _PATHS if c in rows.columns})
    defaults = {"num_frames": F.lit(default_frames), "preload_model": F.lit(False), "preload_background": F.lit(False),
                "preferred_gpu": F.lit(0)}
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items() if c in rows.columns})
