"""Table schemas shared by readers, operators and tests."""

from pyspark.sql import types as T

SIGNAL_BLOCKS = T.StructType([
    T.StructField("clip_id", T.LongType()),
    T.StructField("block_idx", T.LongType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("samples", T.ArrayType(T.FloatType())),
])

SIGNAL_SAMPLES = T.StructType([
    T.StructField("clip_id", T.LongType()),
    T.StructField("sample_idx", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

MEL_FILTERS = T.StructType([
    T.StructField("mel", T.IntegerType()),
    T.StructField("bin", T.IntegerType()),
    T.StructField("w", T.DoubleType()),
])

LANDMARKS = T.StructType([
    T.StructField("model_id", T.StringType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("point_idx", T.IntegerType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
])

CROP_RECTS = T.StructType([
    T.StructField("model_id", T.StringType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("x1", T.IntegerType()),
    T.StructField("y1", T.IntegerType()),
    T.StructField("x2", T.IntegerType()),
    T.StructField("y2", T.IntegerType()),
])

MANIFEST = T.StructType([
    T.StructField("dataset_name", T.StringType()),
    T.StructField("package_version", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("source_video", T.StructType([
        T.StructField("processed_frames", T.LongType()),
        T.StructField("total_frames", T.LongType()),
    ])),
    T.StructField("videos", T.MapType(T.StringType(), T.StructType([
        T.StructField("video_file", T.StringType()),
        T.StructField("frame_count", T.LongType()),
        T.StructField("fps", T.IntegerType()),
    ]))),
])

MODEL_CATALOG = T.StructType([
    T.StructField("model_id", T.StringType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("background_dir", T.StringType()),
    T.StructField("crop_rects_path", T.StringType()),
    T.StructField("num_frames", T.IntegerType()),
    T.StructField("preload_model", T.BooleanType()),
    T.StructField("preload_background", T.BooleanType()),
    T.StructField("preferred_gpu", T.IntegerType()),
])

CHUNK_MESSAGE = T.StructType([
    T.StructField("stream_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("audio_data", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("sampleRate", T.IntegerType()),
    T.StructField("format", T.StringType()),
])
