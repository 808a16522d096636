import json
import struct

import numpy as np
import pytest

from framewright.sources import readers as S
from framewright.sources.readers import parse_pcm_clips, rejected_rects


def wav(samples, rate=16000, channels=1, bits=16):
    body = np.asarray(samples, dtype="<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * 2 * channels, 2 * channels, bits)
    chunks = b"LIST" + struct.pack("<I", 4) + b"abcd" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_wav_corpus(spark, tmp):
    (tmp / "mono.wav").write_bytes(wav(range(450)))
    (tmp / "stereo.wav").write_bytes(wav([3, 4, -3, -4], channels=2))
    (tmp / "eight.wav").write_bytes(wav([1, 2], bits=8))
    (tmp / "bad.wav").write_bytes(b"nope")
    (tmp / "notes.txt").write_text("ignored")
    rows = S.read_pcm_clips(spark, str(tmp)).collect()
    by = lambda n: sorted((r for r in rows if r.clip_id.endswith(n)), key=lambda r: r.block_idx or 0)
    mono = by("mono.wav")
    assert [r.n for r in mono] == [200, 200, 50] and mono[1].samples[0] == pytest.approx(200 / 32768)
    assert [round(v * 32768) for v in by("stereo.wav")[0].samples] == [3, -3]
    assert by("eight.wav")[0].error == "8 bits and 1 channels; 16 bits in one or two channels are read"
    assert by("bad.wav")[0].error.startswith("no readable wave file")


def test_landmark_files(spark, tmp):
    (tmp / "12.lms").write_text("10.9 20\n-1.5 3\n")
    got = {(r.frame_idx, r.point_idx, r.x, r.y) for r in S.read_landmarks(spark, str(tmp)).collect()}
    assert got == {(12, 0, 10, 20), (12, 1, -1, 3)}


def test_rect_forms(spark, tmp):
    (tmp / "a").mkdir()
    (tmp / "b").mkdir()
    (tmp / "a" / "crop_rects.json").write_text("[[532,210,714,392],[532,211,714,393]]")
    (tmp / "b" / "crop_rectangles.json").write_text(json.dumps({"5": {"rect": [1, 2, 3, 4]}}))
    got = {tuple(r) for r in S.read_crop_rects(spark, str(tmp)).select("model_id", "frame_idx", "x1", "y1", "x2", "y2").collect()}
    assert got == {("a", 0, 532, 210, 714, 392), ("a", 1, 532, 211, 714, 393), ("b", 5, 1, 2, 3, 4)}


def test_frame_files(spark, tmp):
    for name in ("frame_0000.jpg", "frame_0.png", "frame_0001.jpg", "frame_1.jpg", "frame_0003.jpeg", "frame_002.png", "x.png"):
        (tmp / name).write_bytes(b"12345")
    from pyspark.sql import functions as F

    files = S.list_files(spark, str(tmp)).withColumn("model_id", F.lit("m"))
    best = S.frame_manifest(files)
    assert {(r.frame_idx, r.path.rsplit("/", 1)[1]) for r in best.collect()} == {
        (0, "frame_0.png"), (1, "frame_0001.jpg"), (3, "frame_0003.jpeg")}
    counts = spark.createDataFrame([("m", 5)], "model_id string, num_frames int")
    assert {r.frame_idx for r in S.missing_frames(best, counts, span=2).collect()} == {2, 4}


def test_manifest_fallbacks(spark, tmp):
    docs = [{"dataset_name": "a", "package_version": "", "version": "1.2", "videos": {"model_inputs": {"frame_count": 9}}},
            {"dataset_name": "b", "source_video": {"total_frames": 7}}]
    for i, d in enumerate(docs):
        (tmp / f"{i}.json").write_text(json.dumps(d, indent=1))
    got = {(r.dataset_name, r.version, r.frame_count) for r in S.read_manifests(spark, str(tmp)).collect()}
    assert got == {("a", "1.2", 9), ("b", "unknown", 7)}


def test_matrix_dump(spark, tmp):
    (tmp / "clip7.bin").write_bytes(struct.pack("<ii", 2, 3) + np.arange(6, dtype="<f4").tobytes())
    got = {(r.clip_id, r.frame_idx, tuple(r.feature)) for r in S.read_feature_dumps(spark, str(tmp)).collect()}
    assert got == {("clip7", 0, (0.0, 1.0, 2.0)), ("clip7", 1, (3.0, 4.0, 5.0))}


def _wav(rate, channels, samples, width=2, junk=b""):
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * width, channels * width, 8 * width) + junk
    body += b"data" + struct.pack("<I", len(samples)) + samples
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_odd_wave_files(spark):
    odd = b"note" + struct.pack("<I", 3) + b"abc\0"  # a chunk of odd size has a pad byte
    files = [("ok", _wav(8000, 1, struct.pack("<3h", 1, 2, 3), junk=odd)), ("none", _wav(8000, 1, b"")), ("four", _wav(8000, 4, b"\0" * 16)),
             ("eight", _wav(8000, 1, b"\0" * 4, 1)), ("cut", _wav(8000, 1, b"\0\0")[:20]), ("text", b"hello")]
    got = {r.clip_id: r for r in parse_pcm_clips(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert set(got) == {f for f, _ in files}
    assert got["ok"].n == 3 and got["ok"].samples == [1 / 32768, 2 / 32768, 3 / 32768] and got["ok"].error is None
    assert got["none"].n == 0 and got["none"].samples == [] and got["none"].error is None
    assert all(got[k].error for k in ("four", "eight", "cut", "text"))


def test_rejected_rects(spark):
    docs = spark.createDataFrame([(1, "[[1,2,3,4]]"), (2, "[]"), (3, ""), (4, "[[1,"), (5, '{"0":{"rect":[1,2,3,4]}}'), (6, None), (7, "{}")], "id long, value string")
    assert {r.id: r.reason for r in rejected_rects(docs).collect()} == {2: "no rects", 3: "empty", 4: "not readable", 6: "empty", 7: "no rects"}
