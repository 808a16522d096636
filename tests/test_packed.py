"""Sets of small files packed into a few large ones."""

from pathlib import Path

import pytest

from framewright.plans import registry
from framewright.plans import source_queries
from framewright.sources import readers as S


def test_packed_landmarks_equal_loose_files(spark, tmp):
    loose = {"m1/3.lms": "1.9 2\n\n3 4.5\n", "m1/12.lms": "", "m2/3.lms": "  7 -8.9\r\n9 10"}
    for name, text in loose.items():
        (tmp / "loose" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp / "loose" / name).write_bytes(text.encode())
    spark.createDataFrame([(f"x/{n}", t) for n, t in loose.items()], "path string, value string").write.parquet(str(tmp / "packed"))
    rows = [{tuple(r) for r in S.read_landmarks(spark, str(tmp / d), model_pattern=r"([^/]+)/[^/]*$", packed=p).collect()} for d, p in (("loose", False), ("packed", True))]
    assert rows[0] == rows[1] == {("m1", 3, 0, 1, 2), ("m1", 3, 1, 3, 4), ("m2", 3, 0, 7, -8), ("m2", 3, 1, 9, 10)}


def test_packed_manifests_equal_loose_files(spark, tmp):
    texts = ['{"dataset_name": "a", "version": "1", "source_video": {"total_frames": 5}}', '{"dataset_name": "b", "videos": {"model_inputs": {"frame_count": 7}}}']
    for i, text in enumerate(texts):
        (tmp / "loose" / str(i)).mkdir(parents=True)
        (tmp / "loose" / str(i) / "p.json").write_text(text.replace(", ", ",\n"))
    (tmp / "packed").mkdir()
    (tmp / "packed" / "all.json").write_text("\n".join(texts))
    rows = [{(r.dataset_name, r.version, r.frame_count) for r in S.read_manifests(spark, str(tmp / d), packed=p).collect()} for d, p in (("loose", False), ("packed", True))]
    assert rows[0] == rows[1] == {("a", "1", 5), ("b", "unknown", 7)}


@pytest.mark.parametrize("name", ["s02_read_landmarks", "s04_read_manifests"])
def test_files_do_not_grow_with_rows(spark, tmp, monkeypatch, name):
    """1 000 suppliers in few files."""
    monkeypatch.setattr(source_queries, "scratch_path", lambda spark, tag: str(tmp / tag))
    registry.all_queries()[name](spark, "/root/testdata/sf0.1")
    assert len([p for p in Path(tmp).rglob("*") if p.is_file()]) < 50
