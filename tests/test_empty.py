"""Texts that are null, empty or just a block long, against the SQL twins."""

import duckdb
import pytest

from framewright.plans import registry
from tools.check import normal


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    texts = [None, "", "a", " ", "b" * 199, "c" * 200, "d" * 201, "é😀z" * 77, "", "e" * 52_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["a01_to_blocks", "a02_pre_emphasis", "a04_peak_normalize", "a06_fit_length"])
def test_texts_without_samples(spark, odd, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    got = registry.all_queries()[name](spark, odd).toPandas()
    assert normal(got) == normal(con.sql(registry.all_sql()[name]).df())


def test_blocks_without_samples_come_back(spark):
    from framewright.operators import signal as S

    rows = [(1, 0, 2, [0.5, 0.25]), (1, 1, 0, []), (2, 0, 0, []), (3, 0, 1, [None]), (4, 0, None, None), (None, 0, 0, [])]
    blocks = spark.createDataFrame(rows, "clip_id int, block_idx long, n int, samples array<float>").repartition(3)
    got = S.to_blocks(S.to_samples(blocks, 2, mark_empty=True), 2).collect()
    assert {(r.clip_id, r.block_idx, r.n, tuple(r.samples)) for r in got} == {
        (1, 0, 2, (0.5, 0.25)), (1, 1, 0, ()), (2, 0, 0, ()), (3, 0, 1, (None,)), (None, 0, 0, ())}
    assert S.to_samples(blocks, 2).count() == 3
