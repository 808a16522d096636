"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` is called so in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased words between space and 0x09-0x0D (what ``bytes.split`` splits on)."""
    return text.lower().split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser, a bijection."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingle_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words form one shingle of their own kind."""
    n = len(tokens)
    if n == 0:
        return tokens
    k = min(width, n)
    h = np.full(n - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = mix(h + tokens[j:n - k + 1 + j] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h)


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(text).cast(pa.binary())
        ends = np.cumsum([0 if n is None else n for n in pc.binary_length(size).to_pylist()])
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, root): the smallest node reachable over undirected ``edges`` (a, b), by alternating stars.

    Every round is two aggregations by node; a hot node is pre-aggregated before the shuffle and the
    join back to it is left to Spark's splitting of skewed partitions.  Rounds are written to the shared
    folder.  Nodes without an edge are absent; null nodes are not allowed.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v"))
    sym = lambda e: both(e).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    seen = mark(e)
    while seen[0]:
        s = sym(e)
        low = s.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = s.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.withColumnRenamed("a", "u").join(low, "u").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = written(small, tag)
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b"), F.col("b"))).distinct()
