"""Embedding near-dedup: int8 tile products with per-vector error bounds, full precision only where they leave doubt.

Equal vectors of a label are one class.  Classes are dealt into tiles of at most about ``TILE`` vectors by their nearest
pivot (pivots: a sample of at most ``PIVOTS`` vectors, which decides only the layout).  Two tiles are multiplied unless
the triangle inequality on their centres and radii already excludes every pair.

With unit vectors x, y, their quantised forms x', y' and e = |x - x'|:  |xy - x'y'| <= e_x + (1 + e_x) e_y.
A pair is recomputed in double precision when its int8 product plus that bound reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.base import components
from framewright.session import written

TILE, PIVOTS = 512, 32
_SLACK = 1e-5  # float32 rounding of the int8 products and of the unit vectors


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per tile: class ids, copies, float32 vectors, int8 codes, scales, errors, centre and radius."""
    x = np.stack(rows["vec"].to_numpy()).astype(np.float64)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    err = np.sqrt(((u - q * scale[:, None]) ** 2).sum(1))
    centre = u.mean(0)
    first = rows.iloc[0]
    return pd.DataFrame([{
        "label": first["label"], "dim": len(centre), "tile": f"{first['cell']}.{first['chunk']}", "cids": rows["cid"].tolist(),
        "copies": rows["m"].to_numpy(np.int64).tobytes(), "vecs": np.stack(rows["vec"].to_numpy()).astype(np.float32).tobytes(),
        "codes": q.tobytes(), "scale": scale.tobytes(), "err": err.tobytes(), "centre": centre.tolist(),
        "radius": float(np.sqrt(((u - centre) ** 2).sum(1)).max())}])


def _spanning(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of links that form a spanning forest."""
    root: dict[int, int] = {}

    def find(a: int) -> int:
        while root.setdefault(a, a) != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    keep = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            keep.append(k)
    return keep


def _products(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                dim, same = r.dim, r.ta == r.tb

                def side(p: str) -> tuple:
                    g = lambda c: getattr(r, c + p)  # noqa: E731,B023
                    return (list(g("cids")), np.frombuffer(g("copies"), np.int64), np.frombuffer(g("vecs"), np.float32).reshape(-1, dim),  # noqa: B023
                            np.frombuffer(g("codes"), np.int8).reshape(-1, dim).astype(np.float32), np.frombuffer(g("scale"), np.float64),  # noqa: B023
                            np.frombuffer(g("err"), np.float64))

                ca, ma, va, qa, sa, ea = side("a")
                cb, mb, vb, qb, sb, eb = side("b")
                upper = (qa @ qb.T) * sa[:, None] * sb[None, :] + ea[:, None] + (1 + ea[:, None]) * eb[None, :] + _SLACK
                i, j = np.nonzero(upper >= threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                x, y = va.astype(np.float64), vb.astype(np.float64)
                nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
                ok = np.concatenate([np.einsum("ij,ij->i", x[i[s:s + 65536]], y[j[s:s + 65536]]) / (nx[i[s:s + 65536]] * ny[j[s:s + 65536]]) >= threshold
                                     for s in range(0, len(i), 65536)])
                i, j = i[ok], j[ok]
                na, nb = np.bincount(i, mb[j], len(ca)).astype(np.int64), np.bincount(j, ma[i], len(cb)).astype(np.int64)
                keep = _spanning(i, j + len(ca)) if not same else _spanning(i, j)
                out = [(ca[k], int(na[k]), None) for k in np.nonzero(na)[0]] + [(cb[k], int(nb[k]), None) for k in np.nonzero(nb)[0]]
                out += [(ca[i[k]], 0, cb[j[k]]) for k in keep]
                if out:
                    yield pd.DataFrame(out, columns=["a", "n", "b"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept): links to other rows of the same label with cosine at or above ``threshold``.

    Null labels, null, empty or zero vectors, and vectors with null or non-finite components link with nothing; so do
    vectors of different lengths.  Repeated rows are different rows with the same key; a null key keeps its row, is never
    a component id beside other keys, and is not ``kept``.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(vec).cast("array<float>").alias("vec"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fits = F.col("label").isNotNull() & F.coalesce(~F.exists("vec", bad) & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("cid", F.when(fits, F.md5(F.concat_ws("|", F.col("vec").cast("string"), "label"))))
    classes = written(rows.where("cid is not null").groupBy("cid").agg(
        F.min("key").alias("low"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("vec").alias("vec")), "vector-classes")

    sample = [np.array(r.vec, np.float64) for r in classes.orderBy("cid").select("vec").limit(PIVOTS).collect()]
    pivots = [p / np.sqrt((p * p).sum()) for p in sample]

    @F.pandas_udf(T.IntegerType())
    def cell(vecs: pd.Series) -> pd.Series:
        out = np.zeros(len(vecs), np.int32)
        dims = vecs.map(len).to_numpy()
        for d in np.unique(dims):
            own = [k for k, p in enumerate(pivots) if len(p) == d]
            if own:
                at = np.nonzero(dims == d)[0]
                out[at] = np.argmax(np.stack(vecs.iloc[at].to_numpy()).astype(np.float64) @ np.stack([pivots[k] for k in own]).T, axis=1)
        return pd.Series(out)

    celled = classes.withColumns({"cell": cell("vec"), "dim": F.size("vec")})
    sizes = celled.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    dealt = celled.join(sizes, ["label", "dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("parts")))
    heavy = "cids array<string>, copies binary, vecs binary, codes binary, scale binary, err binary"
    tiles = written(dealt.groupBy("label", "dim", "cell", "chunk").applyInPandas(
        _tile, f"label string, dim int, tile string, {heavy}, centre array<double>, radius double"), "vector-tiles")

    light = tiles.select("label", "dim", "tile", "centre", "radius")
    far = F.sqrt(F.aggregate(F.zip_with("centre", "centre_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    pairs = light.withColumnRenamed("tile", "ta").join(
        light.select("label", "dim", F.col("tile").alias("tb"), F.col("centre").alias("centre_b"), F.col("radius").alias("radius_b")),
        ["label", "dim"]).where(F.col("ta") <= F.col("tb")).where(far <= F.col("radius") + F.col("radius_b") + reach).select("label", "dim", "ta", "tb")
    names = [x.split()[0] for x in heavy.split(", ")]
    load = lambda p: tiles.select("label", "dim", F.col("tile").alias(f"t{p}"), *[F.col(c).alias(c + p) for c in names])
    found = written(pairs.join(load("a"), ["label", "dim", "ta"]).join(load("b"), ["label", "dim", "tb"]).mapInPandas(
        _products(threshold), "a string, n long, b string"), "vector-links")

    counts = found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"), "vector-components").withColumnRenamed("node", "cid")
    known = classes.select("cid", "low", "m").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")).join(counts, "cid", "left")
    ids = known.groupBy("root").agg(F.min("low").alias("low_of_all"))
    done = known.join(ids, "root").select("cid", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), "low_of_all")
    component = F.when(F.col("cid").isNull(), F.col("key")).otherwise(F.col("low_of_all"))
    return rows.select("key", "cid").join(done, "cid", "left").select(
        F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
