"""Approximate nearest neighbours: robust-pruned directed graphs over shards, searched by beams.

Equal vectors are one class.  Classes are dealt into shards of about ``SHARD`` by hash and every class is indexed.  A shard's
graph grows by insertion: a greedy beam search proposes neighbours of each new node, robust pruning drops a neighbour that is
``ALPHA`` times closer to a kept one than to the node, and reverse edges are pruned the same way when a list exceeds ``DEGREE``.
Every query runs a beam search of width ``BEAM`` in every shard; a task holds one shard's graph and a block of at most about
``BLOCK`` queries.  The shards' best classes, scored in double precision on the original vectors, meet per query.

Largest inner product is nearest Euclidean distance once each vector gets a coordinate that makes all norms of the shard equal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import written

SHARD, BLOCK = 4096, 8192
DEGREE, BEAM, PROPOSE, ALPHA = 32, 96, 64, 1.2
STARTS = 32  # nodes from which each search begins, so that a dense clump does not hold all beams
_WIDE, _STEP = 4, 512  # nodes a beam opens at once; queries searched at once


def beam_search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best nodes met from ``entries`` for each query, best first: (ids, -1 where fewer; distance less the query's norm)."""
    b, norms = len(queries), np.einsum("ij,ij->i", x, x)
    width = max(width, len(entries))
    seen = np.zeros((b, len(x)), bool)
    seen[:, entries] = True
    first = norms[entries][None, :] - 2 * queries @ x[entries].T
    ids, far = np.full((b, width), -1, np.int32), np.full((b, width), np.inf, np.float32)
    order = np.argsort(first, axis=1, kind="stable")
    ids[:, :len(entries)], far[:, :len(entries)] = entries[order], np.take_along_axis(first, order, 1)
    shut = ids < 0
    rows = np.arange(b)
    while len(rows):
        best = np.argsort(shut[rows], axis=1, kind="stable")[:, :_WIDE]
        fresh_ones = ~np.take_along_axis(shut[rows], best, 1)
        shut[rows[:, None], best] = True
        near = np.where(fresh_ones[:, :, None], edges[np.take_along_axis(ids[rows], best, 1)], -1).reshape(len(rows), -1)
        near.sort(axis=1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        new &= ~seen[rows[:, None], near]
        r, c = np.nonzero(new)
        node = near[r, c]
        seen[rows[r], node] = True
        dist = np.full(near.shape, np.inf, np.float32)
        dist[r, c] = norms[node] - 2 * np.einsum("ij,ij->i", x[node], queries[rows[r]])
        all_far = np.concatenate([far[rows], dist], axis=1)
        keep = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        keep = np.take_along_axis(keep, np.argsort(np.take_along_axis(all_far, keep, 1), axis=1, kind="stable"), 1)
        far[rows] = np.take_along_axis(all_far, keep, 1)
        met = np.take_along_axis(np.concatenate([ids[rows], np.where(new, near, -1)], axis=1), keep, 1)
        ids[rows] = met
        shut[rows] = np.take_along_axis(np.concatenate([shut[rows], ~new], axis=1), keep, 1) | (met < 0)
        rows = rows[~shut[rows].all(axis=1)]
    return ids, far


def robust_prune(x: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node out of its row of ``proposed`` (-1: none; no repeats, not the node)."""
    kept = np.full((len(nodes), degree), -1, np.int32)
    for s in range(0, len(nodes), 128):
        own, cand = nodes[s:s + 128], proposed[s:s + 128]
        points = x[np.maximum(cand, 0)]
        away = ((points - x[own][:, None, :]) ** 2).sum(2)
        away[cand < 0] = np.inf
        order = np.argsort(away, axis=1, kind="stable")
        cand, away, points = np.take_along_axis(cand, order, 1), np.take_along_axis(away, order, 1), np.take_along_axis(points, order[:, :, None], 1)
        norms = (points ** 2).sum(2)
        between = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
        alive, at = np.isfinite(away), np.arange(len(own))
        for k in range(degree):
            pick = alive.argmax(axis=1)
            some = alive[at, pick]
            if not some.any():
                break
            kept[s:s + 128, k] = np.where(some, cand[at, pick], -1)
            alive &= alpha * alpha * between[at, pick] > away
            alive[at, pick] = False
    return kept


def _reach(edges: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Nodes from which every node can be reached: ``starts``, then the first node not yet reached, and so on."""
    reached, entries = np.zeros(len(edges), bool), list(starts)
    front = starts
    while True:
        reached[front] = True
        while len(front):
            front = np.unique(edges[front])
            front = front[front >= 0]
            front = front[~reached[front]]
            reached[front] = True
        if reached.all():
            return np.array(entries, np.int32)
        front = np.array([np.argmin(reached)])
        entries.append(front[0])


def build_graph(vectors: np.ndarray, degree: int = DEGREE, propose: int = PROPOSE, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, edges, entries) of one shard; points are the vectors with the coordinate that evens their norms."""
    norms = np.einsum("ij,ij->i", vectors, vectors)
    x = np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1).astype(np.float32)
    n = len(x)
    edges = np.full((n, degree), -1, np.int32)
    middle = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    order = np.random.default_rng(n).permutation(n).astype(np.int32)
    order = np.concatenate([[middle], order[order != middle]]).astype(np.int32)
    done = 1
    while done < n:
        new = order[done:done + min(max(done, 16), 1024)]
        got, _ = beam_search(x, edges, order[:min(STARTS, done)], x[new], propose)
        if done < propose:  # while the graph is small, the batch itself is proposed as well
            got = np.concatenate([got, np.where(new[None, :] == new[:, None], -1, new[None, :])], axis=1)
        edges[new] = robust_prune(x, new, got, degree, alpha)
        _add_reverse(x, edges, new, alpha)
        done += len(new)
    return x, edges, _reach(edges, order[:STARTS])


def _add_reverse(x: np.ndarray, edges: np.ndarray, new: np.ndarray, alpha: float) -> None:
    """For each edge of the new nodes the opposite edge; lists that grow too long are pruned."""
    degree = edges.shape[1]
    target, source = edges[new].ravel(), np.repeat(new, degree)
    target, source = target[target >= 0], source[target >= 0]
    old = np.unique(target)
    have = edges[old]
    t, s = np.concatenate([np.repeat(old, degree), target]), np.concatenate([have.ravel(), source])
    t, s = t[s >= 0], s[s >= 0]
    both = np.unique(t.astype(np.int64) * len(x) + s)
    t, s = both // len(x), (both % len(x)).astype(np.int32)
    start = np.searchsorted(t, old)
    count = np.diff(np.append(start, len(t)))
    short = count <= degree
    for group, width in ((short, degree), (~short, int(count.max(initial=0)))):
        own = old[group]
        for part in np.array_split(np.arange(len(own)), max(1, len(own) * width // 400_000)):
            at, n = start[group][part], count[group][part]
            spread = np.arange(width)[None, :]
            rows = np.where(spread < n[:, None], s[np.minimum(at[:, None] + spread, len(s) - 1)], -1)
            edges[own[part]] = rows if width == degree else robust_prune(x, own[part], rows, degree, alpha)


_GRAPH = "dim int, shard int, cids array<string>, lows array<long>, vecs binary, points binary, edges binary, entries binary"
_FOUND = "query string, cid string, low long, score double"


def _graph_of(rows: pd.DataFrame) -> pd.DataFrame:
    """One row that holds the shard's classes, their vectors in double precision, and the graph."""
    vecs = np.stack(rows["vec"].to_numpy()).astype(np.float64)
    points, edges, entries = build_graph((vecs / np.abs(vecs).max()).astype(np.float32))
    first = rows.iloc[0]
    lows = [None if pd.isna(v) else int(v) for v in rows["low"]]
    return pd.DataFrame([{"dim": first["dim"], "shard": first["shard"], "cids": rows["cid"].tolist(), "lows": lows, "vecs": vecs.tobytes(),
                          "points": points.tobytes(), "edges": edges.tobytes(), "entries": entries.tobytes()}])


def _searched(k: int):
    def run(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graphs) or not len(queries):
            return pd.DataFrame([], columns=["query", "cid", "low", "score"])
        g = graphs.iloc[0]
        vecs = np.frombuffer(g.vecs).reshape(-1, g.dim)
        points = np.frombuffer(g.points, np.float32).reshape(len(vecs), -1)
        edges, entries = np.frombuffer(g.edges, np.int32).reshape(len(vecs), -1), np.frombuffer(g.entries, np.int32)
        cids, lows = np.asarray(g.cids, object), pd.array([None if v is None or pd.isna(v) else int(v) for v in g.lows], "Int64")
        asked, names, out = np.stack(queries["vec"].to_numpy()).astype(np.float64), queries["cid"].to_numpy(object), []
        for s in range(0, len(asked), _STEP):
            q = asked[s:s + _STEP]
            small = np.zeros((len(q), points.shape[1]), np.float32)
            small[:, :g.dim] = q / np.abs(q).max(axis=1, keepdims=True)
            ids, _ = beam_search(points, edges, entries, small, max(BEAM, 2 * k))
            r, c = np.nonzero(ids >= 0)
            node = ids[r, c]
            score = (vecs[node] * q[r]).sum(1)
            best = pd.DataFrame({"r": r, "node": node, "score": score, "low": lows[node]}).sort_values(
                ["r", "score", "low"], ascending=[True, False, True], na_position="last").groupby("r").head(k)
            out.append(pd.DataFrame({"query": names[s + best["r"].to_numpy()], "cid": cids[best["node"].to_numpy()], "low": best["low"], "score": best["score"]}))
        return pd.concat(out)

    return run


def nearest(vectors: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``asked`` is true the ``k`` other rows of largest inner product that were found.

    Null, empty or zero vectors and vectors with null or non-finite components take no part; vectors of another length are no
    candidates.  Scores are double precision on the original vectors; equal scores go by ``key``, nulls last.  A repeated row is a
    row of its own: it is a candidate of its copies and, where asked, gets its own ranks.  Fewer rows than ``k`` give them all.
    Of a class of equal vectors the ``k + 1`` smallest keys can be among the nearest of a query, so only those are kept for answers.
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec"), F.coalesce(asked, F.lit(False)).alias("asked")).where(
        F.coalesce(~F.exists("vec", bad) & F.exists("vec", lambda v: v != 0), F.lit(False))).withColumn("cid", F.md5(F.col("vec").cast("string")))

    first = Window.partitionBy("cid").orderBy(F.col("key").asc_nulls_last())
    classes = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("cid").agg(
        F.first("vec").alias("vec"), F.min("key").alias("low"),
        F.sort_array(F.collect_list(F.struct(F.col("key").isNull().alias("none"), "key"))).alias("members")).withColumn("dim", F.size("vec"))
    classes = written(classes, "graph-classes")
    shards = classes.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    dealt = classes.select("cid", "vec", "low", "dim").join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("cid"), F.col("shards")).cast("int"))
    # Shards are small in bytes and heavy in work: the number of tasks is given, so that they are not merged into few.
    tasks = max(shards.agg(F.sum("shards")).first()[0] or 1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    graphs = written(dealt.repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInPandas(_graph_of, _GRAPH), "graphs")

    wanted = written(classes.select("cid", "vec", "dim").join(rows.where("asked").select("cid").distinct(), "cid", "left_semi"), "graph-queries")
    blocks = wanted.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    plan = shards.join(blocks, "dim")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = wanted.join(plan, "dim").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("shard", every("shards"))
    held = graphs.join(plan.select("dim", "blocks"), "dim").withColumn("block", every("blocks")).drop("blocks")
    at = ["dim", "shard", "block"]
    found = written(held.repartition(tasks, *at).groupBy(*at).cogroup(sent.repartition(tasks, *at).groupBy(*at)).applyInPandas(_searched(k + 1), _FOUND), "graph-found")

    by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("low").asc_nulls_last())
    best = found.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
    listed = best.join(classes.select("cid", "members"), "cid").select("query", F.explode(F.transform("members", lambda m: F.struct(
        (-F.col("score")).alias("s"), m["none"].alias("none"), m["key"].alias("key"), (F.col("cid") == F.col("query")).alias("same")))).alias("x"))
    answers = listed.groupBy("query").agg(F.sort_array(F.collect_list("x")).alias("x"))
    own = F.array_position(F.transform("x", lambda x: x["same"] & x["key"].eqNullSafe(F.col("key"))), True)
    ranked = rows.where("asked").select("cid", "key").join(answers.withColumnRenamed("query", "cid"), "cid").withColumn("own", own).select(
        "key", F.posexplode(F.slice(F.filter("x", lambda x, i: i + 1 != F.col("own")), 1, k)).alias("i", "x"))
    return ranked.select(F.col("key").alias("query_id"), (F.col("i") + 1).cast("int").alias("rank"), F.col("x.key").alias(key), (-F.col("x.s")).alias("score"))
