"""Ranked search against scores by the formula, graph search against all inner products."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from framewright.llm import graph_search, ranked_search


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def best_documents(docs, items, k):
    """All (item, rank, key, score) by the formula."""
    held = [(key, terms(t)) for key, t in docs if terms(t)]
    n_all, l_all = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for key, w in held:
            m = 50 + 50 * len(w) * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m))
                    for t in wanted if t in w)
            if s > 0:
                scores.append((-s, key is not None, key or 0, key))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def test_ranked_messy(messy, messy_rows, empty, spark):
    items = [(1, "ba ko RI mu ten"), (2, "sal vi or changed x"), (3, None), (4, "  ..."), (1, "words"), (None, "one"), (5, "éàü ж中文 feed"), (6, "ÉÀ a a a b c")]
    bench = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, doc_id long")
    for k in (3, 50):
        got = ranked_search.ranked(messy, bench, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == best_documents(messy_rows, items, k)
    assert ranked_search.ranked(empty, bench).count() == 0
    assert ranked_search.ranked(messy, bench.where("false")).count() == 0


def test_ranked_over_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ENTRIES", 300)
    monkeypatch.setattr(ranked_search, "ITEMS", 3)
    monkeypatch.setattr(ranked_search, "_READ", 2)
    monkeypatch.setattr(ranked_search, "BITS", 64)  # nearly every term passes the filter
    rng = random.Random(6)
    word = lambda: f"t{int(rng.paretovariate(0.7)) % 60}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(200)] + [(500 + i, "t1 t2 t3") for i in range(80)]
    items = [(i, " ".join(word() for _ in range(8))) for i in range(10)]
    got = ranked_search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted(map(tuple, got.collect()), key=str) == best_documents(docs, items, 7)


def test_nra_stops_early_and_is_exact(monkeypatch):
    monkeypatch.setattr(ranked_search, "_READ", 4)
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 300))
        lists, total = [], np.zeros(n, np.int64)
        for _ in range(int(rng.integers(1, 6))):
            docs = rng.permutation(n)[:int(rng.integers(1, n + 1))]
            impacts = np.sort((rng.pareto(1.0, len(docs)) * 5).astype(np.int64))[::-1]
            lists.append((docs, impacts))
            np.add.at(total, docs, impacts)
        rank = rng.permutation(n)
        docs, scores = ranked_search.nra(lists, n, 5, rank)
        want = [d for d in np.lexsort((rank, -total)) if total[d] > 0][:5]
        assert docs.tolist() == want and scores.tolist() == total[want].tolist()


def brute_force(rows, k=20):
    fit = [(key, np.array(v, np.float64)) for key, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, (key, v) in enumerate(fit):
        if key is not None and key % 20 == 0:
            found = sorted((-(v * w).sum(), o is None, o or 0) for j, (o, w) in enumerate(fit) if j != i and len(w) == len(v))[:k]
            out.setdefault(key, []).append([(None if none else o, -s) for s, none, o in found])
    return out


def test_nearest(spark, monkeypatch):
    """Several shards and blocks, norms that differ, copies, ties, nulls, other lengths; small enough that the beams see all."""
    monkeypatch.setattr(graph_search, "SHARD", 60)
    monkeypatch.setattr(graph_search, "BLOCK", 4)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.2, 3)).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[40][1]) for i in range(50)] + [(60, rows[60][1]), (60, rows[61][1]), (None, rows[80][1]), (2000, None), (2020, []), (2040, [0.0] * 8),
             (2060, [1.0, None] + [0.0] * 6), (2080, [float("nan")] * 8), (2100, [float("inf")] + [1.0] * 7), (2120, [1.0, 2.0]), (2140, [3.0, -1.0]), (2160, [5.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cid string, shard int")
    got = graph_search.nearest(df, F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    have = {}
    for r in got.collect():
        have.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_force(rows)
    for key, lists in want.items():
        flat = sorted((i + 1, (o is None, o or 0), s) for found in lists for i, (o, s) in enumerate(found))
        mine = sorted((r, (o is None, o or 0), s) for r, o, s in have.get(key, []))
        assert [x[:2] for x in mine] == [x[:2] for x in flat], key
        assert np.allclose([x[2] for x in mine], [x[2] for x in flat], rtol=1e-12)
    assert set(have) == {k for k, v in want.items() if any(v)}
    assert graph_search.nearest(df.where("false"), F.lit(True)).count() == 0


def test_recall_on_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute_force(rows)
    from framewright.llm.queries import op13_graph_search

    hit = {}
    for r in op13_graph_search(spark, sf).collect():
        hit.setdefault(r.query_id, set()).add(r.vec_id)
    share = np.mean([len(hit[k] & {o for o, _ in lists[0]}) / 20 for k, lists in want.items()])
    assert share >= 0.9


def test_clumps_stay_reachable():
    """A dense clump may not hide the rest: every node can be reached, and recall stays high."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 32))
    x[:500] = x[0] + rng.normal(size=(500, 32)) * 0.01
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    points, edges, entries = graph_search.build_graph(x)
    reached, front = set(entries.tolist()), list(entries)
    while front:
        front = [int(e) for e in np.unique(edges[front]) if e >= 0 and int(e) not in reached]
        reached.update(front)
    assert len(reached) == len(x) and not (edges == np.arange(len(x))[:, None]).any()
    q = x[400:600]
    ids, _ = graph_search.beam_search(points, edges, entries, np.concatenate([q, np.zeros((200, 1), np.float32)], 1), graph_search.BEAM)
    true = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(ids.tolist(), true.tolist())]) > 0.9
