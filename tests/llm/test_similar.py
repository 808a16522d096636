"""Suffix dedup, Jaccard join, decontamination and embeddings against brute force."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from framewright.llm import decontaminate, embedding_dedup, jaccard_join, suffix_dedup


def components(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    return [find(a) for a in range(n)]


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())


def expected_components(rows):
    sets = [sets_of(t) for _, t in rows]
    comp = components(len(rows), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((key, len(sets[i]), (min(keys) if keys else None) if sets[i] else key))
    return sorted(out, key=str)


def test_prefixes_share_the_needed_lists():
    """Any two sets at the threshold meet on as many prefix lists as either of them asks for."""
    rng = np.random.default_rng(4)
    for percent in (30, 75, 90, 100):
        for _ in range(400):
            union = rng.permutation(3000)[:rng.integers(1, 400)]
            both = -(-percent * len(union) // 100)
            cut = both + rng.integers(0, len(union) - both + 1)
            x, y = np.sort(union[:cut]), np.sort(np.append(union[:both], union[cut:]))
            prefix = [set(h[:len(h) - jaccard_join._common(len(h), percent) + jaccard_join.LISTS].tolist()) for h in (x, y)]
            assert len(prefix[0] & prefix[1]) >= max(min(jaccard_join.LISTS, jaccard_join._common(len(h), percent)) for h in (x, y))


def test_jaccard_messy(messy, messy_rows, empty):
    got = jaccard_join.jaccard_components(messy).collect()
    assert sorted(map(tuple, got), key=str) == expected_components(messy_rows)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_other_thresholds(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:300 - 9 * i] + [f"x{rng.randrange(99999)}" for _ in range(9 * i)])) for i in range(16)] + [(40, "w0 w1"), (41, "w0 W1"), (42, None)]
    sets = [sets_of(t) for _, t in rows]
    for percent in (40, 95):
        comp = components(len(rows), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))  # noqa: B023
        want = {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i]) for i in range(len(rows))}
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_jaccard_long_lists(spark, monkeypatch):
    """More near copies than a list merged by a join holds, in several blocks, and a passage that all documents share."""
    monkeypatch.setattr(jaccard_join, "MERGED", 6)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 700)
    rng = random.Random(2)
    base, passage = [f"w{rng.randrange(999)}" for _ in range(120)], " ".join(f"p{i}" for i in range(50))
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(120)] = f"z{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, passage + " " + " ".join(f"u{i}.{k}" for k in range(60))) for i in range(30)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == expected_components(rows)


def test_occurrences_with_skipped_lists():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(50)]
    flat, who = np.concatenate(sets), np.repeat(np.arange(50), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    values, begin = np.unique(flat[order], return_index=True)
    for need in (5, 12, 15):
        for q in sets[:10]:
            got = jaccard_join._occurrences(q, values, np.append(begin, len(flat)), who[order], sets, need)
            assert got.tolist() == [i for i, s in enumerate(sets) if len(np.intersect1d(s, q)) >= need]


def test_one_per_component(messy, messy_rows):
    kept = jaccard_join.one_per_component(messy)
    assert kept.columns == messy.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    want = {k for k, _, c in expected_components(messy_rows) if k == c}
    assert set(ids) == want and ids.count(8) == 1
    clash = messy.withColumnRenamed("h", "_stay").withColumnRenamed("n", "_TH")
    kept = jaccard_join.one_per_component(clash)
    assert kept.columns == clash.columns and sorted(map(str, ids)) == sorted(str(r.doc_id) for r in kept.select("doc_id").collect())


def removed(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for x in texts:
        for p in range(len(x) - length + 1):
            seen[x[p:p + length]] = seen.get(x[p:p + length], 0) + 1
    out = []
    for (key, _), x in zip(rows, texts):
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - length + 1):
            if seen[x[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((key, len(x), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(x) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_messy(messy, messy_rows, empty, monkeypatch):
    want = removed(messy_rows, 400)
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, suffix_dedup.without_repeats(messy, 400).select(cols).collect()), key=str) == want
    monkeypatch.setattr(suffix_dedup, "BUCKET", 1)  # every bucket by counting
    assert sorted(map(tuple, suffix_dedup.without_repeats(messy, 400).select(cols).collect()), key=str) == want
    assert suffix_dedup.without_repeats(empty, 400).count() == 0


def test_repeat_groups_list_all_occurrences(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, both = word(450), word(420)
    rows = [(1, word(90) + shared + word(50)), (2, shared + word(300) + both), (3, word(10) + both + word(20) + shared), (4, word(700))]
    got = suffix_dedup.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()
    text = dict(rows)
    groups = {}
    for g in got:
        groups.setdefault(g.group, set()).add((g.doc_id, g.start, g.n_bytes))
    for members in groups.values():
        assert len({text[d][s:s + n] for d, s, n in members}) == 1 and len(members) > 1
    longest = {text[d][s:s + n]: {m[0] for m in ms} for ms in groups.values() for d, s, n in ms}
    assert any(shared.endswith(k[-100:]) and v == {1, 2, 3} for k, v in longest.items())


def test_suffix_hot_surroundings_in_many_tasks(spark):
    """Rows of one surrounding that is most of the input leave in many partitions, with the same result."""
    rng = random.Random(6)
    rows = [(1, "ab" * 6000), (2, "".join(rng.choice("cdef ") for _ in range(900))), (3, "ab" * 300 + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for cover in (True, False):
            found = suffix_dedup._repeats(suffix_dedup._rows(docs, "doc_id", "text"), "bigint", 400, cover)
            sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert max(sizes) < 0.5 * sum(sizes) and len(sizes) > 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, suffix_dedup.without_repeats(docs, 400).select(cols).collect()), key=str) == removed(rows, 400)


def test_join_of_a_hot_key_in_many_pieces(spark):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 1, i) for i in range(900)], "h long, ctx long")
    one = rows.groupBy("h").agg(F.count("*").alias("m"))
    hot = one.where("m > 300")
    dealt = suffix_dedup._dealt(rows, hot, ["h"], ["ctx"])
    assert {r.h: r.n > 50 for r in dealt.groupBy("h").agg(F.countDistinct("piece").alias("n")).collect()} == {h: h == 1 for h in range(7)}
    got = dealt.join(suffix_dedup._copies(one, hot, ["h"]), ["h", "piece"]).drop("piece")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(one, "h").collect()))


def test_maximal_repeats_by_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        gram = "g" * suffix_dedup.GRAM
        rows = sorted({("".join(rng.choice("ab") for _ in range(rng.randrange(6))), gram + "".join(rng.choice("ab") for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(2, 9))})
        lefts, rights = [a[::-1].encode() for a, _ in rows], [b.encode() for _, b in rows]
        length = suffix_dedup.GRAM + 3
        got = suffix_dedup.maximal_repeats(lefts, rights, length)
        for i in range(len(rows)):
            pairs = [(suffix_dedup._common(lefts[i], lefts[j]), suffix_dedup._common(rights[i], rights[j])) for j in range(len(rows)) if j != i]
            pairs = {p for p in pairs if sum(p) >= length}
            best = {p for p in pairs if not any(q != p and q[0] >= p[0] and q[1] >= p[1] for q in pairs)}
            assert {(a, b) for _, a, b in got[i]} == best


def test_decontamination(spark, messy, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "tiny item", "x"), (None, "alpha", "x")], "item_id long, text string, key string")
    docs = spark.createDataFrame([
        (1, "before " + item.upper() + " after", 0), (2, " ".join(w[12:] + ["filler"] * 7 + w[:12]), 0), (3, " ".join(w[:9]) + " something else", 0),
        (4, None, 0), (5, "", 0), (6, "a tiny item here", 0), (7, " ".join(reversed(w)), 0), (None, item, 0), (1, item, 0)], "doc_id long, text string, item long")
    got = sorted(((r.doc_id, r.item_id, r.n_tiles, r.covered) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(1, 1, 1, 20), (1, 1, 1, 20), (2, 1, 2, 20), (6, 4, 1, 2), (None, 1, 1, 20)], key=str)
    assert sorted(map(str, (r.doc_id for r in decontaminate.clean(docs, bench).collect()))) == ["3", "4", "5", "7", "None"]
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).count() == 0
    assert decontaminate.contamination(messy, bench).count() == 0


def test_benchmark_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 5)
    bench = spark.createDataFrame([(i, " ".join(f"b{i}x{k}" for k in range(8))) for i in range(4)], "item_id long, text string")
    docs = bench.selectExpr("item_id + 10 AS doc_id", "text")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()) == [(i + 10, i) for i in range(4)]


def test_tiles_by_brute_force():
    def covered(d, it, least):
        fd, fi, total = [True] * len(d), [True] * len(it), 0
        while True:
            best, found = 0, []
            for j in range(len(it)):
                for k in range(len(d)):
                    n = 0
                    while j + n < len(it) and k + n < len(d) and fi[j + n] and fd[k + n] and d[k + n] == it[j + n] >= 0:
                        n += 1
                    if n > best:
                        best, found = n, [(j, k)]
                    elif n == best and n:
                        found.append((j, k))
            if best < least:
                return total
            for j, k in found:
                if all(fi[j:j + best]) and all(fd[k:k + best]):
                    fi[j:j + best], fd[k:k + best] = [False] * best, [False] * best
                    total += best

    rng = random.Random(8)
    for _ in range(200):
        d, it = [rng.randrange(-1, 4) for _ in range(rng.randrange(1, 40))], [rng.randrange(4) for _ in range(rng.randrange(1, 20))]
        assert sum(t[2] for t in decontaminate.tiles(np.array(d), np.array(it), 3)) == covered(d, it, 3)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 4)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(30):
        v = rng.normal(size=8)
        rows += [(len(rows) + k, (v + rng.normal(size=8) * 0.09 * (k > 0)).astype(np.float32).tolist(), i % 3) for k in range(3)]
    rows += [(200, rows[0][1], 0), (201, [0.0] * 8, 1), (202, None, 1), (203, [1.0, None] + [0.0] * 6, 1), (204, [float("nan")] * 8, 1),
             (205, [float("inf")] + [1.0] * 7, 1), (206, rows[0][1], None), (207, rows[0][1], 2), (208, rows[0][1][:4], 0), (209, [], 0), (None, rows[0][1], 0),
             (0, rows[0][1], 0), (210, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, cid string, key string")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str)

    def fit(r):
        return r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    def linked(a, b):
        a, b = rows[a], rows[b]
        if not (fit(a) and fit(b)) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98

    comp = components(len(rows), linked)
    want = []
    for i, r in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        low = (min(keys) if keys else None) if fit(r) else r[0]
        want.append((r[0], sum(linked(i, j) for j in range(len(rows)) if j != i), low, r[0] is not None and r[0] == low))
    assert got == sorted(want, key=str) and any(w[1] > 2 for w in want)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_jaccard_pairs_are_compared_on_one_list():
    """Whatever lists two sets share, exactly one of the block pairs compares them; equal components and sizes too far apart are left out."""
    import pandas as pd

    rng = np.random.default_rng(5)
    lists = [np.unique(rng.integers(-9, 9, 7)) for _ in range(24)]
    n, root = rng.integers(60, 100, 24), rng.integers(0, 9, 24)
    seen = {}
    for s in range(-9, 9):
        for i in range(2):
            for j in range(i, 2):
                who = [m for m in range(24) if s in lists[m] and m % 2 in (i, j)]
                rows = pd.DataFrame({"s": s, "sig": who, "n": n[who], "root": root[who], "first": [m % 2 == i for m in who], "inner": i == j,
                                     "lists": [lists[m] for m in who]})
                if not len(rows):
                    continue
                kept = jaccard_join._needed(75)(rows)
                for part in (rows, kept):
                    found = set()
                    if len(part):
                        left, right, pairs = jaccard_join._to_compare(part, 75)
                        found = {frozenset((part.sig.iloc[left[a]], part.sig.iloc[right[b]])) for a, b in zip(*np.nonzero(pairs))}
                    if part is kept:
                        assert found == whole and set(part.sig) == set().union(*found)
                    whole = found
                for p in whole:
                    seen[p] = seen.get(p, 0) + 1
    want = {frozenset((a, b)) for a in range(24) for b in range(a) if root[a] != root[b] and 100 * min(n[a], n[b]) >= 75 * max(n[a], n[b]) and set(lists[a]) & set(lists[b])}
    assert set(seen) == want and set(seen.values()) == {1}
