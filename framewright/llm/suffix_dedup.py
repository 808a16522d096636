"""Repeated byte strings by an enhanced suffix array, dealt out by content-chosen anchors.

A string of ``length`` bytes always contains the ``GRAM``-byte run with the smallest hash, so equal strings choose equal
anchors.  Only suffixes that start at anchors are sorted, and those of equal anchors meet in one bucket with the bytes
around them.  In a bucket the suffixes are sorted, neighbouring common prefixes computed, and the tree of common-prefix
intervals scanned with a stack.  In each interval the members are ordered by what stands to their left; members with a
common left extension that is diverse further left form a maximal repeat group, and all of them are its occurrences.
Repeats longer than the bytes carried with an anchor appear as a chain of overlapping groups.

What keeps it small: equal surroundings are counted before any text moves; a bucket's member stays only if one of its
three cores (each inside a third of the strings through the anchor) occurs again; a bucket of more than ``BUCKET``
different surroundings is settled by counting its strings' hashes instead, which gives the same spans.  Anchors and
surroundings that make up a large share of all rows are joined in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.base import byte_texts, chunks, mix
from framewright.session import written

GRAM = 128
BUCKET = 4096
HOT = 1000  # keys with more rows than one in HOT anchors are dealt out over PIECES tasks; so there are few of them
PIECES = 256
_KEY = "key {kind}, th long"
_SPANS = "array<struct<group:long,back:int,ahead:int>>"


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Mixed hash of each run of GRAM bytes, by doubling."""
    h, power = b.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        width = 1
        while width < GRAM:
            h = h[:-width] * power + h[width:]
            width, power = width * 2, power * power
        return mix(h)


def _slide(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over each run of w values."""
    n = len(x)
    pad = -(-n // w) * w
    y = np.full(pad, fill, x.dtype)
    y[:n] = x
    y = y.reshape(-1, w)
    after = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    before = op.accumulate(y, axis=1).ravel()
    return op(after[:n - w + 1], before[w - 1:n])


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions chosen by some string of ``length`` bytes (leftmost smallest hash), and the hashes there."""
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(np.frombuffer(text, np.uint8))
    low = np.uint64(2**32 - 1)
    order = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the left one
    w = length - GRAM + 1
    chosen = np.unique(_slide(order, w, np.minimum, 2**64 - 1) & low).astype(np.int64)
    return chosen, h[chosen]


def _anchor_rows(docs: DataFrame, kind: str, length: int) -> DataFrame:
    reach = length - GRAM
    third = -(-(reach + 1) // 3)
    core = length - third + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            row, pos, grams, ctx, cores = [], [], [], [], [[], [], []]
            for i, t in enumerate(byte_texts(part.column("text"))):
                at, h = anchors(t, length)
                row.append(np.full(len(at), i))
                pos.append(at)
                grams.append(h)
                for a in at.tolist():
                    s = max(0, a - reach)
                    ctx.append(xxhash.xxh3_64_intdigest(t[s:a + length], a - s))
                    for k in range(3):
                        c = a - k * third  # nothing if no string of this third fits into the text
                        cores[k].append(xxhash.xxh3_64_intdigest(t[c:c + core], k) - 2**63 if c >= 0 and c + core <= len(t) else None)
            row, pos, grams = (np.concatenate(x) for x in (row, pos, grams))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(row)), part.column("th").take(pa.array(row)), pa.array(pos.astype(np.int32)), signed(grams), signed(ctx),
                 *(pa.array(c, pa.int64()) for c in cores)], names=["key", "th", "pos", "h", "ctx", "c0", "c1", "c2"])

    return docs.mapInArrow(run, f"{_KEY.format(kind=kind)}, pos int, h long, ctx long, c0 long, c1 long, c2 long")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> list[list[tuple[int, int, int]]]:
    """Of each suffix of one bucket: (group, bytes back, bytes ahead) of the maximal repeats of at least ``length`` bytes.

    ``rights`` are the suffixes, ``lefts`` what stands before them, reversed; all pairs (left, right) differ.  A repeat that
    lies inside another one of the same occurrence is left out.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [0] + [_common(rights[a], rights[b]) for a, b in zip(order, order[1:])] + [-1]
    found: list[list[tuple[int, int, int]]] = [[] for _ in rights]
    most = [-1] * len(rights)

    def interval(depth: int, lo: int, hi: int) -> None:
        if depth < GRAM:
            return
        members = sorted(order[lo:hi + 1], key=lefts.__getitem__)
        near = [_common(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        for k, m in enumerate(members):
            # The longest left extension shared with another member; further left the sharers differ or end.
            back = max(near[k - 1] if k else -1, near[k] if k < len(near) else -1)
            if back + depth >= length and back > most[m]:
                most[m] = back
                found[m].append((xxhash.xxh3_64_intdigest(lefts[m][:back][::-1] + rights[m][:depth]) - 2**63, back, depth))

    stack = [(0, 0)]  # depth and first position of the open intervals
    for i in range(1, len(lcp)):
        first = i - 1
        while stack and stack[-1][0] > lcp[i]:
            depth, first = stack.pop()
            if i - 1 > first:
                interval(depth, first, i - 1)
        if not stack or stack[-1][0] < lcp[i]:
            stack.append((lcp[i], first))
    return found


def _bucket_repeats(length: int, cover: bool):
    """Over rows sorted by bucket; a bucket cut by a batch is completed first.

    With ``cover`` only the furthest reach of a member's repeats: all of them hold its anchor, so their union is one run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[tuple[int, int, bytes, bytes]] = []

        def solved(rows: list[tuple[int, int, bytes, bytes]], out: tuple[list, list, list]) -> None:
            spans = maximal_repeats([r[2][::-1] for r in rows], [r[3] for r in rows], length)
            for r, s in zip(rows, spans):
                if s and cover:
                    s = [(0, max(x[1] for x in s), max(x[2] for x in s))]
                if s:
                    out[0].append(r[0])
                    out[1].append(r[1])
                    out[2].append([{"group": g, "back": a, "ahead": b} for g, a, b in s])

        def batch(out: tuple[list, list, list]) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("group", pa.int64()), ("back", pa.int32()), ("ahead", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], names=["h", "ctx", "spans"])

        for part in batches:
            out: tuple[list, list, list] = ([], [], [])
            for r in zip(*(part.column(c).to_pylist() for c in ("h", "ctx", "left", "right"))):
                if open_rows and open_rows[0][0] != r[0]:
                    solved(open_rows, out)
                    open_rows = []
                open_rows.append(r)
            yield batch(out)
        out = ([], [], [])
        if open_rows:
            solved(open_rows, out)
        yield batch(out)

    return run


def _packed(docs: DataFrame, kind: str) -> DataFrame:
    """Texts compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1)
        for part in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("th"), pa.array([pack.compress(t) for t in byte_texts(part.column("text"))], pa.binary())],
                                             names=["key", "th", "packed"])

    return docs.mapInArrow(run, f"{_KEY.format(kind=kind)}, packed binary")


def _copies(one: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the ``hot`` keys once for each piece."""
    both = one.join(F.broadcast(hot.select(*on, F.lit(PIECES).alias("pieces"))), on, "left")
    return both.select(*one.columns, F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"))


def _dealt(rows: DataFrame, hot: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Rows of the ``hot`` keys dealt out to pieces."""
    both = rows.join(F.broadcast(hot.select(*on, F.lit(PIECES).alias("pieces"))), on, "left")
    return both.select(*rows.columns, F.pmod(F.xxhash64(*by), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece"))


def _repeats(rows: DataFrame, kind: str, length: int, cover: bool) -> DataFrame:
    """(key, th, pos, group, back, ahead): occurrences, each the bytes [pos - back, pos + ahead) of a text.

    With ``cover`` one row per anchor that has any, reaching as far as they do.
    """
    reach = length - GRAM
    found = written(_anchor_rows(rows, kind, length), "repeat-anchors")
    often = lambda c: F.col(c) * HOT > F.lit(total)
    total = found.count()
    # Equal surroundings are counted first.
    same = found.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("key", "th", "pos")).alias("rep"), F.first("c0").alias("c0"),
                                         F.first("c1").alias("c1"), F.first("c2").alias("c2"))
    many = written(same.groupBy("h").agg(F.count("*").alias("m"), F.sum("n").alias("all")).where(F.col("all") > 1), "repeat-grams")
    often_h = many.where(often("m"))
    same = written(_dealt(same, often_h, ["h"], ["ctx"]).join(_copies(many, often_h, ["h"]), ["h", "piece"]).drop("piece"), "repeat-surroundings")
    whole = same.where("n > 1").select("h", "ctx", F.array(F.struct(F.col("ctx").alias("group"), F.lit(reach).alias("back"), F.lit(length).alias("ahead"))).cast(_SPANS).alias("spans"))
    cores = same.where("m > 1").select("h", "ctx", F.posexplode(F.array("c0", "c1", "c2")).alias("k", "c")).where("c is not null")
    shared = cores.groupBy("h", "k", "c").agg(F.count("*").alias("d")).where("d > 1").select("h", "k", "c")
    live = same.join(cores.join(shared, ["h", "k", "c"]).select("h", "ctx").distinct(), ["h", "ctx"]).select("h", "ctx", "rep")
    live = live.join(live.groupBy("h").agg(F.count("*").alias("m")), "h")

    wanted = live.groupBy(F.col("rep.key").alias("k2"), F.col("rep.th").alias("t2")).agg(F.collect_list(F.struct("h", "ctx", "m", F.col("rep.pos").alias("pos"))).alias("at"))
    texts = _packed(rows, kind)
    joined = texts.join(wanted, texts["key"].eqNullSafe(wanted["k2"]) & (texts["th"] == wanted["t2"])).select("packed", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for part in batches:
            for k in range(0, part.num_rows, 16):
                out: list[list] = [[], [], [], [], []]
                for packed, at in zip(part.column("packed").slice(k, 16).to_pylist(), part.column("at").slice(k, 16).to_pylist()):
                    t = unpack.decompress(packed)
                    for x in at:
                        for o, v in zip(out, (x["h"], x["ctx"], x["m"], t[max(0, x["pos"] - reach):x["pos"]], t[x["pos"]:x["pos"] + length])):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:3]), *(pa.array(o, pa.binary()) for o in out[3:])], names=["h", "ctx", "m", "left", "right"])

    around = joined.mapInArrow(cut, "h long, ctx long, m long, left binary, right binary")
    # Repeated rows of one document give equal copies of a surrounding; one is enough.
    around = written(around.dropDuplicates(["h", "ctx"]), "repeat-bytes")
    part = around.where(F.col("m") <= BUCKET).drop("m").repartition("h").sortWithinPartitions("h").mapInArrow(_bucket_repeats(length, cover), f"h long, ctx long, spans {_SPANS}")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in batches:
            for h, ctx, left, right in zip(*(rows_.column(c).to_pylist() for c in ("h", "ctx", "left", "right"))):
                text = left + right
                backs = [len(left) - s for s in range(max(0, len(text) - length + 1)) if len(left) - s >= 0]
                digest = [xxhash.xxh3_128_digest(text[len(left) - b:len(left) - b + length]) for b in backs]
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(backs), pa.int64()), pa.array([ctx] * len(backs), pa.int64()), pa.array(backs, pa.int32()),
                                                  pa.array(digest, pa.binary())], names=["h", "ctx", "back", "s"])

    one = around.where(F.col("m") > BUCKET).mapInArrow(strings, "h long, ctx long, back int, s binary")
    twice = one.groupBy("h", "back", "s").agg(F.count("*").alias("d")).where("d > 1").select("h", "back", "s")
    hot = one.join(twice, ["h", "back", "s"]).groupBy("h", "ctx").agg(F.collect_set(F.struct(
        F.xxhash64("s").alias("group"), "back", (F.lit(length) - F.col("back")).alias("ahead"))).cast(_SPANS).alias("spans"))
    spans = whole.union(part).union(hot)
    often_same = same.where(often("n"))
    spans = _copies(spans, often_same, ["h", "ctx"])
    at = _dealt(found.select("key", "th", "pos", "h", "ctx"), often_same, ["h", "ctx"], ["key", "th", "pos"])
    meet = ["h", "ctx", "piece"]
    if cover:
        reach_of = lambda c: F.max(F.array_max(F.transform("spans", lambda s: s[c]))).alias(c)
        spans = spans.groupBy(meet).agg(reach_of("back"), reach_of("ahead"))
        return at.join(spans, meet).select("key", "th", "pos", F.lit(0).cast("long").alias("group"), "back", "ahead")
    spans = spans.groupBy(meet).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return at.join(spans, meet).select("key", "th", "pos", F.explode("spans").alias("s")).select("key", "th", "pos", "s.*")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text")).select("key", "th", "text")


def repeat_groups(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(group, key, start, n_bytes): maximal repeat groups with all occurrences; byte offsets into the UTF-8 text."""
    kind = docs.schema[key].dataType.simpleString()
    found = _repeats(_rows(docs, key, text), kind, length, False)
    return found.select("group", F.col("key").alias(key), F.greatest(F.col("pos") - F.col("back"), F.lit(0)).alias("start"), (F.col("back") + F.col("ahead")).alias("n_bytes")).distinct()


def without_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, removed): bytes covered by a string of ``length`` bytes that starts elsewhere too.

    ``removed`` has the maximal removed runs as (start, end).  Null texts are empty; texts shorter than ``length`` keep all.
    A repeated row repeats its whole text.  A null key keeps its row.  Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = _rows(docs, key, text)
    spans = _repeats(rows, kind, length, True).select("key", "th", F.struct(F.greatest(F.col("pos") - F.col("back"), F.lit(0)).alias("a"), (F.col("pos") + F.col("ahead")).alias("b")).alias("x"))
    by_doc = spans.groupBy(F.col("key").alias("k2"), F.col("th").alias("t2")).agg(F.collect_set("x").alias("found"))
    texts = _packed(rows, kind)
    joined = texts.join(by_doc, texts["key"].eqNullSafe(by_doc["k2"]) & (texts["th"] == by_doc["t2"]), "left").select("key", "packed", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for part in batches:
            size, removed, digest = [], [], []
            for packed, found in zip(part.column("packed").to_pylist(), part.column("found").to_pylist()):
                t = unpack.decompress(packed)
                runs: list[list[int]] = []
                for x in sorted((x["a"], min(x["b"], len(t))) for x in found or ()):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append(list(x))
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(t[at:a])
                    at = b
                kept.update(t[at:])
                size.append(len(t))
                removed.append([{"start": a, "end": b} for a, b in runs])
                digest.append(kept.hexdigest())
            run_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(size, pa.int64()), pa.array([sum(r["end"] - r["start"] for r in x) for x in removed], pa.int64()),
                                              pa.array([len(x) for x in removed], pa.int64()), pa.array(digest), pa.array(removed, run_kind)],
                                             names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return joined.mapInArrow(cut, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>").withColumnRenamed("key", key)
