"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (``SEED`` consecutive words) are compared.  Tiling repeatedly marks the
longest common word sequence that overlaps no earlier tile, so passages whose sentences were reordered still add up.
The share of an item's words under tiles decides.

The benchmark is taken in blocks of bounded size: each is broadcast and all documents are compared with it, so a
benchmark of any size costs one pass per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.base import byte_texts, chunks, words

SEED = 4  # words of a seed; also the shortest tile
COVERAGE = 0.6
BLOCK_WORDS = 1_000_000  # words of benchmark text broadcast at a time


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` words (modulo 2**64, by doubling)."""
    with np.errstate(over="ignore"):
        base, power = np.uint64(0x9E3779B97F4A7C15), None
        h = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x1B873593)
        out, done, width, power = None, 0, 1, base
        rest = size
        while rest:
            if rest & 1:
                if out is None:
                    out = h
                else:  # the first ``done`` words, then ``width`` more
                    n = len(ids) - (done + width) + 1
                    out = out[:n] * power + h[done:done + n]
                done += width
            rest >>= 1
            if rest:
                n = len(ids) - 2 * width + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                h = h[:n] * power + h[width:width + n]
                width, power = 2 * width, power * power
        return out


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the tiles; words are numbers, -1 in ``doc`` matches nothing.

    The search length starts at the item's length and falls to ``least``.  At each length the runs of unmarked words of
    both sides are hashed, equal hashes compared, and matches marked from left to right.  A match longer than the search
    length would have been marked before, so each round marks the longest that are left.
    """
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []

    def runs(ids: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        blocked = np.concatenate([[0], np.cumsum(~free | (ids < 0))])
        at = np.nonzero(blocked[size:] == blocked[:-size])[0]
        return at, _rolling(ids, size)[at] if len(at) else np.zeros(0, np.uint64)

    def longest() -> int:
        """Length of the longest common unmarked run, by bisection: a run holds all its shorter ones."""
        low, high = least - 1, min(int(free_i.sum()), len(doc))
        while low < high:
            mid = (low + high + 1) // 2
            a, ha = runs(doc, free_d, mid)
            b, hb = runs(item, free_i, mid)
            if len(a) and len(b) and np.isin(hb, ha).any():
                low = mid
            else:
                high = mid - 1
        return low

    while min(len(doc), int(free_i.sum())) >= least:
        size = longest()
        if size < least:
            break
        a, ha = runs(doc, free_d, size)
        b, hb = runs(item, free_i, size)
        order = np.argsort(ha, kind="stable")
        marked = False
        for j, h in zip(b.tolist(), hb):
            if not free_i[j:j + size].all():
                continue
            lo, hi = np.searchsorted(ha[order], [h, h], "left")[0], np.searchsorted(ha[order], h, "right")
            for k in a[order[lo:hi]].tolist():
                if free_d[k:k + size].all() and np.array_equal(doc[k:k + size], item[j:j + size]):
                    free_d[k:k + size] = free_i[j:j + size] = False
                    out.append((k, j, size))
                    marked = True
                    break
        if not marked:
            break
    return out


class _Block:
    """A block of the benchmark: its words as numbers, items as number arrays, seeds sorted by hash."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.number: dict[bytes, int] = {}
        self.items = [(i, np.array([self.number.setdefault(w, len(self.number)) for w in ws], np.int64)) for i, ws in items]
        seeds, owner = [], []
        for k, (_, ids) in enumerate(self.items):
            h = _rolling(ids, min(SEED, len(ids))) if len(ids) else np.zeros(0, np.uint64)
            seeds.append(h)
            owner.append(np.full(len(h), k))
        seeds, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, owner))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order].astype(np.uint64), owner[order]
        self.short = sorted({len(ids) for _, ids in self.items if 0 < len(ids) < SEED})

    def hits(self, ids: np.ndarray) -> list[int]:
        """Items that share a seed (items shorter than a seed: their whole text)."""
        found: list[np.ndarray] = []
        known = ids >= 0
        for size in [*self.short, SEED]:
            if len(ids) < size:
                continue
            ok = np.nonzero(np.convolve(known, np.ones(size, np.int64), "valid") == size)[0] if size > 1 else np.nonzero(known)[0]
            if not len(ok):
                continue
            h = np.unique(_rolling(ids, size)[ok])
            lo, hi = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
            found += [self.owner[a:b] for a, b in zip(lo[hi > lo], hi[hi > lo])]
        return np.unique(np.concatenate(found)).tolist() if found else []


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, list[bytes]]]]:
    block, size = [], 0
    for r in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        ws = words(r.t.encode())
        if block and size + len(ws) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.i, ws))
        size += len(ws)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item, n_tiles, covered, item_words, coverage): pairs whose tiles cover at least ``coverage`` of the item's words.

    Words are A-Z lower-cased.  Null, empty and blank texts on either side match nothing; an item of fewer words than a
    seed matches as a whole.  Repeated documents and items are compared as often as they occur.  Other columns are ignored.
    """
    kinds = f"key {docs.schema[key].dataType.simpleString()}, item {benchmark.schema[item].dataType.simpleString()}"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"{kinds}, n_tiles long, covered long, item_words long, coverage double"
    context = docs.sparkSession.sparkContext

    def compared(block: list[tuple[int, list[bytes]]]) -> DataFrame:
        shared = context.broadcast(block)
        made: list[_Block] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not made:
                made.append(_Block(shared.value))
            b = made[0]
            for part in chunks(batches, "text"):
                keys, out = part.column("key"), []
                for row, t in enumerate(byte_texts(part.column("text"))):
                    ws = words(t)
                    ids = np.fromiter((b.number.get(w, -1) for w in ws), np.int64, len(ws))
                    for k in b.hits(ids) if len(ids) else ():
                        name, want = b.items[k]
                        found = tiles(ids, want, min(SEED, len(want)))
                        covered = sum(x[2] for x in found)
                        if covered >= coverage * len(want):
                            out.append((row, name, len(found), covered, len(want), covered / len(want)))
                cols = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0], pa.int64())), *(pa.array(c) for c in cols[1:])] if out else
                                                 [keys.slice(0, 0), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                                                 names=["key", "item", "n_tiles", "covered", "item_words", "coverage"])

        return rows.mapInArrow(run, schema)

    out: DataFrame | None = None
    for block in _blocks(benchmark, item, text):
        out = compared(block) if out is None else out.union(compared(block))
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"key": key, "item": item})


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **kw) -> DataFrame:  # noqa: ANN003
    """``docs`` without the contaminated ones (all rows of a contaminated key go; rows with a null key stay)."""
    bad = contamination(docs, benchmark, key=key, **kw).select(key).distinct()
    return docs.join(bad, key, "left_anti")
