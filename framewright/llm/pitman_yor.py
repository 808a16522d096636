"""Language model scoring by a hierarchical Pitman-Yor model of words and their spelling.

Tokens are words, A-Z lower-cased, and one end per text.  Every word (the end before a text's first) has a restaurant of
the training tokens that follow it.  The parent of all of these is one restaurant of words, whose customers are their
tables; its parent spells words byte by byte, so every word, known or not, has a probability and those of all word sequences add up to
one.  In the spelling model a restaurant is a context of up to four bytes, a mark standing before the word; its parent
lacks the byte furthest back; the last parent is uniform over bytes.  A context's customers are the tables of its
children, at the longest contexts one spelling per table of a word.  A text's score is the sum of its tokens' log10
probabilities, so the probabilities of all texts add up to one at most.

Seating is sampled by Gibbs on the number of tables of each dish in each restaurant, given all others: exactly, by the
generalised Stirling numbers, for up to ``EXACT`` customers; later ones are seated in turn, in blocks of doubling size.
The weights of a dish and of its parent are averaged over samples, so the averaged predictive probabilities still add up.

Texts are cut into batches that number their words and pairs of words themselves.  Only hashes of pairs are dealt out to be counted;
the answers name for each pair one batch that is to seat it, so the restaurant of a frequent word is spread over all batches; its
customers and tables are sums.  Between the rounds, all pairs are seated given those sums.

Spelling restaurants are dealt out by their last two bytes, so a context and its parents down to that length sit together.
What is above (at most 65,536 dishes of one-byte contexts) is seated on the driver between the rounds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.base import byte_texts, chunks, mix
from framewright.session import written

EXACT = 48
ROUNDS, BURN_IN, SAMPLES = 2, 3, 4
DISCOUNT, STRENGTH = (0.5, 0.6, 0.7, 0.75, 0.8, 0.7, 0.75), (1.0,) * 7  # by context length; then words, and words after a word
WORD, CONTEXT = 5, 6
PART_PAIRS = 1_000_000  # pairs asked of one part of the hash range
MODEL_ROWS = 2_000_000  # rows of the model broadcast at a time
COUNT_ROWS = 200_000  # words or n-grams a task holds before it passes them on
BATCH = 6 << 20  # bytes of text in one batch; tasks hold about twenty times as much
END = b"\n"


def _codes(streams: list[bytes]) -> np.ndarray:
    """Five bytes ending at each byte of each stream but its first (its kind), as one number; newlines stand before a stream."""
    b = np.frombuffer(b"".join(b"\n\n\n" + s for s in streams), np.uint8).astype(np.uint64)
    code = b[4:].copy()
    for k in range(1, 5):
        code |= b[4 - k:len(b) - k] << np.uint64(8 * k)
    lens = np.array([len(s) - 1 for s in streams])
    starts = np.concatenate([[0], np.cumsum(lens + 4)[:-1]])
    keep = np.ones(len(code), bool)
    for s in starts[1:]:
        keep[s - 4:s] = False  # the newlines and the kind of the next stream
    return code[keep]


def _mark(kind: int = 0) -> bytes:
    """The byte that stands before a word."""
    return bytes([14 + kind])


def _counts(types: DataFrame) -> DataFrame:
    """(code, n): five-byte sequences in the spellings of the words, one spelling for each of their ``t`` tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["code", "n"])

        for part in chunks(batches, "word", 1 << 20):
            ws = part.column("word").to_pylist()
            k, at = np.unique(_codes([w + END for w in ws]), return_inverse=True)
            c = np.bincount(at, np.repeat(part.column("t").to_numpy(), [len(w) for w in ws])).astype(np.int64)
            both = np.concatenate([keys, k])
            keys, at = np.unique(both, return_inverse=True)
            n = np.bincount(at, np.concatenate([n, c])).astype(np.int64)
            if len(keys) > COUNT_ROWS:
                yield out()
                keys, n = keys[:0], n[:0]
        yield out()

    return types.select("word", "t").where("t > 0").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _stirling(d: float) -> np.ndarray:
    """log of the generalised Stirling numbers S_d(c, t) for c, t <= EXACT."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(1, EXACT + 1):
        for t in range(1, c + 1):
            stay = s[c - 1, t] + np.log(c - 1 - d * t) if c - 1 - d * t > 0 else -np.inf
            s[c, t] = np.logaddexp(s[c - 1, t - 1], stay)
    return s


_STIRLING = [_stirling(d) for d in DISCOUNT]


_WIDTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, EXACT)


def seat(c: np.ndarray, others: np.ndarray, lp: np.ndarray, level: int, rng: np.random.Generator) -> np.ndarray:
    """New table numbers of all dishes: c customers, tables of the others in the restaurant, log of the probability under the parent.

    Dishes of about as many customers are drawn together, so a dish costs what its customers need."""
    d, theta, log_s = DISCOUNT[level], STRENGTH[level], _STIRLING[level]
    out = np.ones_like(c)
    first = np.minimum(c, EXACT)
    order = np.argsort(first.astype(np.int8), kind="stable")
    cuts = np.searchsorted(first[order], _WIDTHS, "right")
    for width, start, stop in zip(_WIDTHS[1:], cuts, cuts[1:]):
        steps = np.arange(1, width + 1)
        for k in range(start, stop, max(1, 400_000 // width)):
            at = order[k:min(stop, k + max(1, 400_000 // width))]
            weight = np.log(theta + d * (others[at][:, None] + (steps - 1)))
            np.cumsum(weight, axis=1, out=weight)
            weight += log_s[first[at], 1:width + 1]
            weight += steps * lp[at][:, None]
            weight -= weight.max(1, keepdims=True)
            np.cumsum(np.exp(weight, out=weight), axis=1, out=weight)
            tables = np.minimum(1 + (weight <= (rng.random(len(at)) * weight[:, -1])[:, None]).sum(1), first[at])
            seated, left, p = first[at].astype(np.float64), (c[at] - first[at]).astype(np.int64), np.exp(lp[at])
            while left.any():
                block = np.minimum(left, np.maximum(1, seated.astype(np.int64)))
                middle = seated + block / 2
                new = (theta + d * (others[at] + tables)) * p
                chance = np.clip(new / (new + np.maximum(middle - d * tables, 1e-9)), 0, 1)
                tables = tables + rng.binomial(block, chance)
                seated, left = seated + block, left - block
            out[at] = tables
    return out


def _reseated(c: np.ndarray, t: np.ndarray, ctx: np.ndarray, p: np.ndarray, level: int, rng: np.random.Generator) -> np.ndarray:
    """``seat`` for whole restaurants: t tables now, restaurant number, probability under the parent."""
    t = np.minimum(t, c)
    return np.minimum(seat(c, np.bincount(ctx, t)[ctx] - t if len(c) else t, np.log(p), level, rng), c)


class _Level:
    """Dishes of all restaurants of one context length: key is context and dish."""

    def __init__(self, key: np.ndarray, level: int):
        self.level, self.key = level, key
        self.ctx_key, self.ctx = np.unique(key >> np.uint64(8), return_inverse=True)
        self.c, self.t = np.zeros(len(key), np.int64), np.ones(len(key), np.int64)
        self.own, self.up, self.samples = np.zeros(len(key)), np.zeros(len(self.ctx_key)), 0

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        d, theta = DISCOUNT[self.level], STRENGTH[self.level]
        customers, tables = np.bincount(self.ctx, self.c), np.bincount(self.ctx, self.t)
        return (self.c - d * self.t) / (theta + customers)[self.ctx], (theta + d * tables) / (theta + customers)

    def keep(self) -> None:
        own, up = self.weights()
        self.own, self.up, self.samples = self.own + own, self.up + up, self.samples + 1


class _Tree:
    """Levels four to two of some restaurants, above them fixed probabilities ``top`` of (byte, dish)."""

    def __init__(self, code: np.ndarray, n: np.ndarray, top: np.ndarray, seed: int):
        self.rng, self.top = np.random.default_rng(seed), top
        self.levels, key = [], np.sort(code)
        for level, mask in ((4, (1 << 40) - 1), (3, (1 << 32) - 1), (2, (1 << 24) - 1)):
            key = np.unique(key & np.uint64(mask))
            self.levels.append(_Level(key, level))
        self.levels[0].c = n[np.argsort(code)].astype(np.int64)
        self.parent = [np.searchsorted(b.key, a.key & np.uint64((1 << (8 * (b.level + 1))) - 1)) for a, b in zip(self.levels, self.levels[1:])]
        for k, at in enumerate(self.parent):
            self.levels[k + 1].c = np.bincount(at, self.levels[k].t, len(self.levels[k + 1].key)).astype(np.int64)

    def probabilities(self, weights: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        two = self.levels[2]
        last = self.top[(two.key & np.uint64(0xFFFF)).astype(np.int64)]
        out = []
        for k in (2, 1, 0):
            own, up = weights[k]
            last = own + up[self.levels[k].ctx] * (last if k == 2 else last[self.parent[k]])
            out.append(last)
        return out[::-1]

    def sweep(self) -> None:
        """One Gibbs sweep, children first; tables become the parent's customers."""
        p = self.probabilities([x.weights() for x in self.levels])
        for k, x in enumerate(self.levels):
            above = self.top[(x.key & np.uint64(0xFFFF)).astype(np.int64)] if k == 2 else p[k + 1][self.parent[k]]
            x.t = _reseated(x.c, x.t, x.ctx, above, x.level, self.rng)
            if k < 2:
                self.levels[k + 1].c = np.bincount(self.parent[k], x.t, len(self.levels[k + 1].key)).astype(np.int64)


def _bundle(frame: pd.DataFrame, top: np.ndarray, seed: int) -> _Tree:
    code = frame["code"].to_numpy().view(np.uint64) if frame["code"].dtype == np.int64 else frame["code"].to_numpy().astype(np.uint64)
    return _Tree(code, frame["n"].to_numpy(), top, seed)


def _top(rows: list, sweeps: int = 6) -> np.ndarray:
    """Probabilities of (byte, dish) from the tables of their children; both upper levels are seated here."""
    c = np.zeros(65536, np.int64)
    for r in rows:
        c[r.k] = r.t
    rng = np.random.default_rng(11)
    key = np.nonzero(c)[0].astype(np.uint64)
    one, root = _Level(key, 1), _Level(np.unique(key & np.uint64(255)), 0)
    one.c = c[key.astype(np.int64)]
    up = np.searchsorted(root.key, key & np.uint64(255))
    acc, kept = np.zeros((256, 256)), 0
    for s in range(sweeps):
        root.c = np.bincount(up, one.t, len(root.key)).astype(np.int64)
        root.t = np.minimum(root.t, root.c)
        own0, up0 = root.weights()
        base = np.full(256, float(up0[0]) / 256 if len(up0) else 1 / 256)
        base[root.key.astype(np.int64)] += own0
        own1, up1 = one.weights()
        p = np.tile(base, (256, 1))
        seen = one.ctx_key.astype(np.int64)
        p[seen] *= up1[:, None]
        p[(key >> np.uint64(8)).astype(np.int64), (key & np.uint64(255)).astype(np.int64)] += own1
        if s >= sweeps // 2:
            acc, kept = acc + p, kept + 1
        if len(key):
            one.t = _reseated(one.c, one.t, one.ctx, base[(key & np.uint64(255)).astype(np.int64)], 1, rng)
            root.c = np.bincount(up, one.t, len(root.key)).astype(np.int64)
            root.t = _reseated(root.c, root.t, root.ctx, np.full(len(root.key), 1 / 256), 0, rng)
    return (acc / kept).ravel()


def fitted(types: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(bundle, kind, key, value) rows of the model, and the dense probabilities of (byte, dish).

    kind 4, 3, 2: probability of context and dish; kind 14, 13, 12: the parent's weight in a context.
    """
    parts = int(types.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last_two = F.shiftrightunsigned("code", 8).bitwiseAND(F.lit(0xFFFF))
    counts = written(_counts(types).withColumn("bundle", F.pmod(F.xxhash64(last_two), F.lit(parts)).cast("int")), "model-counts")

    def tables(above: np.ndarray, seed: int):  # noqa: ANN202
        def seated(frame: pd.DataFrame) -> pd.DataFrame:
            tree = _bundle(frame, above, seed * 1_000_003 + int(frame["bundle"].iloc[0]))
            for _ in range(BURN_IN):
                tree.sweep()
            two = tree.levels[2]
            t = np.bincount((two.key & np.uint64(0xFFFF)).astype(np.int64), two.t, 65536).astype(np.int64)
            return pd.DataFrame({"k": np.nonzero(t)[0], "t": t[np.nonzero(t)[0]]})

        return seated

    top = np.full(65536, 1 / 256)
    for r in range(ROUNDS):
        top = _top(counts.groupBy("bundle").applyInPandas(tables(top, r), "k long, t long").groupBy("k").agg(F.sum("t").alias("t")).collect())

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["bundle"].iloc[0])
        tree = _bundle(frame, top, 77 + number)
        for s in range(BURN_IN + SAMPLES):
            tree.sweep()
            if s >= BURN_IN:
                for x in tree.levels:
                    x.keep()
        p = tree.probabilities([(x.own / x.samples, x.up / x.samples) for x in tree.levels])
        rows = []
        for x, q in zip(tree.levels, p):
            rows += [pd.DataFrame({"kind": x.level, "key": x.key.view(np.int64), "value": q}),
                     pd.DataFrame({"kind": 10 + x.level, "key": x.ctx_key.view(np.int64), "value": x.up / x.samples})]
        return pd.concat(rows).assign(bundle=number)[["bundle", "kind", "key", "value"]]

    return written(counts.groupBy("bundle").applyInPandas(model, "bundle int, kind int, key long, value double"), "model"), top


class _Table:
    """Numbers by key: an open hash table searched for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, 2**64 - 1, np.uint64), np.zeros(1 << bits)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            s = slot[left]
            free = self.keys[s] == np.uint64(2**64 - 1)
            _, one = np.unique(s[free], return_index=True)
            put = left[free][one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
        """(values, positions of the missing)."""
        slot = self._slot(keys)
        out, found = self.values[slot], self.keys[slot]
        left = np.nonzero(found != keys)[0]
        gone = []
        while len(left):
            empty = self.keys[slot[left]] == np.uint64(2**64 - 1)
            gone.append(left[empty])
            left = left[~empty]
            slot[left] = (slot[left] + 1) & self.mask
            hit = self.keys[slot[left]] == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit]
        gone_all = np.concatenate(gone) if gone else left
        out[gone_all] = missing
        return out, gone_all


class _Block:
    """The part of the model for some bundles; scores the bytes whose restaurants it holds."""

    def __init__(self, rows: pa.Table, top: np.ndarray, twos: np.ndarray | None):
        kind, key, value = (rows.column(c).to_numpy() for c in ("kind", "key", "value"))
        self.tables = {k: _Table(key[kind == k].view(np.uint64), value[kind == k]) for k in (4, 3, 2, 14, 13, 12)}
        self.top, self.twos = top, twos

    def logs(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each last byte given those before it; 0 for bytes of other blocks."""
        p, at = self.tables[4].get(code, 0.0)
        if len(at):
            c = code[at]
            q, up = np.zeros(len(c)), np.ones(len(c))
            left = np.arange(len(c))
            for level, bits in ((4, 40), (3, 32), (2, 24)):
                if level < 4:
                    v, miss = self.tables[level].get(c[left] & np.uint64((1 << bits) - 1), 0.0)
                    q[left] = v
                    left = left[miss]
                if not len(left):
                    break
                up[left] *= self.tables[10 + level].get((c[left] & np.uint64((1 << bits) - 1)) >> np.uint64(8), 1.0)[0]
            q[left] = self.top[(c[left] & np.uint64(0xFFFF)).astype(np.int64)]
            p[at] = up * q
        out = np.log10(p)
        if self.twos is not None:
            out[~self.twos[((code >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]] = 0.0
        return out

    def spelled(self, some: list[bytes]) -> np.ndarray:
        """log10 probability of each word's spelling; the kind's byte comes first."""
        out = [np.zeros(0)]
        for k in range(0, len(some), 8_000):
            group = [w + END for w in some[k:k + 8_000]]
            ends = np.cumsum([len(w) - 1 for w in group])
            out.append(np.add.reduceat(self.logs(_codes(group)), np.concatenate([[0], ends[:-1]])))
        return np.concatenate(out)


def _blocks(model: DataFrame) -> list[list[int]]:
    sizes = sorted((r["count"], r["bundle"]) for r in model.groupBy("bundle").count().collect())
    out: list[list[int]] = [[]]
    held = 0
    for n, b in sizes:
        if out[-1] and held + n > MODEL_ROWS:
            out.append([])
            held = 0
        out[-1].append(b)
        held += n
    return out


def _log_sum(own: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10(own + 10 ** rest), also where a double cannot hold the power."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(own), rest * np.log(10)) / np.log(10)


def _pack(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())


def _unpack(data: bytes, kind: type = np.uint64) -> np.ndarray:
    raw = np.frombuffer(bytearray(zstandard.ZstdDecompressor().decompress(data)), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_counts(x: np.ndarray) -> bytes:
    return _pack(x.astype(np.uint64))


def _pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return _pack(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def _unpack_counts(data: bytes) -> np.ndarray:
    return _unpack(data).astype(np.int64)


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _layout(some: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the words, a zero first, their bytes)."""
    _, ends, data = some.buffers()
    ends = np.frombuffer(ends, np.int64)[some.offset:some.offset + len(some) + 1]
    return ends - ends[0], np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]


def _words(lens: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _pack_words(some: pa.LargeBinaryArray) -> bytes:
    ends, data = _layout(some)
    lens = np.ascontiguousarray(np.diff(ends).view(np.uint8).reshape(len(some), 8).T)
    return zstandard.ZstdCompressor(1).compress(len(some).to_bytes(8, "little") + lens.tobytes() + data.tobytes())


def _unpack_words(data: bytes) -> pa.LargeBinaryArray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    return _words(np.ascontiguousarray(raw[8:8 + 8 * n].reshape(8, n).T).view(np.int64).ravel(), raw[8 + 8 * n:].copy())


def _hashes(some: pa.LargeBinaryArray) -> np.ndarray:
    """64-bit hashes of words: mixed sums of numbers that stand for a byte at its place."""
    ends, data = _layout(some)
    lens = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1], lens)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(((place << 8) | data).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
        return mix(sums[ends[1:]] - sums[ends[:-1]] + lens.astype(np.uint64))


def _joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def _pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(before) + word)


def _edges(parts: int) -> np.ndarray:
    return np.array([(2**64 * k) // parts for k in range(parts)], np.uint64)


def _slices(v: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, start, end) of the parts that sorted hashes fall into."""
    cuts = np.searchsorted(v, edges).tolist() + [len(v)]
    return [(k, cuts[k], cuts[k + 1]) for k in range(len(edges)) if cuts[k + 1] > cuts[k]]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct values, a place of each, the number of the value at each place)."""
    place = np.argsort(x)
    v = x[place]
    new = np.concatenate([[True], v[1:] != v[:-1]])[:len(x)]
    at = np.empty(len(x), np.int64)
    at[place] = np.cumsum(new) - 1
    return v[new], place[new], at


def _tokens(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of all texts, each text's followed by its end, an empty word; tokens of each text."""
    joined = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    inside = (joined != 32) & ((joined < 9) | (joined > 13))
    change = np.flatnonzero(np.diff(inside, prepend=False))
    starts, stops = change[::2], change[1::2]  # a blank ends the last text
    before = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    lens = np.insert(stops - starts, before, 0)
    return _words(lens, joined[inside]), np.diff(before, prepend=0) + 1


class _Batch:
    """Some texts: their distinct words in the order of their hashes and, after ``pair``, their distinct pairs of words in that of theirs.

    ``c`` has how often each pair occurs in texts that are learnt from; ``ids`` the word of each token, ``at`` the pair that ends in it."""

    def __init__(self, words_: bytes, ids: bytes, n: np.ndarray, held: np.ndarray):
        some = _unpack_words(words_)
        hashes = _hashes(some)
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.hashes, self.ids = some.take(pa.array(order)), hashes[order], place[_unpack(ids, np.uint32)]
        self.learnt = np.repeat(~held, n)

    def count(self) -> np.ndarray:
        """How often each word occurs in texts that are learnt from."""
        return np.bincount(self.ids[self.learnt], minlength=len(self.hashes))

    def pair(self) -> _Batch:
        w = self.ids
        u = np.concatenate([w[-1:], w[:-1]])  # an end stands before every text and ends the last
        self.v, one, self.at = _distinct(_pair_hash(self.hashes[u], self.hashes[w]))
        self.u, self.w = u[one], w[one]
        self.c = np.bincount(self.at[self.learnt], minlength=len(self.v))
        return self


def _columns(part: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in part.columns))


def _seated(c: np.ndarray, total: float, lp: np.ndarray, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Tables of words after the last sweep, and their average over the kept sweeps.

    They have c customers and the log10 probability lp under the parent; the restaurant has ``total`` tables."""
    rng = np.random.default_rng(seed)
    t, mean = np.minimum(c, 1), np.zeros(len(c))
    others = total - t
    for k in range(BURN_IN + SAMPLES):
        t = np.minimum(seat(c, others, lp * np.log(10), WORD, rng), c)
        mean += t if k >= BURN_IN else 0
    return t, mean / SAMPLES


def scored(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text; log10.

    Tokens are the words and one end.  Both models learn from the texts that are not held out.  Null texts are empty and
    consist of their end.  A null ``held_out`` counts as false.  Repeated rows are learnt from and returned as often as they occur.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))

    def batch(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as numbers of their distinct words, the most frequent first."""
        for part in chunks(data, "text", BATCH):
            spelt, n = _tokens(byte_texts(part.column("text")))
            coded = spelt.dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.argsort(-np.bincount(code), kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([part.column("key").to_pylist()], pa.list_(part.column("key").type)), pa.array([part.column("held").to_pylist()]),
                 pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([_pack_words(coded.dictionary.take(pa.array(order)))], pa.binary()), pa.array([_pack(place[code])], pa.binary()),
                 pa.array([int(n.sum())], pa.int64())], names=["bid", "keys", "held", "n", "words", "ids", "tokens"])

    batches = written(rows.mapInArrow(batch, f"bid string, keys array<{kind}>, held array<boolean>, n array<long>, words binary, ids binary, tokens long"), "score-batches")
    asks = int(batches.agg(F.sum("tokens")).first()[0] or 0)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Hash ranges that pairs and words are dealt to.
    pair_edges = _edges(max(min(few, asks // 100_000 + 1), asks // PART_PAIRS + 1))
    word_edges = _edges(max(min(few, asks // 400_000 + 1), asks // (4 * PART_PAIRS) + 1))

    def ask(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in data:
            for bid, held, n, some, ids in _columns(part):
                b = _Batch(some, ids, np.array(n), np.array(held, bool)).pair()
                own = _slices(b.v, pair_edges)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in own], pa.int32()), pa.array([bid] * len(own)), pa.array([_pack_sorted(b.v[x:y]) for _, x, y in own], pa.binary()),
                                                  pa.array([_pack_counts(b.c[x:y]) for _, x, y in own], pa.binary())], names=["part", "bid", "v", "c"])

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        """Training counts of the pairs of one hash range.

        Those seen more than once are numbered, and one of the batches that learnt a pair, by the pair's hash, is to seat it."""
        frame = frame.sort_values("bid")
        asked = [_unpack_sorted(x) for x in frame["v"]]
        c = np.concatenate([_unpack_counts(x) for x in frame["c"]])
        v, _, at = _distinct(np.concatenate(asked))
        n = np.bincount(at, c).astype(np.int64)
        number = np.cumsum(n > 1) - 1
        many = (n > 1)[at]
        some = np.nonzero(many & (c > 0))[0]
        some = some[np.argsort(at[some], kind="stable")]
        pair, start, size = np.unique(at[some], return_index=True, return_counts=True)
        mine = np.zeros(len(at), bool)
        mine[some[start + (v[pair] % size.astype(np.uint64)).astype(np.int64)]] = True
        ends = np.cumsum([len(x) for x in asked])
        cut = [slice(e - len(x), e) for e, x in zip(ends, asked)]
        return pd.DataFrame({"bid": frame["bid"], "part": frame["part"], "n": [_pack_counts(n[at[k]]) for k in cut], "g": [_pack_sorted(number[at[k]][many[k]]) for k in cut],
                             "mine": [_pack(mine[k][many[k]].astype(np.uint8)) for k in cut]})

    replies = written(batches.select("bid", "held", "n", "words", "ids").mapInArrow(ask, "part int, bid string, v binary, c binary").groupBy("part").applyInPandas(
        counted, "bid string, part int, n binary, g binary, mine binary"), "score-replies")

    def gathered(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """What a batch learns from: tables of pairs seen once by their words, and the pairs it is to seat."""
        right = right.sort_values("part")
        out = []
        for r in left.itertuples():
            b = _Batch(r.words, r.ids, np.asarray(r.n), np.asarray(r.held, bool)).pair()
            n = _joined([_unpack_counts(x) for x in right["n"]])
            parts = np.repeat(right["part"].to_numpy(), [len(_unpack(x)) for x in right["n"]])
            own = _joined([_unpack(x, np.uint8) for x in right["mine"]], np.uint8) > 0
            at, g = np.nonzero(n > 1)[0][own], _joined([_unpack_sorted(x) for x in right["g"]], np.uint64)[own]
            once, size = (n == 1) & (b.c > 0), len(b.hashes)
            cuts = [(k, y - x) for k, x, y in _slices(b.hashes, word_edges)]
            out.append([r.bid, *(_pack_counts(np.bincount(x[once], minlength=size)) for x in (b.u, b.w)),
                        *(_pack_counts(np.array([c[k] for c in cuts])) for k in (0, 1)), *(_pack_counts(x) for x in (parts[at], g, b.u[at], b.w[at], n[at]))])
        return pd.DataFrame(out, columns=names)

    names = ["bid", "once_u", "once_w", "wparts", "sizes", "parts", "g", "u", "w", "n"]
    mine = written(batches.select("bid", "held", "n", "words", "ids").groupBy("bid").cogroup(replies.groupBy("bid")).applyInPandas(
        gathered, "bid string, " + ", ".join(f"{k} binary" for k in names[1:])), "score-mine")

    def tables(size: int, once: np.ndarray, at: np.ndarray, t: np.ndarray, weight: int = 1) -> np.ndarray:
        return once * weight + np.bincount(at, t, size).astype(np.int64)

    def start(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the words' tables if every pair has one."""
        for part in data:
            for bid, once_u, once_w, wparts, sizes, u, w in _columns(part):
                once_u, once_w, u, w, to, ends = (_unpack_counts(x) for x in (once_u, once_w, u, w, wparts, sizes))
                sums, ends = [tables(len(once), once, x, np.ones(len(x))) for once, x in ((once_u, u), (once_w, w))], np.cumsum(ends)
                cut = [slice(x, y) for x, y in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([pa.array([bid] * len(to)), pa.array([1] * len(to), pa.int32()), pa.array(to.astype(np.int32)), *(
                    pa.array([_pack_counts(x[k]) for k in cut], pa.binary()) for x in (*sums, np.zeros(len(once_u))))], names=["bid", "what", "to", "a", "b", "c"])

    def deal(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in data:
            for bid, held, n, some, ids in _columns(part):
                b = _Batch(some, ids, np.array(n), np.array(held, bool))
                count, own = b.count(), _slices(b.hashes, word_edges)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in own], pa.int32()), pa.array([bid] * len(own)), pa.array([_pack_words(b.words[x:y]) for _, x, y in own], pa.binary()),
                                                  pa.array([_pack_counts(count[x:y]) for _, x, y in own], pa.binary())], names=["wpart", "bid", "a", "b"])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        """The words of one hash range in one row, and for each batch which of them it has."""
        lists = [_unpack_words(x) for x in frame["a"]]
        some = pa.concat_arrays(lists)
        _, one, at = _distinct(_hashes(some))
        n = np.bincount(at, np.concatenate([_unpack_counts(x) for x in frame["b"]]))
        ends = np.cumsum([len(x) for x in lists])
        return pd.DataFrame({"wpart": int(frame["wpart"].iloc[0]), "bid": ["", *frame["bid"]], "a": [_pack_words(some.take(pa.array(one))), *(_pack_sorted(at[e - len(x):e]) for e, x in zip(ends, lists))],
                             "b": [_pack_counts(n), *([b""] * len(lists))], "tokens": [int(n.sum()), *([0] * len(lists))], "known": [int((n > 0).sum()), *([0] * len(lists))]})

    dealt = written(batches.select("bid", "held", "n", "words", "ids").mapInArrow(deal, "wpart int, bid string, a binary, b binary").groupBy("wpart").applyInPandas(
        merged, "wpart int, bid string, a binary, b binary, tokens long, known long"), "score-words")
    n_all, v_all = (int(x or 0) for x in dealt.agg(F.sum("tokens"), F.sum("known")).first())
    askers = dealt.where("bid <> ''").select("wpart", "bid", "a")

    def word_rows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """(wpart, k, word, n, lp, c, tu, kept): n tokens of each word, c tables in all contexts, tu tables as a context, and their sum over the kept sweeps.

        Every training token is followed by another or stands before a text, so n is also the customers of a word as a context."""
        head, subs = left[left["bid"] == ""].iloc[0], left[left["bid"] != ""]
        some, n = _unpack_words(head["a"]).to_pylist(), _unpack_counts(head["b"])
        at, right = np.concatenate([_unpack_sorted(x).astype(np.int64) for x in subs.sort_values("bid")["a"]]), right.sort_values("bid")
        tu, c, kept = (np.bincount(at, np.concatenate([_unpack_counts(x) for x in right[k]]), len(n)).astype(np.int64) for k in "abc")
        # Until spellings are counted a byte costs one digit.
        return pd.DataFrame({"wpart": int(head["wpart"]), "k": np.arange(len(n)), "word": [_mark() + w for w in some], "n": n, "lp": [-1.0 - len(w) for w in some], "c": c, "tu": tu, "kept": kept})

    kinds = {"wpart": "int", "k": "int", "word": "binary", "n": "long", "lp": "double", "c": "long", "tu": "long", "kept": "long", "t": "long", "mean": "double"}
    d, theta = DISCOUNT[WORD], STRENGTH[WORD]

    def schema(names: list[str]) -> str:
        return ", ".join(f"{k} {kinds[k]}" for k in names)

    def state(seats: DataFrame, names: list[str], total: float, seed: int) -> tuple[DataFrame, float, float]:
        """Words seated anew given the tables of all pairs; their customers and tables in all."""

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            x = word_rows(left, right)
            x["t"], x["mean"] = _seated(x["c"].to_numpy(), total, x["lp"].to_numpy(), [seed, int(x["wpart"].iloc[0])])
            return x[names]

        return counted_words(dealt.select("wpart", "bid", "a", "b").groupBy("wpart").cogroup(seats.where("what = 1").groupBy("to")).applyInPandas(run, schema(names)))

    def counted_words(now: DataFrame) -> tuple[DataFrame, float, float]:
        out = written(now, "score-unigrams")
        return out, *(float(x or 0) for x in out.agg(F.sum("c"), F.sum("mean")).first())

    def above(c: float, total: float) -> Column:
        """log10 probability of each word in the restaurant of all words, with ``mean`` tables."""
        own = F.greatest(F.col("c") - d * F.col("mean"), F.lit(0.0))
        rest = F.col("lp") + float(np.log10(theta + d * total))
        # log10(own + 10 ** rest), from the larger of the two
        top = F.when(own > 0, F.greatest(F.log10(own), rest)).otherwise(rest)
        return top + F.log10(F.when(own > 0, F.pow(F.lit(10.0), F.log10(own) - top)).otherwise(0.0) + F.pow(F.lit(10.0), rest - top)) - float(np.log10(theta + c))

    sent = "bid string, what int, to int, a binary, b binary, c binary"

    def told(words_now: DataFrame, real: type) -> DataFrame:
        """To every batch, of its words: p, tokens, and tables as a context (their sum over the kept sweeps if there is one)."""

        def tell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            right = right.sort_values("k")
            at = [_unpack_sorted(x).astype(np.int64) for x in left["a"]]
            p, n, t = right["p"].to_numpy().astype(real), right["n"].to_numpy(), right["t"].to_numpy()
            return pd.DataFrame({"bid": left["bid"], "what": 1, "to": left["wpart"], "a": [_pack(p[k]) for k in at], "b": [_pack_counts(n[k]) for k in at], "c": [_pack_counts(t[k]) for k in at]})

        return askers.groupBy("wpart").cogroup(words_now.groupBy("wpart")).applyInPandas(tell, sent)

    def seating(seed: int, last: bool):  # noqa: ANN202
        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            """The pairs a batch is to seat; sums of its words' tables to the words, and after the last round those of its pairs to the pairs."""
            out = []
            own, right = right[right["what"] == 0], right[right["what"] == 1].sort_values("to")
            for r in left.itertuples():
                n, u, w = (_unpack_counts(x) for x in (r.n, r.u, r.w))
                lp = np.concatenate([_unpack(x, np.float32) for x in right["a"]]).astype(np.float64)[w] * np.log(10)
                total = np.concatenate([_unpack_counts(x) for x in right["c"]])
                t = _unpack_counts(own["a"].iloc[0]) if len(own) else np.ones(len(n), np.int64)
                others, kept = total[u] - t, np.zeros(len(n), np.int64)
                rng = np.random.default_rng([seed, int(r.bid[:8], 16)])
                for k in range(BURN_IN + SAMPLES):
                    t = np.minimum(seat(n, others, lp, CONTEXT, rng), n)
                    kept += t if k >= BURN_IN else 0
                once_u, once_w, size = _unpack_counts(r.once_u), _unpack_counts(r.once_w), len(total)
                sums = [tables(size, once_u, u, t), tables(size, once_w, w, t), tables(size, once_u, u, kept, SAMPLES)]
                ends = np.cumsum(_unpack_counts(r.sizes))
                out += [(r.bid, 1, to, *(_pack_counts(s[x:y]) for s in sums)) for to, x, y in zip(_unpack_counts(r.wparts), [0, *ends], ends)]
                if not last:
                    out.append((r.bid, 0, -1, _pack_counts(t), b"", b""))
                    continue
                parts, g = _unpack_counts(r.parts), _unpack(r.g)
                cuts = [*np.nonzero(np.diff(parts, prepend=-1))[0], len(parts)]
                out += [(r.bid, 2, parts[x], _pack_sorted(g[x:y]), _pack_counts(kept[x:y]), b"") for x, y in zip(cuts, cuts[1:])]
            return pd.DataFrame(out, columns=["bid", "what", "to", "a", "b", "c"])

        return run

    seats = mine.select("bid", "once_u", "once_w", "wparts", "sizes", "u", "w").mapInArrow(start, sent)
    total, short = float(v_all), ["wpart", "k", "n", "lp", "c", "tu", "mean"]
    for r in range(ROUNDS):
        words_now, c_all, total = state(seats, short, total, r)
        news = told(words_now.select("wpart", "k", above(c_all, total).alias("p"), "n", F.col("tu").alias("t")), np.float32)
        seats = written(mine.groupBy("bid").cogroup((news.unionByName(seats.where("what = 0")) if r else news).groupBy("bid")).applyInPandas(
            seating(50 + r, r == ROUNDS - 1), sent), "score-seats")

    words_now, _, total = state(seats, ["wpart", "k", "word", "n", "c", "kept", "t", "mean"], total, 90)
    model, top = fitted(words_now)
    blocks = _blocks(model)

    def shared(bundles: list[int]):  # noqa: ANN202
        part = model.where(F.col("bundle").isin(bundles)) if len(blocks) > 1 else model
        twos = None
        if len(blocks) > 1:
            two = spark.range(65536).select("id", F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int").alias("b"))
            twos = np.zeros(65536, bool)
            twos[[r.id for r in two.where(F.col("b").isin(bundles)).collect()]] = True
        return spark.sparkContext.broadcast({"model": (part.select("kind", "key", "value").toArrow(), top, twos)})

    def built(value: dict) -> _Block:  # once per worker
        if "block" not in value:
            value["block"] = _Block(*value.pop("model"))
        return value["block"]

    def word_spelling(block, names: list[str], tables_before: float):  # noqa: ANN001, ANN202
        def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = built(block.value)
            for part in data:
                if not part.num_rows:
                    continue
                c, lp = part.column("c").to_numpy(), part.column("lp").to_numpy() + b.spelled(part.column("word").to_pylist())
                new = {"lp": pa.array(lp)}
                if "mean" in names:
                    seed = [91, part.column("wpart")[0].as_py(), part.column("k")[0].as_py()]
                    new |= dict(zip(("t", "mean"), map(pa.array, _seated(c, tables_before, lp, seed))))
                yield pa.RecordBatch.from_arrays([new[k] if k in new else part.column(k) for k in names], names=names)
        return run

    spelt = words_now.select("wpart", "k", "word", "n", F.lit(0.0).alias("lp"), "c", "kept")
    for bundles in blocks[:-1]:  # one block unless the model is large
        spelt = written(spelt.mapInArrow(word_spelling(shared(bundles), spelt.columns, total), spelt.schema), "score-spelt")
    short = ["wpart", "k", "n", "lp", "c", "kept", "mean"]
    last, c_all, total = counted_words(spelt.mapInArrow(word_spelling(shared(blocks[-1]), short, total), schema(short)))
    by_word = told(last.select("wpart", "k", above(c_all, total).alias("p"), "n", F.col("kept").alias("t")), np.float64)

    def tell_pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """To every batch, of its pairs seen more than once: their tables, summed over the kept sweeps."""
        kept = np.zeros(1 + max((int(_unpack_sorted(x)[-1]) for x in right["a"]), default=-1), np.int64)
        for g, t in zip(right["a"], right["b"]):
            kept[_unpack_sorted(g).astype(np.int64)] = _unpack_counts(t)
        return pd.DataFrame({"bid": left["bid"], "what": 2, "to": left["part"], "a": left["n"], "b": [_pack_counts(kept[_unpack_sorted(x).astype(np.int64)]) for x in left["g"]], "c": b""})

    by_pair = replies.select("part", "bid", "n", "g").groupBy("part").cogroup(seats.where("what = 2").select("to", "a", "b").groupBy("to")).applyInPandas(tell_pairs, sent)

    def summed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        right = right.sort_values("to")
        one, two = right[right["what"] == 1], right[right["what"] == 2]
        p, count, kept = _joined([_unpack(x, np.float64) for x in one["a"]], float), *(_joined([_unpack_counts(x) for x in one[k]]) for k in "bc")
        n_pair = _joined([_unpack_counts(x) for x in two["a"]])
        d, theta = DISCOUNT[CONTEXT], STRENGTH[CONTEXT]
        own = np.where(n_pair > 0, n_pair - d, 0.0)  # customers beyond the discounts
        own[n_pair > 1] -= d * (_joined([_unpack_counts(x) for x in two["b"]]) / SAMPLES - 1)
        for r in left.itertuples():
            n = np.asarray(r.n)
            b = _Batch(r.words, r.ids, n, np.asarray(r.held, bool)).pair()
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            lp = _log_sum(own, np.log10(theta + d * kept[b.u] / SAMPLES) + p[b.w]) - np.log10(theta + count[b.u])
            out.append(pd.DataFrame({
                "key": list(r.keys), "held_out": list(r.held), "n_tokens": n, "n_known": np.add.reduceat((count > 0).astype(np.int64)[b.ids], starts), "train_tokens": n_all,
                "base_score": np.add.reduceat(np.log10(count + 1.0)[b.ids], starts) - n * np.log10(n_all + v_all + 1.0), "score": np.add.reduceat(lp[b.at], starts)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return batches.select("bid", "keys", "held", "n", "words", "ids").groupBy("bid").cogroup(by_word.unionByName(by_pair).groupBy("bid")).applyInPandas(
        summed, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)
