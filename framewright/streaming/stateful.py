"""Stateful stream operators with bounded state.

Each is a small step over ``applyInPandasWithState``.  Calling Python costs about a millisecond a group, so keys are grouped into
``BUCKETS`` hash buckets: a call takes the rows of all keys of a bucket in one trigger and holds the state of its live keys as one
value.  Steps see one key at a time, and rows as they come in, so a call holds states and one Arrow batch.  Idle keys are dropped
one by one by a processing-time timeout.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewright.streaming.chunks import status_of

STREAM = "stream_id"
CHUNK = "chunk_idx"
BUCKETS = 1024


class Step(NamedTuple):
    """What one key does in one trigger."""

    begin: Callable[[Any], Any]  # working value from the key's state, or from None
    add: Callable[[Any, list[tuple]], None]  # takes in some rows (the columns after the keys)
    end: Callable[[tuple, Any], tuple[list[tuple], Any]]  # rows to emit, and the new state


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> tuple[Any, Callable[[Iterator[pd.DataFrame]], Iterator[tuple[tuple, list[tuple]]]]]:
    """Rows grouped by bucket, and a function that splits a bucket's batches into (key, rows)."""
    rest = [c for c in df.columns if c not in keys]
    # pandas has no long column with nulls, so a null key travels as a zero and a flag.
    plain = [F.coalesce(k, F.lit(0).cast(df.schema[k].dataType)).alias(k) if isinstance(df.schema[k].dataType, T.NumericType) else F.col(k) for k in keys]
    flags = [f"_null{i}" for i in range(len(keys))]
    dealt = df.select(*plain, *[F.col(k).isNull().alias(f) for k, f in zip(keys, flags)], *rest,
                      F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[tuple]]]:
        for pdf in batches:
            by_key: dict[tuple, list[tuple]] = {}
            names = [[None if gone else v for v, gone in zip(pdf[k].tolist(), pdf[f].tolist())] for k, f in zip(keys, flags)]
            for key, row in zip(zip(*names), zip(*[pdf[c].tolist() for c in rest])):
                by_key.setdefault(key, []).append(row)
            yield from by_key.items()

    return dealt.groupBy("_bucket"), split


def _stateful(df: DataFrame, keys: list[str], step: Step, out: str, ttl_s: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Run ``step`` per key; with ``ttl_s`` a key idle for that long is forgotten."""
    grouped, split = _bucketed(df, keys, buckets)
    columns = [c.split()[0] for c in out.split(", ")]

    def run(_: Any, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.getCurrentProcessingTimeMs()
        states = pickle.loads(held.get[0]) if held.exists else {}
        if ttl_s is not None:
            states = {k: v for k, v in states.items() if now - v[0] < ttl_s * 1000}
        working: dict[tuple, Any] = {}
        if not held.hasTimedOut:
            for key, rows in split(batches):
                if key not in working:
                    working[key] = step.begin(states[key][1] if key in states else None)
                step.add(working[key], rows)
        emitted = []
        for key, value in working.items():
            rows, state = step.end(key, value)
            emitted += rows
            states[key] = (now, state)
        if states:
            held.update((pickle.dumps(states),))
            if ttl_s is not None:
                held.setTimeoutDuration(max(1, min(seen for seen, _ in states.values()) + ttl_s * 1000 - now))
        elif held.exists:
            held.remove()
        if emitted:
            yield pd.DataFrame(emitted, columns=columns, dtype=object)

    timeout = GroupStateTimeout.NoTimeout if ttl_s is None else GroupStateTimeout.ProcessingTimeTimeout
    return grouped.applyInPandasWithState(run, out, "states binary", "append", timeout)


def _kind(df: DataFrame, col: str = STREAM) -> str:
    return df.schema[col].dataType.simpleString()


def lookahead_context_stream(chunks: DataFrame, value: str, before: int = 8, after: int = 8, span: int = 64,
                             ttl_s: int = 3600) -> DataFrame:
    """Emit frame i once chunks ``i-before .. i+after-1`` have arrived, in any order.

    State is keyed by (stream, segment) and chunks near an edge go to both
    sides, so a busy stream spreads over many keys of at most
    ``span + before + after`` chunks.
    """
    seg, off = F.floor(F.col(CHUNK) / F.lit(span)).cast("long"), F.pmod(F.col(CHUNK), F.lit(span))
    homes = F.array_compact(F.array(
        seg, F.when((off < after - 1) & (seg > 0), seg - 1), F.when(off >= span - before, seg + 1)))
    keyed = chunks.select(STREAM, F.explode(homes).alias("seg"), CHUNK, F.col(value).cast("double").alias("value"))

    def begin(state: Any) -> tuple[dict, set]:
        have, done = state or ({}, ())
        return dict(have), set(done)

    def add(work: tuple[dict, set], rows: list[tuple]) -> None:
        for i, v in rows:
            work[0].setdefault(i, v)

    def end(key: tuple, work: tuple[dict, set]) -> tuple[list[tuple], Any]:
        have, done = work
        out = []
        low = key[1] * span
        for i in range(low, low + span):
            want = range(i - before, i + after)
            if i not in done and all(j in have for j in want):
                out.append((key[0], i, [have[j] for j in want]))
                done.add(i)
        return out, (have, sorted(done))

    return _stateful(keyed, [STREAM, "seg"], Step(begin, add, end), f"{STREAM} {_kind(chunks)}, {CHUNK} long, context array<double>", ttl_s)


def _merge(spans: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """Sorted disjoint spans with [low, high] added; touching spans become one."""
    out = []
    for a, b in sorted([*spans, (low, high)]):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def filled_segments_stream(chunks: DataFrame, span: int = 64, ttl_s: int = 3600) -> DataFrame:
    """Emit (stream, seg, high) whenever a segment of ``span`` chunks is filled further from its start, up to chunk ``high``.

    Keyed by (stream, segment), so a busy stream spreads, and what waits behind a gap is never more than one segment: an endless
    gap does not grow any state.  State: the disjoint spans inside the segment.
    """
    seg = F.floor(F.col(CHUNK) / F.lit(span)).cast("long")

    def reach(spans: list[tuple[int, int]], low: int) -> int:
        return spans[0][1] if spans and spans[0][0] == low else low - 1

    def begin(state: Any) -> list:
        return [state or [], state or []]

    def add(work: list, rows: list[tuple]) -> None:
        for i in sorted({i for i, in rows}):
            work[1] = _merge(work[1], i, i)

    def end(key: tuple, work: list) -> tuple[list[tuple], Any]:
        low = key[1] * span
        high = reach(work[1], low)
        return [(*key, high)] if high > reach(work[0], low) else [], work[1]

    return _stateful(chunks.where(F.col(CHUNK) >= 0).select(STREAM, seg.alias("seg"), CHUNK), [STREAM, "seg"], Step(begin, add, end),
                     f"{STREAM} {_kind(chunks)}, seg long, high long", ttl_s)


def run_ends(filled: DataFrame, span: int = 64) -> DataFrame:
    """How far the unbroken run from chunk 0 reaches, from the rows of :func:`filled_segments_stream` so far.

    A run ends in the first segment that is not full or has no filled successor, which is an anti join.
    """
    segs = filled.groupBy(STREAM, "seg").agg(F.max("high").alias("high"))
    follow = segs.select(STREAM, (F.col("seg") - 1).alias("seg"), F.lit(1).alias("_more"))
    full = F.col("high") == (F.col("seg") + 1) * span - 1
    ends = segs.join(follow, [STREAM, "seg"], "left").where(~full | F.col("_more").isNull())
    first = ends.groupBy(STREAM).agg(F.min_by("high", "seg").alias("run_end"))
    return first.join(segs.where("seg = 0").select(STREAM), STREAM, "left_semi")


def playback_start_stream(chunks: DataFrame, fill: int = 20, delay_ms: int = 380, ttl_s: int = 3600) -> DataFrame:
    """Emit the playback time of a stream once ``fill`` chunks are buffered.

    State: the ``fill`` earliest arrival times, emptied when playback has started; a stream idle for ``ttl_s`` is forgotten.
    """
    def begin(state: Any) -> list:
        return list(state or (False, []))

    def add(work: list, rows: list[tuple]) -> None:
        if not work[0]:
            work[1] = sorted(work[1] + [us for us, in rows])[:fill]

    def end(key: tuple, work: list) -> tuple[list[tuple], Any]:
        started, first = work
        if started or len(first) < fill:
            return [], (started, first)
        return [(*key, first[-1])], (True, [])

    src = chunks.select(STREAM, F.unix_micros("ts").alias("us"))
    out = _stateful(src, [STREAM], Step(begin, add, end), f"{STREAM} {_kind(chunks)}, ready_us long", ttl_s)
    return out.select(STREAM, F.timestamp_micros("ready_us").alias("ready_ts"),
                      F.timestamp_micros(F.col("ready_us") + delay_ms * 1000).alias("start_ts"))


def buffer_status_stream(events: DataFrame, target: int = 15) -> DataFrame:
    """Fill of each stream (produced minus consumed), its status and percent of target; for update mode.

    A plain aggregation, so a busy stream is summed before the shuffle; publish it with ``run.publish``.
    """
    fill = events.groupBy(STREAM).agg(F.sum("delta").cast("long").alias("fill"))
    return fill.withColumns({"status": status_of(F.col("fill")), "percent": F.col("fill") / F.lit(target) * 100})


def bounded_history_stream(chunks: DataFrame, value: str, n: int = 3000) -> DataFrame:
    """The latest ``n`` chunks of each stream as changes: (stream, chunk, value, kept, version).

    Each trigger names the rows that came in (``kept``) and those that fell out; of a chunk the highest version tells.  A chunk
    below the window never enters; a repeated chunk replaces its value.  State: the ``n`` chunks and the stream's version.
    """
    def begin(state: Any) -> list:
        version, before = state or (0, {})
        return [version, before, dict(before)]

    def add(work: list, rows: list[tuple]) -> None:
        have = work[2]
        have.update(rows)
        if len(have) > n:
            work[2] = {i: have[i] for i in sorted(have)[-n:]}

    def end(key: tuple, work: list) -> tuple[list[tuple], Any]:
        version, before, have = work[0] + 1, work[1], work[2]
        came = [(*key, i, v, True, version) for i, v in have.items() if i not in before or before[i] != v]
        gone = [(*key, i, v, False, version) for i, v in before.items() if i not in have]
        return came + gone, (version, have)

    src = chunks.select(STREAM, CHUNK, F.col(value).cast("double").alias("value"))
    return _stateful(src, [STREAM], Step(begin, add, end), f"{STREAM} {_kind(chunks)}, {CHUNK} long, value double, kept boolean, version long")


def kept_history(changes: DataFrame) -> DataFrame:
    """The rows that stand after the changes of :func:`bounded_history_stream`."""
    last = F.max_by(F.struct("value", "kept"), "version").alias("l")
    return changes.groupBy(STREAM, CHUNK).agg(last).where("l.kept").select(STREAM, CHUNK, "l.value")


def ttl_cache_keys_stream(sets: DataFrame, key: str, ts: str, unique: str, ttl_s: int, watermark: str) -> DataFrame:
    """Whether a key was still valid when it was set again, and when it expired, by event time: (key, unique, at, valid).

    Rows wait in state until the watermark has passed them and are then taken in order of time, so rows may arrive in any
    order within the watermark.  A key whose time runs out emits a row with a null ``unique`` and ``valid`` false, and leaves
    the state.  State: the rows that wait, and the time of the last set.
    """
    kind, uid = _kind(sets, key), _kind(sets, unique)
    ttl = ttl_s * 1_000_000

    src = sets.withWatermark(ts, watermark).select(key, F.unix_micros(ts).alias("us"), F.col(unique), ts)
    grouped, split = _bucketed(src, [key], BUCKETS)

    def ripen(k: Any, last: int | None, waiting: list[tuple], now: int, out: list[tuple]) -> tuple[int | None, list[tuple]]:
        """Emit what the watermark ``now`` has passed; what is left of the key's state."""
        waiting.sort()
        ripe = [w for w in waiting if w[0] < now]
        for us, i in ripe:
            if last is not None and us - last > ttl:
                out.append((k, None, last + ttl, False))
            out.append((k, i, us, last is not None and us - last <= ttl))
            last = us
        waiting = waiting[len(ripe):]
        if last is not None and last + ttl < now and not (waiting and waiting[0][0] <= last + ttl):
            out.append((k, None, last + ttl, False))
            last = None
        return last, waiting

    def due(last: int | None, waiting: list[tuple]) -> int:
        return min([w[0] for w in waiting] + ([last + ttl] if last is not None else []))

    def step(_: Any, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        states = pickle.loads(held.get[0]) if held.exists else {}
        if not held.hasTimedOut:
            for k, rows in split(batches):
                states.setdefault(k, (None, []))[1].extend((us, i) for us, i, _ in rows)
        mark = held.getCurrentWatermarkMs()
        out: list[tuple] = []
        for k, state in list(states.items()):
            if due(*state) < mark * 1000:
                states[k] = ripen(k[0], *state, mark * 1000, out)
                if states[k] == (None, []):
                    del states[k]
        if states:
            held.update((pickle.dumps(states),))
            held.setTimeoutTimestamp(max(min(due(*v) for v in states.values()) // 1000, mark) + 1)
        elif held.exists:
            held.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, unique, "us", "valid"], dtype=object)

    out = grouped.applyInPandasWithState(step, f"{key} {kind}, {unique} {uid}, us long, valid boolean", "states binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, unique, F.timestamp_micros("us").alias("at"), "valid")
