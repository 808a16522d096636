"""Conversation structure repair: turns aligned to the strings of an alternating grammar at least cost, with audits.

Turns of a conversation should read ``(s?(ua)+)?`` in role initials.  Edits: Keep costs 0, Rerole (to user or assistant) 3,
Delete 4, Insert (an empty turn, user or assistant) 3; a blank or repeated turn must be deleted, and a truncated one that stays
costs 3 more.  Of the cheapest edit strings the least in ASCII is the audit.

A conversation of any length is cut into pieces of at most ``PIECE`` consecutive turns, over range partitions, so a long one is spread.
Within a piece, for each way to enter the grammar and each way to leave it, the turns are aligned to every target length that
can still win (Wagner-Fischer, cost to go), inside an Ukkonen band given by the best cost so far; tracing forwards and trying
letters in ASCII order gives the least audit of a length, and audits of equal cost are compared.  Then one pass over a
conversation's pieces chains them through the grammar states.  What all remaining chains agree on is settled and leaves memory.

States between turns: 0 nothing yet, 1 a system turn only, 2 after an assistant, 3 after a user; 0 and 2 may end.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framewright.llm.base import chunks

PIECE, PIECE_TEXT = 64, 1 << 14  # turns and characters of a piece
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
_SPACE, _ENDS, _LEGAL = " \t\n\x0b\x0c\r", ".!?", {"su", "ua", "au"}
# Chains that cost this much more than another cannot win: from any state at most 7 brings one to where another continues.
_HOPELESS = 12
_NEVER = 1 << 40


def _drift(extra: int, cut: int) -> int:
    """Least cost of ``extra`` more targets than turns that may stay (inserts), or fewer (deletes; of cut turns only the difference counts)."""
    return INSERT * extra if extra >= 0 else (DELETE - CUT) * min(-extra, cut) + DELETE * max(0, -extra - cut)


def align(turns: str, target: str, limit: int) -> tuple[int, str] | None:
    """Cheapest edits that turn ``turns`` into exactly ``target``, if at most ``limit``: (cost, least audit).

    A turn is its role initial (``o``: none of u, a, s), upper case if truncated, or ``x`` if it has to go.
    """
    n, m = len(turns), len(target)
    stays, cuts = [0], [0]
    for t in turns:
        stays.append(stays[-1] + (t != "x"))
        cuts.append(cuts[-1] + t.isupper())
    must = DELETE * (n - stays[n]) + CUT * cuts[n]
    slack = limit - must
    if slack < 0:
        return None
    up, down = slack // INSERT, slack if slack <= cuts[n] * (DELETE - CUT) else cuts[n] + (slack - cuts[n] * (DELETE - CUT)) // DELETE
    span = [(max(0, stays[i] - down, m - stays[n] + stays[i] - up), min(m, stays[i] + up, m - stays[n] + stays[i] + down)) for i in range(n + 1)]

    def step(i: int, j: int) -> int:
        t = turns[i]
        if t == "x":
            return _NEVER
        role = t.lower()
        return (KEEP if role == target[j] else REROLE if target[j] != "s" else _NEVER) + (CUT if t != role else 0)

    togo: list[dict[int, int]] = [{} for _ in range(n + 2)]
    for i in range(n, -1, -1):
        low, high = span[i]
        row, below = togo[i], togo[i + 1]
        for j in range(high, low - 1, -1):
            best = 0 if i == n and j == m else _NEVER
            if i < n:
                best = min(best, DELETE + below.get(j, _NEVER))
                if j < m:
                    best = min(best, step(i, j) + below.get(j + 1, _NEVER))
            if j < m and target[j] != "s":
                best = min(best, INSERT + row.get(j + 1, _NEVER))
            row[j] = best
    cost = togo[0].get(0, _NEVER)
    if cost > limit or cost >= _NEVER:
        return None
    audit, i, j, rest = [], 0, 0, cost
    while i < n or j < m:
        if i < n and DELETE + togo[i + 1].get(j, _NEVER) == rest:
            audit.append("D")
            i, rest = i + 1, rest - DELETE
        elif j < m and target[j] != "s" and INSERT + togo[i].get(j + 1, _NEVER) == rest:
            audit.append("I")
            j, rest = j + 1, rest - INSERT
        else:
            c = step(i, j)
            audit.append("K" if turns[i].lower() == target[j] else "R")
            i, j, rest = i + 1, j + 1, rest - c
    return cost, "".join(audit)


def _cheapest(turns: str, first: str, lengths: range) -> tuple[int, str] | None:
    """Best alignment over all target lengths of a kind; ``first`` is how the target begins (u, a or s, then alternating u and a)."""
    n, cut, stay = len(turns), sum(t.isupper() for t in turns), sum(t != "x" for t in turns)
    if first == "s" and "s" not in turns.lower():
        return None
    least = lambda size: DELETE * (n - stay) + CUT * cut + _drift(size - stay, cut)
    best: tuple[int, str] | None = None
    for size in sorted(lengths, key=lambda size: (least(size), size)):
        if best and least(size) > best[0]:
            break
        target = ("s" + "ua" * size if first == "s" else ("ua" if first == "u" else "au") * size)[:size]
        limit = best[0] if best else least(size) + 6
        got = align(turns, target, limit)
        while got is None and best is None and limit <= DELETE * n + (REROLE + CUT + INSERT) * (n + size):
            limit += max(6, limit - least(size))
            got = align(turns, target, limit)
        if got and (best is None or got < best):
            best = got
    return best


@lru_cache(maxsize=1 << 16)
def ways(turns: str) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, audit) of the best edits of a piece for each pair of states that it can connect."""
    n = len(turns)
    far = 2 * n + 8
    stay = _cheapest(turns, "u", range(0, 1))
    even, odd = _cheapest(turns, "u", range(2, far, 2)), _cheapest(turns, "u", range(1, far, 2))
    found = [(s, t, way) for s in (0, 1, 2) for t, way in ((s, stay), (2, even), (3, odd))]
    found += [(3, 3, _cheapest(turns, "a", range(0, far, 2))), (3, 2, _cheapest(turns, "a", range(1, far, 2)))]
    found += [(0, 1, _cheapest(turns, "s", range(1, 2))), (0, 3, _cheapest(turns, "s", range(2, far, 2))), (0, 2, _cheapest(turns, "s", range(3, far, 2)))]
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for s, t, way in found:
        if way and (way < best.get((s, t), (_NEVER, ""))):
            best[s, t] = way
    return tuple((s, t, cost, audit) for (s, t), (cost, audit) in sorted(best.items()))


_WAY = "array<struct<before:int,after:int,cost:long,audit:string>>"


def _cut(batches: Iterator[pa.RecordBatch], conv: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Pieces of a partition whose rows come by conversation and order; ``text`` only of turns that may stay."""
    part, number = TaskContext.get().partitionId(), 0
    held: dict = {}
    last: tuple | None = None
    way = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    schema = pa.schema([("conv", conv), ("part", pa.int32()), ("no", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                        ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
                        ("ways", way), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def done() -> dict:
        nonlocal number
        number += 1
        roles, turns = held["roles"], [t for t in held["at"] if t is not None]
        firsts = [r[:1] for r in roles]
        return {"conv": held["conv"], "part": part, "no": number, **{k: held[k] for k in ("blank", "duplicate", "truncated")},
                "illegal": sum(a + b not in _LEGAL for a, b in zip(firsts, firsts[1:])), "first": firsts[0], "last": firsts[-1],
                "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
                "ways": [dict(zip(("before", "after", "cost", "audit"), w)) for w in ways("".join(held["code"]))], "roles": roles, "texts": held["texts"]}

    for rows in chunks(batches, "text"):
        out = []
        for c, at, role, text, again in zip(*(rows.column(x).to_pylist() for x in ("conv", "turn", "role", "text", "again"))):
            if held and (held["conv"] != c or len(held["roles"]) == PIECE or held["size"] > PIECE_TEXT):
                out.append(done())
                held = {}
            if not held:
                held = {"conv": c, "blank": 0, "duplicate": 0, "truncated": 0, "roles": [], "texts": [], "code": [], "at": [], "size": 0}
            bare = text.rstrip(_SPACE)
            this = (c, at, role, text)
            fault = "blank" if not bare else "duplicate" if again or this == last else "truncated" if bare[-1] not in _ENDS else None
            last = this
            if fault:
                held[fault] += 1
            gone, initial = fault in ("blank", "duplicate"), role[:1] if role[:1] in ("u", "a", "s") else "o"
            held["code"].append("x" if gone else initial.upper() if fault else initial)
            held["roles"].append(role)
            held["texts"].append(None if gone else text)
            held["size"] += len(text)
            held["at"].append(at)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist([done()], schema=schema)


class _Chain:
    """The pieces of one conversation, in order; ``settled`` yields (edit, role, text) of turns that stay, as soon as they are sure."""

    def __init__(self) -> None:
        self.paths: dict[int, tuple[int, list[tuple[int, str]]]] = {0: (0, [])}
        self.waiting: deque[dict] = deque()
        self.audit: list[str] = []
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low: int | None = None
        self.high: int | None = None
        self.last: str | None = None

    def add(self, piece: dict) -> Iterator[tuple[str, str, str]]:
        for k in self.sums:
            self.sums[k] += piece[k]
        self.sums["illegal"] += self.last is not None and self.last + piece["first"] not in _LEGAL
        self.last = piece["last"]
        if piece["low"] is not None:
            self.sums["turns"] -= self.high == piece["low"]
            self.low, self.high = piece["low"] if self.low is None else self.low, piece["high"]
        best: dict[int, tuple[int, list[tuple[int, str]]]] = {}
        for w in piece["ways"]:
            if w["before"] in self.paths:
                cost, steps = self.paths[w["before"]]
                new = (cost + w["cost"], [*steps, (w["before"], w["audit"])])
                if w["after"] not in best or self._key(new) < self._key(best[w["after"]]):
                    best[w["after"]] = new
        bar = min(c for c, _ in best.values()) + _HOPELESS
        self.paths = {s: p for s, p in best.items() if p[0] <= bar}
        self.waiting.append(piece)
        yield from self._settled()

    @staticmethod
    def _key(path: tuple[int, list[tuple[int, str]]]) -> tuple[int, str]:
        return path[0], "".join(a for _, a in path[1])

    def _settled(self) -> Iterator[tuple[str, str, str]]:
        while self.waiting and len({steps[0] for _, steps in self.paths.values()}) == 1:
            piece = self.waiting.popleft()
            state, audit = next(iter(self.paths.values()))[1][0]
            for _, steps in self.paths.values():
                del steps[0]
            self.audit.append(audit)
            due, i = "assistant" if state == 3 else "user", 0
            for edit in audit:
                role, text = due, ""
                if edit != "I":
                    role, text = piece["roles"][i] if edit == "K" else due, piece["texts"][i]
                    i += 1
                if edit != "D":
                    due = "assistant" if role[:1] == "u" else "user"
                    yield edit, role, text

    def close(self) -> Iterator[tuple[str, str, str]]:
        ends = {s: p for s, p in self.paths.items() if s in (0, 2)}
        self.paths = {0: min(ends.values(), key=self._key)}
        self.cost = self.paths[0][0]
        yield from self._settled()

    def row(self, conv, digest: str) -> dict:  # noqa: ANN001
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
        return {"conv": conv, "gaps": gaps, **{k: self.sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": self.cost,
                "audit": "".join(self.audit), "sha256": digest}


def _chained(batches: Iterator[pa.RecordBatch], schema: pa.Schema, turns: bool) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and order, to repaired turns or to one row a conversation."""
    chain, conv, out, digest, place, size = None, None, [], None, 0, 0

    def take(lines: Iterator[tuple[str, str, str]]) -> None:
        nonlocal place, size
        for edit, role, text in lines:
            if turns:
                out.append({"conv": conv, "position": place, "edit": edit, "role": role, "text": text})
                size += len(text)
            else:
                digest.update((("\n" if place else "") + role + ":" + text).encode())
            place += 1

    def finish() -> None:
        take(chain.close())
        if not turns:
            out.append(chain.row(conv, digest.hexdigest()))

    for rows in batches:
        for at in range(rows.num_rows):
            piece = {k: v[0] for k, v in rows.slice(at, 1).to_pydict().items()}
            if chain is None or piece["conv"] != conv:
                if chain is not None:
                    finish()
                chain, conv, digest, place = _Chain(), piece["conv"], hashlib.sha256(), 0
            take(chain.add(piece))
            if len(out) >= 10_000 or size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, size = [], 0
    if chain is not None:
        finish()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _pieces(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text), F.lit(" ")).alias("text")).withColumn("sig", F.concat(F.md5("role"), F.md5("text")))
    # Of turns with the same role and text all but those of the first turn number are repeats; among equal rows of one number the order tells.
    several = rows.groupBy("conv", "sig").agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("least")).where("n > 1").select(
        F.col("conv").alias("c"), F.col("sig").alias("s"), F.when(~F.col("none"), F.col("least")).alias("at"))
    told = rows.join(several, F.col("conv").eqNullSafe(F.col("c")) & (F.col("sig") == F.col("s")), "left").select(
        "conv", "turn", "role", "text", (F.col("s").isNotNull() & ~F.col("turn").eqNullSafe(F.col("at"))).alias("again"))
    ordered = told.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    kind = rows.schema["conv"].dataType
    arrow = to_arrow_type(kind)
    schema = (f"conv {kind.simpleString()}, part int, no long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, "
              f"turns long, ways {_WAY}, roles array<string>, texts array<string>")
    pieces = ordered.mapInArrow(lambda b: _cut(b, arrow), schema)
    return pieces.repartition("conv").sortWithinPartitions("conv", "part", "no")


def audits(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation with rows.

    Turns go by number, nulls first, then by role and text.  A null role or text is read as one space; rows with a null
    conversation form one.  The first of blank, duplicate (role and text seen earlier) and truncated counts for a turn.  An empty
    table gives no row.  The digest is of the repaired ``role:text`` lines; hashing it, and writing the audit into one value, take
    a conversation's turns in order, so that last pass over one conversation is one task, which holds a few pieces at a time.
    """
    kind = rows.schema[conv].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        ("audit", pa.string()), ("sha256", pa.string())])
    out = _pieces(rows, conv, turn, role, text).mapInArrow(
        lambda b: _chained(b, schema, False),
        f"conv {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha256 string")
    return out.withColumnsRenamed({"conv": conv, "sha256": "repaired_sha256"})


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, position, edit, role, text): the turns of every conversation after repair, from 0; ``edit`` is K, R or I.

    Rules as in :func:`audits`; a conversation of which nothing stays has no row.
    """
    kind = rows.schema[conv].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    out = _pieces(rows, conv, turn, role, text).mapInArrow(
        lambda b: _chained(b, schema, True), f"conv {kind.simpleString()}, position long, edit string, role string, text string")
    return out.withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with planted faults, decided by crc32(``conv_id:turn``) modulo 20 (nulls: one space).

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(space("role")).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(h == 0, 0).when(h == 3, 2).otherwise(1))).alias("copy")).drop("copy")
