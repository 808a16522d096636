"""Turn repair against a plain search over all edit strings."""

import hashlib
import random
import re
import sys
from functools import lru_cache
from zlib import crc32

from pyspark.sql import functions as F

from framewright.llm import queries, turn_repair

sys.setrecursionlimit(100_000)
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """Rows in order as (role, text, fault)."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit) by memoised search over grammar states; at most four inserts in a row."""
    steps = {0: {"u": 3, "s": 1}, 1: {"u": 3}, 2: {"u": 3}, 3: {"a": 2}}

    @lru_cache(None)
    def best(i, q, run):
        found = [(0, "")] if i == len(rows) and q in (0, 2) else []
        for letter, t in steps[q].items():
            if letter != "s" and run < 4:
                c, a = best(i, t, run + 1)
                found.append((c + 3, "I" + a))
            if i < len(rows) and rows[i][2] not in ("blank", "duplicate"):
                cut = 3 * (rows[i][2] == "truncated")
                if rows[i][0][:1] == letter:
                    c, a = best(i + 1, t, 0)
                    found.append((c + cut, "K" + a))
                elif letter != "s":
                    c, a = best(i + 1, t, 0)
                    found.append((c + cut + 3, "R" + a))
        if i < len(rows):
            c, a = best(i + 1, q, 0)
            found.append((c + 4, "D" + a))
        return min(found, default=(1 << 50, ""))

    return best(0, 0, 0)


def expected(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    marked = faults(rows)
    cost, audit = cheapest(tuple(marked))
    out, i, due = [], 0, "user"
    for e in audit:
        role, text = (due, "") if e == "I" else (marked[i][0] if e == "K" else due, marked[i][1])
        i += e != "I"
        if e != "D":
            out.append((e, role, text))
            due = "assistant" if role[:1] == "u" else "user"
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in out))
    at = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    count = lambda k: sum(f == k for *_, f in marked)
    return (conv, max(at) - min(at) + 1 - len(set(at)) if at else 0, count("blank"), count("duplicate"), count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in out).encode()).hexdigest()), out


def conversations(rng, n, most):
    texts = ["Yes.", "No!", "Why?", "half a", "", " \n", "Good. ", "x", "Über."]
    for conv in range(n):
        size = rng.randrange(1, most)
        for k in range(size):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]) if rng.random() < 0.4 else ("assistant" if k % 2 else "user")
            yield conv, rng.choice([k, k, k, k // 2, None]), role, rng.choice(texts) if rng.random() < 0.4 else f"Turn {k}."


def by_conversation(rows):
    groups = {}
    for c, *rest in rows:
        groups.setdefault(c, []).append((rest[0], rest[1] if rest[1] is not None else " ", rest[2] if rest[2] is not None else " "))
    return groups


def test_pieces_agree_with_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "PIECE", 3)
    rows = list(conversations(random.Random(1), 150, 14))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = {c: expected(c, r) for c, r in by_conversation(rows).items()}
    got = turn_repair.audits(df).collect()
    assert sorted(map(tuple, got)) == sorted(w for w, _ in want.values())
    turns = turn_repair.repaired_turns(df).collect()
    for c, (_, lines) in want.items():
        assert [tuple(t)[2:] for t in sorted((t for t in turns if t.conv_id == c), key=lambda t: t.position)] == lines


def test_alignment_of_one_length():
    rng = random.Random(2)
    for _ in range(400):
        turns = "".join(rng.choice("uaosUAOSx") for _ in range(rng.randrange(7)))
        target = ("s" * rng.randrange(2) + "uaua"[rng.randrange(2):])[:rng.randrange(6)]

        @lru_cache(None)
        def plain(i, j):
            found = [(0, "")] if i == len(turns) and j == len(target) else []
            if i < len(turns):
                found.append((4 + plain(i + 1, j)[0], "D" + plain(i + 1, j)[1]))
            if j < len(target) and target[j] != "s":
                found.append((3 + plain(i, j + 1)[0], "I" + plain(i, j + 1)[1]))
            if i < len(turns) and j < len(target) and turns[i] != "x":
                cut, c = 3 * turns[i].isupper(), plain(i + 1, j + 1)
                if turns[i].lower() == target[j]:
                    found.append((cut + c[0], "K" + c[1]))
                elif target[j] != "s":
                    found.append((3 + cut + c[0], "R" + c[1]))
            return min(found, default=(1 << 50, ""))

        want = plain(0, 0)
        for limit in (want[0], want[0] + 1, want[0] + 9):
            assert turn_repair.align(turns, target, limit) == (want if want[0] < 1 << 50 else None)
        assert want[0] >= 1 << 50 or turn_repair.align(turns, target, want[0] - 1) is None


def test_long_conversation_over_many_parts(spark):
    rows = [(c, t, r, x) for _, t, r, x in conversations(random.Random(3), 1, 500) for c in (7,)]
    rows += [(7, 500 + k, "assistant" if k % 2 else "user", f"Line {k}.") for k in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want, _ = expected(7, by_conversation(rows)[7])
    assert list(map(tuple, turn_repair.audits(df).collect())) == [want]


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, 0, "user", "Hi.", 1), (None, None, None, None, 1), (1, 0, "user", "A.", 2), (1, 0, "user", "A.", 2), (1, 0, "user", "A.", 3),
            (1, 1, "assistant", "z" * 200_000 + ".", 4), (2, None, "system", "Be kind.", 5), (2, 5, "user", "Go\x0b", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, sig int").withColumns({"conv": F.lit(1), "part": F.lit(2), "no": F.lit(3)})
    got = sorted(map(tuple, turn_repair.audits(df).collect()), key=str)
    assert got == sorted((expected(c, r)[0] for c, r in by_conversation([r[:4] for r in rows]).items()), key=str)
    assert turn_repair.audits(df.where("false")).count() == turn_repair.repaired_turns(df.where("false")).count() == 0


def test_query_on_its_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = []
    for c, t, role, text in rows:
        h = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if h == 4 else " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        after += [(c, t, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    groups = by_conversation(after)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = [expected(c, groups[c])[0] if c in groups else (c, *nothing) for c in {r[0] for r in rows}]
    assert sorted(map(tuple, queries.op11_turn_repair(spark, sf).collect())) == sorted(want)
