"""Personal data with offsets into the source text, also when disguised.

Three transducers run one after the other, each on what the one before it wrote, so disguises may be combined:
characters (look-alike letters, full-width and styled forms, other digits, odd blanks and dashes, invisible
characters), then signs ("(at)", "[dot]" in brackets of any kind, "name at host dot tld"), then digits spelled as words.  Each
keeps, for every stretch of its output, the stretch of its input behind it; a span is taken back through all three
to code points of the source.  The same detectors run on source and output.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.base import chunks

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a digit run begins, so the look-behind changes no result; it keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Look-alike letters and the letters they stand for; dashes; invisible characters; spelled digits.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝкмтвнАВЕКМНОРСТУХІЈЅοαρνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwkmtbhABEKMHOPCTYXIJSoapviktuxABEZHIKMNOPTYX"))
_DASHES = "‐‑‒–—−"
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
            "dot": ".", "point": ".", "plus": "+"}

_ODD = re.compile("[" + "".join(_LOOKALIKES) + _DASHES + _INVISIBLE + "   ！-～\U0001d400-\U0001d7ff٠-٩۰-۹०-९]")
_BRACKETED = re.compile(r"\s?[(\[{<]\s?(at|dot|@|\.)\s?[)\]}>]\s?", re.I)
_SIGN = {"at": "@", "@": "@", "dot": ".", ".": "."}
_AT = re.compile(r"\sat\s|@", re.I)
_HOST_PARTS = re.compile(r"[A-Za-z0-9-]+(?:(?:\sdot\s|\.)[A-Za-z0-9-]+)+", re.I)
_DOT_WORD = re.compile(r"\sdot\s", re.I)
_DIGIT_WORD = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
_BETWEEN = r"[\s,;/.-]++"
_DIGIT_RUN = re.compile(rf"(?:\bplus[\s-]++)?\b(?:(?:{_DIGIT_WORD})\b|[0-9]++(?=\s(?:dot|point)\s))(?:{_BETWEEN}(?:{_DIGIT_WORD}|dot|point|[0-9]++)\b)+", re.I)
_DIGIT_PART = re.compile(r"[a-z]+|[0-9]+", re.I)
_DIGIT_HINT = re.compile(rf"\b(?:(?:{_DIGIT_WORD}){_BETWEEN}(?:{_DIGIT_WORD}|dot|point|[0-9])|[0-9]\s(?:dot|point)\s)", re.I)


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed and then by start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


Edit = tuple[int, int, str]


def _plain_character(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in _DASHES:
        return "-"
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    flat = unicodedata.normalize("NFKC", c)
    return _LOOKALIKES.get(flat, flat)


def _characters(text: str) -> list[Edit]:
    return [] if text.isascii() else [(*m.span(), _plain_character(m.group())) for m in _ODD.finditer(text)]


def _brackets(text: str) -> list[Edit]:
    return [(*m.span(), _SIGN[m.group(1).lower()]) for m in _BRACKETED.finditer(text)]


def _local_start(text: str, end: int, done: int) -> int:
    """Where the name before ``end`` begins: name characters, with dots also as words."""
    start = end
    while start > done:
        if text[start - 1] in _LOCAL:
            start -= 1
        elif start < end and start - 6 >= done and text[start - 6] in _LOCAL and _DOT_WORD.fullmatch(text, start - 5, start):
            start -= 5
        else:
            break
    return start


def _bare_signs(text: str, bracketed: list[int]) -> list[Edit]:
    """"name at host dot tld": a dot as a word, or in brackets before (``bracketed``: their places), gives the disguise away."""
    out: list[Edit] = []
    done = 0
    for m in _AT.finditer(text):
        host = _HOST_PARTS.match(text, m.end())
        start = _local_start(text, m.start(), done) if host and m.start() >= done else m.start()
        if start == m.start():
            continue
        dots = [(*d.span(), ".") for d in _DOT_WORD.finditer(text, start, host.end())]
        told = bisect_right(bracketed, host.end() - 1) > bisect_right(bracketed, m.end() - 1)
        if told or any(d[0] >= m.end() for d in dots):
            out += [d for d in dots if d[1] <= m.start()] + [(*m.span(), "@")] + [d for d in dots if d[0] >= m.end()]
            done = host.end()
    return out


def _spelled_digits(text: str) -> list[Edit]:
    """Runs of at least four digits with a word among them; a full stop between them stays, other separators go."""
    out: list[Edit] = []
    for m in _DIGIT_RUN.finditer(text) if _DIGIT_HINT.search(text) else ():
        parts = [(*p.span(), _SPELLED.get(p.group().lower(), p.group())) for p in _DIGIT_PART.finditer(text, *m.span())]
        if sum(len(_digits(p[2])) for p in parts) >= 4:
            for (a, b, to), (nxt, _, after) in zip(parts, [*parts[1:], (m.end(), 0, "")]):
                out.append((a, b, to))
                if nxt > b:
                    out.append((b, nxt, "." if "." in text[b:nxt] and to != "." != after else ""))
    return out


class Rewritten:
    """A text after edits (in order, not overlapping), and the way from its code points back to those before."""

    def __init__(self, text: str, edits: list[Edit]):
        parts, self.begins, self.sources = [], [], []
        at = length = 0
        for a, b, to in [*edits, (len(text), len(text), "")]:
            for start, end, piece, same in ((at, a, text[at:a], True), (a, b, to, False)):
                if piece:
                    self.begins.append(length)
                    self.sources.append((start, end, same))
                    parts.append(piece)
                    length += len(piece)
            at = b
        self.text = "".join(parts)

    def back(self, a: int, b: int) -> tuple[int, int]:
        """The stretch before the edits of the non-empty stretch a..b after them."""
        i, j = bisect_right(self.begins, a) - 1, bisect_right(self.begins, b - 1) - 1
        first, last = self.sources[i], self.sources[j]
        return first[0] + (a - self.begins[i] if first[2] else 0), last[0] + (b - self.begins[j]) if last[2] else last[1]


def _chain(text: str) -> list[Rewritten]:
    """The steps that changed something, in order."""
    steps: list[Rewritten] = []

    def step(edits: list[Edit]) -> str:
        if edits:
            steps.append(Rewritten(steps[-1].text if steps else text, edits))
        return steps[-1].text if steps else text

    now = step(_characters(text))
    edits = _brackets(now)
    now = step(edits)
    bracketed = [b for b, s in zip(steps[-1].begins, steps[-1].sources) if not s[2]] if edits else []
    low = now.lower()
    now = step(_bare_signs(now, bracketed) if "dot" in low or bracketed else [])
    step(_spelled_digits(now))
    return steps


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base): base spans, then those behind disguises that no base span of their kind contains."""
    if not text:
        return []
    base = detect(text)
    out = [(*s, True) for s in base]
    steps = _chain(text)
    if steps:
        plain = steps[-1].text
        held: dict[str, tuple[list[int], list[int]]] = {k: ([], []) for k in KINDS}  # base spans of a kind do not overlap
        for kind, a, b in base:
            held[kind][0].append(a)
            held[kind][1].append(b)
        for kind, a, b in detect(plain):
            start, end = a, b
            for step in reversed(steps):
                start, end = step.back(start, end)
            starts, ends = held[kind]
            k = bisect_right(starts, start) - 1
            if text[start:end] != plain[a:b] and not (k >= 0 and end <= ends[k]):
                out.append((kind, start, end, False))
    return out


_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): every span with its kind, code point offsets (end exclusive) and whether a base pattern finds it.

    A null or empty text has an empty list.  One row per input row, repeated rows included; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for part in chunks(batches, "text"):
            found = [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans(t)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, kind_of)], names=["key", "spans"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, spans {_SPANS}").withColumnRenamed("key", key)


def digest_text(found: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    order = F.array(*map(F.lit, KINDS))
    ranked = F.array_sort(F.transform(found, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; overlapping spans become one mask.

    Of overlapping spans the one that starts first names the mask (then the shorter, then the kind in ASCII order).  Null, empty
    and clean texts stay as they are; rows, repeated ones too, and the other columns, whatever their names, are unchanged.
    """

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            found = sorted((a, b, k) for k, a, b, _ in spans(t)) if t else []
            if not found:
                return t
            out, at = [], 0
            for a, b, k in found:
                if a >= at:
                    out += [t[at:a], f"<{k.upper()}>"]
                at = max(at, b)
            return "".join([*out, t[at:]])
        return texts.map(one)

    return docs.withColumn(text, mask(F.col(text)))
