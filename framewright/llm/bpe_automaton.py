"""Byte-pair encoding by a deterministic automaton over tokens, compiled by merge gadgets.

The automaton starts with one state per symbol and an arc for each pair of symbols.  Merging (a, b) into c applies one
gadget: c is entered from wherever a is entered, left wherever b is left, and the arc from a to b goes.  An accepted path
is then exactly a correct tokenisation.  Whether an arc (u, v) outlives all gadgets depends on the gadgets that made u
and v and on those that cut pairs of their outer parts; arcs are materialised from that rule when first needed and kept
in a table.  A word is encoded by one pass: after each symbol the state is the last token of the unique accepted path of
the prefix, found among the tokens ending there by a table look-up.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm.base import chunks

WORD_MEMO = 400_000  # words whose ids a task keeps; beyond it the memo starts afresh


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next letter from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Automaton:
    """Compiled from merges in order; tokens are numbered by creation: symbols first, then one per merge."""

    def __init__(self, symbols: list[str], merges: list[tuple[str, str]], end: str):
        self.labels = list(symbols)
        number = {s: i for i, s in enumerate(symbols)}
        self.left, self.right = list(range(len(symbols))), list(range(len(symbols)))
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            c = number[a + b] = len(self.labels)
            self.labels.append(a + b)
            self.left.append(number[a])
            self.right.append(number[b])
            self.joined[number[a], number[b]] = c
        self.number, self.end = number, end
        self.symbols = set(symbols)
        self._arcs: dict[tuple[int, int], bool] = {}
        # A merge may come too late to ever apply: its parts were never neighbours when its turn came.
        usable = [True] * len(self.labels)
        for c in range(len(symbols), len(self.labels)):
            a, b = self.left[c], self.right[c]
            usable[c] = usable[a] and usable[b] and self._survives(a, b, c)
        # tokens by their symbols, without the mark of the word's end
        self._inner = {s: i for s, i in number.items() if usable[i] and not s.endswith(end)}
        self._final = {s[:-len(end)]: i for s, i in number.items() if usable[i] and s.endswith(end)}
        self._longest = max(map(len, number), default=0)

    def arc(self, u: int, v: int) -> bool:
        """Whether the arc from u to v is left after all gadgets."""
        known = self._arcs.get((u, v))
        if known is None:
            if len(self._arcs) > 4_000_000:
                self._arcs.clear()
            known = self._arcs[u, v] = self._survives(u, v)
        return known

    def _survives(self, u: int, v: int, made: int | None = None) -> bool:
        """Undo gadgets from the youngest: the pair must not have been cut before the younger of its tokens was made.

        Only merges before ``made`` count as cuts at first (all of them unless given)."""
        made = len(self.labels) if made is None else made
        while True:
            cut = self.joined.get((u, v))
            if cut is not None and cut < made:
                return False
            if u > v:  # u was made last: its right part was followed by v until then
                made, part = u, self.right[u]
                if part == u:
                    return True
                u = part
            else:  # v was made last (or both are one token): u was followed by its left part, the merge itself included
                made, part = v + 1, self.left[v]
                if part == v:
                    if self.right[u] == u:
                        return True
                    made, u = u, self.right[u]
                else:
                    v = part

    def encode(self, word: str) -> list[int]:
        """Token numbers of a word of symbols; its last symbol carries the end mark."""
        n = len(word)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        arcs, inner, longest = self._arcs, self._inner, self._longest
        for i in range(1, n + 1):
            table = self._final if i == n else inner
            for j in range(i - longest if i > longest else 0, i):  # longest token first
                t = table.get(word[j:i])
                if t is not None:
                    if j:
                        u = last[j]
                        known = arcs.get((u, t))
                        if not (self.arc(u, t) if known is None else known):
                            continue
                    last[i], back[i] = t, j
                    break
        path, i = [], n
        while i > 0:
            path.append(last[i])
            i = back[i]
        return path[::-1]


class WordBPE:
    """A tokenizer file: special strings, normaliser, splitting, the automaton and its ids."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        symbols = [s for s in self.vocab if s not in made]
        self.automaton = Automaton(symbols, merges, model["end_of_word_suffix"])
        self.ids = [self.vocab[s] for s in self.automaton.labels]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self._letters = {b: c for b, c in enumerate(byte_letters())}
        library = Tokenizer.from_file(path)
        self._normaliser, self._splitter = library.normalizer, library.pre_tokenizer
        self._rare = re.compile("[^\x00-\u024f\u2010-\u203a]")
        self._memo: dict[str, list[int]] = {}

    def _letter_word(self, word: str) -> list[int]:
        return [self.ids[t] for t in self.automaton.encode(word)]

    def _word(self, word: str) -> list[int]:
        ids = self._memo.get(word)
        if ids is None:
            if len(self._memo) >= WORD_MEMO:
                self._memo.clear()
            ids = self._memo[word] = self._letter_word(word.encode("utf-8").decode("latin-1").translate(self._letters))
        return ids

    def _plain(self, text: str) -> Iterator[list[int]]:
        if text.isascii() or not self._rare.search(text):
            return map(self._word, self._pattern.findall(unicodedata.normalize("NFC", text).lower()))
        # Beyond Latin letters the classes depend on the version of Unicode, so the library itself normalises and splits.
        return (self._letter_word(w) for w, _ in self._splitter.pre_tokenize_str(self._normaliser.normalize_str(text)))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for m in self._special.finditer(text) if self._special and "<|" in text else ():
            for w in self._plain(text[at:m.start()]):
                ids += w
            ids.append(self.special[m.group()])
            at = m.end()
        for w in self._plain(text[at:] if at else text):
            ids += w
        return ids

    def decode(self, ids: list[int]) -> str:
        """The labels, separated by blanks."""
        return " ".join(map(self.texts.__getitem__, ids))


_loaded: dict[str, WordBPE] = {}


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(key, ids, decoded), or with ``digests`` (key, n_tokens, ids_sha256, decoded_sha256).

    ``path`` must be readable on every worker.  A null text is empty.  One row per input row; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = WordBPE(path)
        bpe = _loaded[path]
        for part in chunks(batches, "text", 2 << 20):
            ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
            plain = [bpe.decode(x) for x in ids]
            if digests:
                cols = [pa.array(map(len, ids), pa.int64()), pa.array([hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(p.encode()).hexdigest() for p in plain])]
                yield pa.RecordBatch.from_arrays([part.column("key"), *cols], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(ids, pa.list_(pa.int32())), pa.array(plain)], names=["key", "ids", "decoded"])

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {out}").withColumnRenamed("key", key)
