"""Language identification in two steps: the family first, then one-versus-one linear SVMs among its languages.

Features are relative frequencies of hashed byte trigrams of the whole text, A-Z lower-cased.  All machines are linear
SVMs (squared hinge loss, minibatch gradient steps) fitted on a sample of labelled rows chosen by a hash: at most
``PER_LANGUAGE`` texts per language and about ``SAMPLE_ROWS`` in all (one per language at least).  Tasks count the trigrams of
the sampled texts, whole ones; only those counts, at most 2^``BITS`` a text, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.base import byte_texts, chunks

BITS = 13
PER_LANGUAGE, SAMPLE_ROWS = 600, 12_000
# Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
            "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
            "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic"}
UNKNOWN = "und"
_LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _codes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data.translate(_LOW), np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)) & np.uint32((1 << BITS) - 1)


def _trigrams(text: bytes) -> np.ndarray:
    """How often each hashed trigram occurs; a blank stands before and after the text."""
    return np.bincount(_codes(b" " + text + b" "), minlength=1 << BITS)


def _svm(x: np.ndarray, y: np.ndarray, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM; y is -1 or 1.  Rows are scaled to unit length during training only."""
    scale = 1 / np.maximum(np.sqrt((x * x).sum(1)), 1e-9)
    w, b, rng = np.zeros(x.shape[1], np.float32), 0.0, np.random.default_rng(7)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for e in range(epochs):
        rate = 0.5 / (1 + e)
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            rows = x[part] * scale[part, None]
            slack = np.maximum(0, 1 - y[part] * (rows @ w + b)) * share[part] * y[part]
            w += rate * (slack @ rows / len(part) - 1e-4 * w)
            b += rate * float(slack.mean())
    return w, b


class LanguageModel:
    """Family machines (one against the rest) and pair machines inside each family, as columns of one weight matrix."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        """``x``: a row of relative trigram frequencies for each label in ``langs``."""
        self.langs = sorted(set(langs))
        family = {a: FAMILIES.get(a, a) for a in self.langs}
        self.families = sorted(set(family.values()))
        self.members = [[a for a in self.langs if family[a] == f] for f in self.families]
        self.pairs = [(a, b) for m in self.members for a, b in combinations(m, 2)]
        columns, bias = [], []
        if langs:
            lang = np.array(langs)
            fam = np.array([family[a] for a in langs])
            machines = [(np.ones(len(lang), bool), np.where(fam == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
            machines += [((lang == a) | (lang == b), np.where(lang == a, 1.0, -1.0)) for a, b in self.pairs]
            for rows, y in machines:
                w, b = _svm(x[rows], y[rows].astype(np.float32))
                columns.append(w)
                bias.append(b)
        self.weights = np.stack(columns, 1) if columns else np.zeros((1 << BITS, 0), np.float32)
        self.bias = np.array(bias, np.float32)

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is the product of the logistic margins on the way.

        The first of equal families wins; equal votes go to the larger sum of margins, then to the greater code.
        """
        out = []
        family_at = len(self.families) if len(self.families) > 1 else 0
        for t in texts:
            n = _trigrams(t).astype(np.float32)
            margin = (n @ self.weights) / np.sqrt(float(n @ n)) + self.bias
            chance = 1 / (1 + np.exp(-4 * margin.astype(np.float64)))
            f = int(np.argmax(margin[:family_at])) if family_at else 0
            score = float(chance[f]) if family_at else 1.0
            votes = dict.fromkeys(self.members[f], 0.0)
            own: dict[str, list[float]] = {a: [] for a in votes}
            for k, (a, b) in enumerate(self.pairs):
                if a in votes:
                    p = float(chance[family_at + k])
                    votes[a] += p > 0.5
                    votes[b] += p <= 0.5
                    own[a].append(p)
                    own[b].append(1 - p)
            best = max(votes, key=lambda a: (votes[a], sum(own[a]), a))
            out.append((best, score * (min(own[best]) if own[best] else 1.0)))
        return out


def fitted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on a bounded sample of whole texts: per language those of lowest hash (see the module).

    Rows without a label, null texts and texts without a letter teach nothing; without any row left the model predicts ``und``.
    Repeated rows have one hash and may be taken as often as they occur; null keys and other columns do not matter.  Every
    distinct label is a language and gets machines of its own, so the labels themselves have to fit the driver.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text, F.col(key).cast("string")).alias("h"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel(np.zeros((0, 1 << BITS), np.float32), [])
    each = max(1, min(PER_LANGUAGE, SAMPLE_ROWS // len(counts)))
    # A threshold on the hash takes a few more than needed; the rest is settled by sorting that bounded rest.
    limits = docs.sparkSession.createDataFrame(pa.table(  # an Arrow table, so that Spark knows its size
        {"lang": list(counts), "most": [min(1.0, (1.3 * each + 20) / n) * 2.0**64 - 2.0**63 for n in counts.values()]}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            at, times = [], []
            for t in byte_texts(part.column("text")):
                n = _trigrams(t)
                at.append(np.flatnonzero(n).astype("<u2").tobytes())
                times.append(n[n > 0].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(at, pa.binary()), pa.array(times, pa.binary())],
                                             names=["lang", "h", "at", "times"])

    near = rows.join(limits, "lang").where(F.col("h").cast("double") <= F.col("most")).select("lang", "h", "text")
    sample, seen = [], dict.fromkeys(counts, 0)
    for r in sorted(near.mapInArrow(count, "lang string, h long, at binary, times binary").collect(), key=lambda r: (r.lang, r.h, bytes(r.at))):
        if seen[r.lang] < each:
            seen[r.lang] += 1
            sample.append(r)
    x = np.zeros((len(sample), 1 << BITS), np.float32)
    for row, r in zip(x, sample):
        n = np.frombuffer(r.times, "<u4")
        row[np.frombuffer(r.at, "<u2")] = n / max(1, n.sum())
    return LanguageModel(x, [r.lang for r in sample])


def languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every whole text; ``und`` with score 0 for null texts and those without a letter.

    Other columns, repeated rows and null keys are passed over or returned as they are.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            letters = [x is not None and x for x in part.column("letters").to_pylist()]
            got = iter(model.predict([t for t, ok in zip(byte_texts(part.column("text")), letters) if ok]) if model.langs else [(UNKNOWN, 0.0)] * len(letters))
            both = [next(got) if ok else (UNKNOWN, 0.0) for ok in letters]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([a for a, _ in both]), pa.array([float(s) for _, s in both])],
                                             names=["key", "lang_pred", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(text).rlike(r"\p{L}").alias("letters")).mapInArrow(
        run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def identified(docs: DataFrame, model: LanguageModel, least: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` without the texts whose language is ``und`` or whose score is below ``least``.

    Null, empty and letterless texts go; repeated rows stay as often as they occur; columns are as they were, whatever their names.
    """

    @F.pandas_udf("boolean")
    def known(texts: pd.Series, letters: pd.Series) -> pd.Series:
        rows = [(t or "").encode() for t in texts]
        has = [bool(x) for x in letters.fillna(False)]
        got = iter(model.predict([t for t, ok in zip(rows, has) if ok]) if model.langs else [(UNKNOWN, 0.0)] * len(rows))
        return pd.Series([next(got)[1] >= least if ok else False for ok in has], dtype=bool)

    return docs.where(known(F.col(text), F.col(text).rlike(r"\p{L}")))
