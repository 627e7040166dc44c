"""Toxicity by a weighted lexicon.

Text is folded first: lower case, look-alike letters to Latin ones, digits and signs that stand for letters to
those letters, everything else to spaces.  The lexicon holds word beginnings (a word is its own longest one) with
their log-odds among toxic and clean rows of a bounded labelled sample; an Aho-Corasick automaton finds them.  A hit
inside an exception phrase does not count.  The weights found, and their density in the text's words, go through a
logistic curve fitted on the same sample.

Nulls and empty texts have no hits and get the curve's value for none.  Without labels of both kinds every score is 0.
Rows with a null id are scored like others; repeated rows get equal scores; only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logit
from .common import arrow_batches, text_column

THRESHOLD = 0.7
#: Look-alike letters of other scripts, and signs that stand for letters.
LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ſ": "s", "ɡ": "g",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("class clown", "clown fish", "circus clown", "trash can", "trash bin", "white trash bag", "pond scum", "soap scum", "sore loser rule")
#: Lengths of word beginnings, the share of toxic rows an entry needs, and of clean rows it may have.
LENGTHS, SUPPORT, CLEAN, MOST = range(4, 13), 0.04, 0.002, 400


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {c: " " for c in range(128) if not chr(c).isalnum()}
    out |= {ord(k): v for k, v in LOOKALIKE.items()}
    out |= {ord(k): v for k, v in SIGNS.items() if k != "!"}
    out |= dict.fromkeys(map(ord, INVISIBLE))
    out |= {0xFF41 + k: chr(97 + k) for k in range(26)}
    return out


FOLD = _table()


def fold(text: str) -> str:
    """The folded text, with a space before and after."""
    return " " + text.lower().translate(FOLD) + " "


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean rows with each word beginning."""
    for batch in batches:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = set(fold(text).split())
            seen[label].update({w[:k] for w in found for k in LENGTHS if len(w) >= k})
        keys = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])


class Lexicon:
    """Entries with weights, exception phrases, and the automaton over both (built once in each worker)."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, curve: tuple[float, float, float] | None = None):
        self.weights, self.exceptions, self.curve, self._machine = weights, exceptions, curve, None

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}

    @property
    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for e, w in self.weights.items():
                self._machine.add_word(" " + e, (len(e) + 1, w))
            for e in self.exceptions:
                key = fold(e).rstrip()
                self._machine.add_word(key, (len(key), None))
            self._machine.make_automaton()
        return self._machine

    def evidence(self, text: str) -> tuple[float, float]:
        """The weight of all hits outside exceptions, and that weight for each hundred words."""
        folded = fold(text)
        hits, safe = [], []
        if self.weights:
            for end, (size, weight) in self.machine.iter(folded):
                (safe if weight is None else hits).append((end - size + 1, end, weight))
        total = sum(w for a, b, w in hits if not any(s <= a and b <= e for s, e, _ in safe))
        return total, 100 * total / max(1, len(folded.split())) if total else 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        x = np.array([self.evidence(t) for t in texts]).reshape(-1, 2)
        a, b, c = self.curve
        return logit.sigmoid(a * np.log1p(x[:, 0]) + b * np.log1p(x[:, 1]) + c)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", allowed=None, sample: int = logit.SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon and its curve from rows whose id ``allowed`` accepts."""
    allowed = allowed or (lambda c: c.isNotNull())
    rows = logit.sample(docs, labels, label, allowed, id, text, sample).select("text", "label")
    n = {r.label: r.n for r in rows.dropDuplicates(["text"]).groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Lexicon({}, exceptions)
    once = rows.dropDuplicates(["text"])
    counted = once.mapInArrow(_counts, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    found = counted.where((F.col("t") >= max(3, SUPPORT * n[1])) & (F.col("c") <= CLEAN * n[0])).orderBy(F.desc("t"), F.length("entry"), "entry").limit(MOST).collect()
    weights: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r.entry), r.entry)):
        if not any(r.entry.startswith(e) for e in weights):  # the shortest beginning stands for the longer ones
            weights[r.entry] = float(np.log(((r.t + 0.5) / (n[1] + 1)) / ((r.c + 0.5) / (n[0] + 1))))
    lexicon = Lexicon(weights, exceptions)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = [lexicon.evidence(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x for x, _ in e], pa.float64()), pa.array([x for _, x in e], pa.float64())], ["label", "total", "density"])

    got = once.mapInArrow(evidence, "label int, total double, density double").collect()
    x = np.log1p(np.array([[r.total, r.density] for r in got]))
    w = logit.fit(x, np.array([r.label for r in got], float), ridge=1e-4, steps=400)
    return Lexicon(weights, exceptions, (float(w[0]), float(w[1]), float(w[2])))


def score(docs: DataFrame, lexicon: Lexicon, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``score`` (0 to 1) and ``predicted`` for each row."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = lexicon.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    rows = text_column(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text")
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id)


def keep_clean(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` under the threshold, with their columns, in one pass over the texts."""
    lexicon = train(docs, labels, id, text)
    at = docs.columns.index(text)
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(lexicon.scores([t or "" for t in batch.column(at).to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)
