"""Quality rules: base counts, then a hashed n-gram model against a fixed threshold.

Base counts over words ``[^\\x20\\x09-\\x0D]+`` of the whole text: ``n_words``, ``word_chars`` (code points in words),
``n_symbols`` (characters of ``[#*$%&|<>]``), ``n_dup_lines`` (lines with a word that equal an earlier line),
``n_repeat_words`` (words in a 3-word window that stands twice or more).  ``base_failed``: under 50 words, or more
than half of them repeated.

The model is a logistic regression on hashed word unigrams and bigrams and byte trigrams and 5-grams, as shares of
the text, trained on a bounded sample of labelled rows (``SAMPLE``), calibrated on a fifth that the weights did
not see.  ``kept`` is false if ``base_failed``, else whether the probability reaches ``threshold`` (a tie is kept).

Nulls and empty texts have no words, fail the base rules and score the model's bias.  Without labels of both
kinds the model is not fitted and scores 1, so the base rules decide.  Ids with two labels are not learned from.  Rows
with a null id are scored like others, repeated rows get equal scores, an empty table gives no rows.  Texts of any length
are read whole.  Ids may be of any type, and further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logit
from .common import LOWER, SLICE_BYTES, SPACES, arrow_batches, mix, prefix_sums, slices, span_hashes, text_column, words

#: Hash buckets of each kind of n-gram.
WORD_SPACE, GRAM_SPACE = 2048, 2048
THRESHOLD = 0.5
#: Labelled rows that the model is fitted on at most, its ridge, and the steps of the fit.
SAMPLE, RIDGE, STEPS = 4000, 0.01, 40
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True


def base_counts(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text of a slice, with its words."""
    n = len(off) - 1
    text_of = lambda at: np.searchsorted(off, at, side="right") - 1
    count = lambda at: np.bincount(text_of(at), minlength=n)
    starts, ends, doc = words(raw, off)
    sums = prefix_sums(raw)
    h = span_hashes(sums, starts, ends)
    n_words = np.bincount(doc, minlength=n)
    heads = (raw & 0xC0) != 0x80  # first bytes of characters
    # lines: a word's line end, and whether the same line stood before in the text
    ls, le, ld = words(raw, off, _LINE_END)
    has_word = np.zeros(len(ls), bool)
    if len(ls) and len(starts):
        has_word[np.searchsorted(ls, starts, side="right") - 1] = True
    lh = span_hashes(sums, ls[has_word], le[has_word])
    dup = _repeats(lh, ld[has_word], later_only=True)
    # three-word windows that stand twice in their text
    tri = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    th = mix(h[tri] * np.uint64(0x9E3779B97F4A7C15) + mix(h[tri + 1] + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F) + h[tri + 2]) if len(tri) else np.zeros(0, np.uint64)
    again = tri[_repeats(th, doc[tri], later_only=False)]
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[again + k] = True
    return {
        "n_words": n_words,
        "word_chars": count(np.flatnonzero(heads & ~SPACES[raw])),
        "n_symbols": count(np.flatnonzero(_SYMBOL[raw])),
        "n_dup_lines": np.bincount(ld[has_word][dup], minlength=n),
        "n_repeat_words": np.bincount(doc[covered], minlength=n),
        "_words": (h, doc),
    }


def _repeats(h: np.ndarray, doc: np.ndarray, later_only: bool) -> np.ndarray:
    """Which (text, hash) stand more than once in their text; the first of them too unless ``later_only``."""
    order = np.lexsort((h, doc))  # stable: places ascend where text and hash are equal
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out = np.zeros(len(h), bool)
    out[order] = same[:-1] if later_only else same[:-1] | same[1:]
    return out


def features(raw: np.ndarray, off: np.ndarray, counted: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: bucket, text number and share of the text of each n-gram."""
    h, doc = counted["_words"]
    n = len(off) - 1
    size = np.maximum(1, np.bincount(doc, minlength=n))
    low = LOWER[raw]
    half = np.uint64(WORD_SPACE // 2)
    yield (h % half).astype(np.int64), doc, 1 / size[doc]
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) > 1 else np.zeros(0, np.int64)
    yield ((h[pair] * np.uint64(31) ^ h[pair + 1] >> np.uint64(7)) % half + half).astype(np.int64), doc[pair], 1 / size[doc[pair]]
    text_of = np.repeat(np.arange(n), np.diff(off))
    sizes = np.maximum(1, np.diff(off))
    for g, base in ((3, WORD_SPACE), (5, WORD_SPACE + GRAM_SPACE // 2)):
        if len(raw) < g:
            continue
        code = np.zeros(len(raw) - g + 1, np.uint32)
        for src in (raw if g == 3 else low,):
            for k in range(g):
                code = code * np.uint32(0x01000193) ^ src[k : k + len(code)]
        code *= np.uint32(0x9E3779B1)
        inside = text_of[g - 1 :] == text_of[: len(text_of) - g + 1]
        d = text_of[: len(code)][inside]
        yield (code[inside] >> np.uint32(22)).astype(np.int64) % (GRAM_SPACE // 2) + base, d, 1 / sizes[d]


SPACE = WORD_SPACE + GRAM_SPACE


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``label``, ``held`` and a feature array of fixed size for each sampled text."""
    for batch in batches:
        for i, j, raw, off in slices(batch.column(0), SLICE_BYTES // 4):
            x = np.zeros((j - i) * SPACE, np.float64)
            for bucket, doc, share in features(raw, off, base_counts(raw, off)):
                x += np.bincount(doc * SPACE + bucket, share, minlength=len(x))
            offsets = pa.array(np.arange(0, len(x) + 1, SPACE, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.float32)))], ["label", "held", "x"])


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float, float, float] | None:
    """Weights, bias, slope and shift of the model; None where a kind of label is missing.  The weights are fitted by
    Spark over the sample's partitions; a fifth of the sample, chosen by a hash of the id, calibrates them."""
    rows = logit.sample(docs, labels, label, lambda c: c.isNotNull(), id, text, sample)
    rows = rows.select("text", "label", (F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) == 0).alias("held"))
    rows = rows.mapInArrow(_vectors, "label int, held boolean, x array<float>").persist()
    try:
        kinds = {(r.label, r.held) for r in rows.select("label", "held").distinct().collect()}
        if len({k for k, held in kinds if not held}) < 2:
            return None
        data = rows.select(F.col("label").cast("double").alias("label"), "held", array_to_vector("x").alias("features"))
        fitted = LogisticRegression(regParam=RIDGE, elasticNetParam=0.0, maxIter=STEPS).fit(data.where("not held").select("label", "features"))
        held = fitted.transform(data.where("held")).select("label", vector_to_array("rawPrediction")[1].alias("z")).collect()  # a fifth of the sample, two numbers a row
    finally:
        rows.unpersist()
    slope, shift = logit.platt(np.array([r.z for r in held]), np.array([r.label for r in held]))
    return fitted.coefficients.toArray(), float(fitted.intercept), slope, shift


def score(docs: DataFrame, model: tuple | None, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id``, the base counts, ``base_failed``, ``score`` and ``kept`` for each row."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    rows = text_column(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in slices(batch.column(1)):
                found = base_counts(raw, off)
                p = np.ones(j - i)
                if model is not None:
                    w, bias, slope, shift = model
                    z = np.full(j - i, bias)
                    for bucket, doc, share in features(raw, off, found):
                        z += np.bincount(doc, w[bucket] * share, minlength=j - i)
                    p = logit.sigmoid(slope * z + shift)
                failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(found[c], pa.int64()) for c in counts), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], ["id", *counts, "base_failed", "score", "kept"])

    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, score double, kept boolean").withColumnRenamed("id", id)


def rules(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Train on ``labels`` and score ``docs``."""
    return score(docs, train(docs, labels, id, text), id, text, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns, in one pass over the texts."""
    model = train(docs, labels, id, text)
    names = docs.columns
    at = names.index(text)
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, j, raw, off in slices(batch.column(at)):
                found = base_counts(raw, off)
                failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
                p = np.ones(j - i)
                if model is not None:
                    w, bias, slope, shift = model
                    z = np.full(j - i, bias)
                    for bucket, doc, share in features(raw, off, found):
                        z += np.bincount(doc, w[bucket] * share, minlength=j - i)
                    p = logit.sigmoid(slope * z + shift)
                keep[i:j] = ~failed & (p >= threshold)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
