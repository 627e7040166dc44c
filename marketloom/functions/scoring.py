"""Text scorers that the caller supplies, run over Arrow batches.

A scorer has ``score_batch(texts) -> scores`` and may have ``score_text(text) -> score``.  A batch that fails, or that gives another
number of scores than it got texts, is scored text by text, so a bad text costs its own score alone, which is null, with
the reason beside it; a neutral text has 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scalars import clean_text

BATCH = 16


class Scorer(Protocol):
    def score_batch(self, texts: list[str]) -> list[float]: ...


@dataclass
class WordScorer:
    """(good - bad) / (good + bad) over the words of two lists; 0 without any."""

    good: frozenset[str] = field(default_factory=lambda: frozenset("beat beats growth gain gains profit record strong upgrade upgrades raise raises".split()))
    bad: frozenset[str] = field(default_factory=lambda: frozenset("miss misses loss losses weak cut cuts downgrade downgrades lawsuit fall falls".split()))

    def score_text(self, text: str) -> float:
        words = re.findall(r"[^\W\d_]+", text.lower())
        up, down = sum(w in self.good for w in words), sum(w in self.bad for w in words)
        return (up - down) / (up + down) if up + down else 0.0

    def score_batch(self, texts: list[str]) -> list[float]:
        return [self.score_text(t) for t in texts]


#: Scorers by name; the first one is taken where another can't be made.
SCORERS: dict[str, Callable[..., Scorer]] = {"words": WordScorer}


def register_scorer(name: str, make: Callable[..., Scorer]) -> None:
    SCORERS[name] = make


def build_scorer(config: dict) -> Scorer:
    """The scorer that ``config`` names (``model``, further keys are its arguments).  One that fails to load falls back to the first of
    SCORERS; an unknown name is refused."""
    name = config.get("model", "words")
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name}: one of {', '.join(SCORERS)}")
    try:
        return SCORERS[name](**{k: v for k, v in config.items() if k != "model"})
    except Exception:
        if name == next(iter(SCORERS)):
            raise
        return next(iter(SCORERS.values()))()


def _number(x) -> float:
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("not a finite score")
    return max(-1.0, min(1.0, x))


def _alone(scorer: Scorer, text: str) -> tuple[float | None, str | None]:
    try:
        if hasattr(scorer, "score_text"):
            return _number(scorer.score_text(text)), None
        one = scorer.score_batch([text])
        if len(one) != 1:
            raise ValueError(f"{len(one)} scores for one text")
        return _number(one[0]), None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"


def scores(scorer: Scorer, texts: list[str]) -> list[tuple[float | None, str | None]]:
    """A score within [-1, 1], or a reason, for each text."""
    try:
        out = scorer.score_batch(texts)
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} scores for {len(texts)} texts")
        return [(_number(x), None) for x in out]
    except Exception:
        return [_alone(scorer, t) for t in texts]


def score_texts(df: DataFrame, scorer: Scorer, text: str = "text", name: str = "score", batch: int = BATCH, keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, if given: a text that is not kept is sent once, as it is scored, and not back) with ``name`` (null where the text could not be scored) and ``<name>_error``.  Tags and runs of white space go before
    scoring; null and blank texts have 0 and are not sent."""
    kept = df.columns if keep is None else keep
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), batch):  # texts of one call at a time stand beside the Arrow batch
                b = whole.slice(lo, batch)
                texts = b.column("__clean").to_pylist()
                value: list[float | None] = [0.0] * len(texts)
                error: list[str | None] = [None] * len(texts)
                at = [k for k, t in enumerate(texts) if t]
                if at:
                    for k, (x, e) in zip(at, scores(scorer, [texts[k] for k in at]), strict=True):
                        value[k], error[k] = x, e
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(value, pa.float64()), pa.array(error, pa.string())], [*b.schema.names[:-1], name, f"{name}_error"])

    cleaned = df.select(*kept, F.coalesce(clean_text(F.col(text)), F.lit("")).alias("__clean"))
    return cleaned.mapInArrow(run, f"{kinds}, `{name}` double, `{name}_error` string")
