"""Small dense logistic models, fitted on bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most; those with the smallest hash of their id.
SAMPLE = 6000


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed, id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> DataFrame:
    """``id``, ``text``, ``label`` of the rows of at most ``most`` labelled ids; ``allowed`` is a condition on ``id``.  Ids
    with two labels are left out; an id that stands with two texts gives a row for each."""
    picked = (
        labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label"))
        .where(allowed(F.col("id")) & F.col("label").isin(0, 1))
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .drop("other")
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(picked), "id")  # at most ``most`` rows of two numbers


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 200, rate: float = 0.1) -> np.ndarray:
    """Weights, the bias last, by Adam on the whole (bounded) sample; ridge on all but the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        g = x.T @ (sigmoid(x @ w.astype(x.dtype)) - y) / max(1, len(y))
        g = g.astype(float) + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities, with smoothed targets."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if not len(z):
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-6, float(np.abs(z).mean()))
    a, b = fit((z / scale)[:, None], target, ridge=1e-6, steps=400)
    return float(max(a, 1e-6) / scale), float(b)
