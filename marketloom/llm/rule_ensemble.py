"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on a bounded labelled sample; every path to a node becomes a conjunctive rule over the
statistics; a lasso logistic regression keeps few of them; the kept rules are compiled into one Spark column
expression, so scoring is an expression over the statistics' columns.

Nulls and empty texts have statistics of 0.  Without labels of both kinds, or where no split tells the rows apart (equal
texts, say), the score is the share of label 1 in the sample (0.5 if it is empty).  Ids with two labels are not learned
from.  Rows with a null id are scored like others; repeated rows and ties get equal scores; an empty table gives no rows.
Texts of any length are read whole.  Only the id (of any type) and text columns are read, so further columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logit
from .common import arrow_batches, cut, slices, text_column
from .quality import base_counts

THRESHOLD = 0.3
TREES, TREE_DEPTH, LASSO = 12, 3, 0.002
_CLASSES = {"upper_share": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit_share": b"0123456789", "mark_share": b"!?", "stop_share": b".,;:", "bar_share": b"|", "symbol_share": b"#*$%&<>", "line_share": b"\n"}
_MASKS = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _CLASSES.items()}
STATISTICS = [*_CLASSES, "log_words", "mean_word", "distinct_share", "repeat_share", "dup_line_share", "other_share"]


def _statistics(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n, size = len(off) - 1, np.maximum(1, np.diff(off))
    text_of = np.repeat(np.arange(n), np.diff(off))
    found = base_counts(raw, off)
    words = np.maximum(1, found["n_words"])
    h, doc = found["_words"]
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    out = {k: np.bincount(text_of[m[raw]], minlength=n) / size for k, m in _MASKS.items()}
    out["log_words"] = np.log1p(found["n_words"])
    out["mean_word"] = found["word_chars"] / words
    out["distinct_share"] = np.bincount(doc[order][new], minlength=n) / words
    out["repeat_share"] = found["n_repeat_words"] / words
    out["dup_line_share"] = found["n_dup_lines"] / np.maximum(1, np.bincount(text_of[_MASKS["line_share"][raw]], minlength=n) + 1)
    out["other_share"] = np.bincount(text_of[raw >= 0x80], minlength=n) / size
    return out


def statistics(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the statistics of ``text`` in its place."""
    others = [f for f in rows.schema if f.name != text]
    at = rows.columns.index(text)
    keep = [rows.columns.index(f.name) for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in slices(batch.column(at)):
                s = _statistics(raw, off)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in keep), *(pa.array(s[k].astype(float)) for k in STATISTICS)], [*(f.name for f in others), *STATISTICS])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *(f"{k} double" for k in STATISTICS)]))


Rule = tuple[tuple[str, bool, float], ...]


def paths(forest) -> list[Rule]:
    """The distinct paths to all nodes of the forest's trees: (statistic, at most?, threshold) steps."""
    found: dict[Rule, None] = {}

    def walk(node, rule: Rule) -> None:
        if rule:
            found.setdefault(rule)
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, limit = STATISTICS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*rule, (name, True, limit)))
            walk(node.rightChild(), (*rule, (name, False, limit)))

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), ())
    return list(found)


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, at_most, limit in rule:
        out = out & ((F.col(name) <= limit) if at_most else (F.col(name) > limit))
    return out


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", allowed=None, sample: int = logit.SAMPLE) -> Column:
    """A column expression over the statistics: the probability of label 1."""
    allowed = allowed or (lambda c: c.isNotNull())
    rows = cut(statistics(logit.sample(docs, labels, label, allowed, id, text, sample).select("label", "text"), "text"))
    total, good = rows.agg(F.count("*"), F.sum("label")).first()
    if not good or good == total:
        return F.lit(float(good or 0) / total if total else 0.5)
    data = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, maxBins=64, minInstancesPerNode=3, seed=11, featureSubsetStrategy="onethird").fit(data)
    rules = paths(forest)
    if not rules:
        return F.lit(float(good) / total)
    hits = rows.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(hits)
    z = F.lit(float(model.intercept))
    for rule, w in zip(rules, model.coefficients.toArray().tolist(), strict=True):
        if abs(w) > 1e-6:
            z = z + F.when(condition(rule), F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, probability: Column, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``score`` and ``predicted`` for each row."""
    arrow_batches(docs.sparkSession)
    rows = text_column(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text")
    out = statistics(rows, "text").select("id", probability.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id)
