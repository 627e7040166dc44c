"""A corpus pipeline of five stages, each over all that its predecessor kept.

Null and empty texts fail the quality rules and go there, as do rows of an id's repeats past the first at the third
stage (null ids all stay).  Ties go to the smallest id.  An empty table passes through all stages.  Texts are read whole
whatever their length.  All stages but the last keep the columns of ``documents``, further ones too, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import near_dedup, packing, quality, suffix_dedup, toxicity
from marketloom.llm.common import shared_dir
from marketloom.llm.queries import VOCABULARY


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def toxic_terms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold go."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return near_dedup.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds are cut; every document stays, with the length of what is left."""
    cut = suffix_dedup.cut_texts(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into bins of 4,096 tokens."""
    return packing.pack(packing.sized(docs, public_tokenizers.path(VOCABULARY)))


STAGES = [("quality rules", quality_rules), ("toxicity", toxic_terms), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("best-fit packing", best_fit)]

#: Trained models, links and packing can't be written in SQL; tests/llm checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
