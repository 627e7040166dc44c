"""The numbered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, fingerprints, licenses, manifest, near_dedup, ngram_join, packing, quality, rule_ensemble, suffix_dedup, token_store, toxicity
from .common import shared_dir

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id_hash(id) -> F.Column:
    return F.crc32(F.col(id).cast("string") if isinstance(id, str) else id.cast("string"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    coded = bpe.encode(_table(spark, sf_dir, "documents"), path)
    return bpe.round_trip(coded, path).select(*[c.split()[0] for c in kind.split(", ")])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, _table(spark, sf_dir, "labels"), allowed=lambda c: _id_hash(c) % 3 != 1)
    return toxicity.score(docs, lexicon).select("doc_id", (_id_hash("doc_id") % 3 == 1).alias("held_out"), "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes are token counts; a duplicate cluster is a component of near copies (op3)."""
    docs = _table(spark, sf_dir, "documents")
    sized = packing.sized(docs, public_tokenizers.path(VOCABULARY), linked=True)
    return packing.pack(packing.with_components(sized, near_dedup.link(docs)))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labels(licenses.scan(_table(spark, sf_dir, "documents")))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    token_store.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY), end_id=0)
    return token_store.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    probability = rule_ensemble.train(docs, _table(spark, sf_dir, "labels"), allowed=lambda c: _id_hash(c) % 5 != 0)
    return rule_ensemble.score(docs, probability).select("doc_id", (_id_hash("doc_id") % 5 == 0).alias("held_out"), "score", "predicted")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("span_from").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")), "conv_id")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering, where 3 divides the id's crc32, lower-cases A-Z of the text."""
    c, capitals = F.col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    docs = _table(spark, sf_dir, "documents")
    harmed = manifest.leaf(c("doc_id"), c("source"), c("lang"), c("n_chars"), F.translate(c("text"), capitals, capitals.lower()))
    own = manifest.leaf(c("doc_id"), c("source"), c("lang"), c("n_chars"), c("text"))
    leaves = docs.select("doc_id", manifest.group_key(c("lang")).alias("group"), own.alias("digest"), F.when(_id_hash("doc_id") % 3 == 0, harmed).alias("harmed"))
    proved = manifest.prove(leaves, ["doc_id", "digest"])
    folded = proved.select("doc_id", c("digest").alias("leaf"), "subroot", "root", manifest.proof_digest(c("proof")).alias("proof_sha256"), manifest.fold(F.coalesce("harmed", "digest"), c("proof")).alias("folded_root"))
    return folded.withColumn("verified", c("folded_root") == c("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality_rules, op3_near_dedup, op4_toxicity, op5_packing, op6_licenses, op7_token_store, op8_fingerprints, op9_quality_classifier, op10_suffix_dedup, op11_conversation_repair, op12_ngram_join, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    """None of the ten results can be written in SQL at these sizes; tests/llm holds brute-force versions."""
    return {}
