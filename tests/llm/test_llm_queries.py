"""The numbered queries and the pipeline on the driver's smallest tables, against brute force and held-out labels."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import base_counts, components
from tokenizers import Tokenizer

import corpus_pipeline
from marketloom.llm import fingerprints, queries

DATA, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall())


@pytest.fixture(scope="module")
def coded(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {k: (tokenizer.encode(t, add_special_tokens=False).ids, tokenizer) for k, t in texts.items()}


def cut_by_hand(texts):
    """The kept bytes of each text after every 50 bytes that also start in a smaller document are gone."""
    first, out = {}, {}
    for k, t in texts.items():
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], k)
    for k, t in texts.items():
        b, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        out[k] = (bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(gone), len(re.findall(b"\1+", bytes(gone))))
    return out


def test_op1_and_op7(spark, coded):
    got, at = {r.doc_id: r for r in queries.op7_token_store(spark, DATA).collect()}, 0
    one = {r.doc_id: r for r in queries.op1_bpe(spark, DATA).collect()}
    for k, (ids, tokenizer) in coded.items():
        full = np.array([*ids, 0], "<u4").tobytes()
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids) + 1, zlib.crc32(full))
        assert (one[k].n_tokens, one[k].ids_sha256, one[k].decoded_sha256) == (len(ids), sha(full[:-4]), sha(tokenizer.decode(ids, skip_special_tokens=False).encode()))
        at += len(ids) + 1
    assert len(got) == len(one) == len(coded)


def test_op2_base_and_verdict(spark, texts):
    for r in queries.op2_quality_rules(spark, DATA).collect():
        want = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_op2_keeps_good_rows_and_drops_bad_ones(spark):
    labels = spark.read.parquet(f"{MORE}/labels.parquet").select("doc_id", "quality").where("quality IS NOT NULL")
    got = queries.op2_quality_rules(spark, MORE).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept"))
    share = {r.quality: r.kept for r in got.collect()}
    assert share[1] > 0.97 and share[0] < 0.1


@pytest.mark.parametrize(("query", "label", "least"), [("op4_toxicity", "toxic", 0.9), ("op9_quality_classifier", "quality", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    labels = spark.read.parquet(f"{MORE}/labels.parquet").select("doc_id", label).where(f"{label} IS NOT NULL")
    got = queries.queries()[query](spark, MORE)
    n = 3 if label == "toxic" else 5
    assert got.where(f"held_out <> (crc32(cast(doc_id as string)) % {n} = {1 if n == 3 else 0})").isEmpty() and got.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least


def test_op3_against_all_pairs(spark, texts):
    want = components(list(texts.values()))
    for r in queries.op3_near_dedup(spark, DATA).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_op6_base_places(spark, texts):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for r in queries.op6_licenses(spark, DATA).collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(hits), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and {x for _, x in hits} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op8_sketches_give_the_exact_likeness(spark, texts):
    got = {r.doc_id: r for r in queries.op8_fingerprints(spark, DATA).collect()}
    ids = sorted(texts, reverse=True)
    follows = {a: b for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)}
    edited = {k: t[: len(t) - len(t) // 2] + texts[follows[k]][: len(t) // 2] for k, t in texts.items()}
    rows = [(k, texts[k], edited[k], texts[follows[k]]) for k in ids]
    table = spark.createDataFrame(rows, "id long, a string, b string, c string").select("id", *[F.expr(fingerprints.digests(c)).alias(c) for c in "abc"])
    like = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
    for r in table.collect():
        g, a, b, c = got[r.id], set(r.a), set(r.b), set(r.c)
        assert g.n_chars == len(texts[r.id]) and g.edited_sha256 == sha(edited[r.id].encode())
        assert g.near_edited == pytest.approx(like(a, b)) and g.near_next == pytest.approx(like(a, c))
    same = collections.defaultdict(set)
    for k, t in texts.items():
        same[t].add(got[k].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_op10_against_brute_force(spark, texts):
    want = cut_by_hand(texts)
    for r in queries.op10_suffix_dedup(spark, DATA).collect():
        kept, removed, spans = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(texts[r.doc_id].encode()), removed, spans, sha(kept))


def test_op5_bins(spark, coded):
    got = queries.op5_packing(spark, DATA).collect()
    total, bins = collections.Counter(), collections.Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
        bins[r.bin_id] += r.n_tokens
    assert total == collections.Counter({k: len(ids) for k, (ids, _) in coded.items()}) and max(bins.values()) <= 4096


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage on its own input, by plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        kept = {r.doc_id for r in after}
        if name == "quality rules":
            failed = {i for i, r in before.items() if (c := base_counts(r.text))[0] < 50 or 100 * c[4] > 50 * c[0]}
            assert not kept & failed and len(kept) > 0.8 * (len(before) - len(failed))
        elif name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
            clean = set(before) - toxic
            assert len(kept & clean) > 0.97 * len(clean) and len(kept & toxic) <= len(toxic & set(before))
        elif name == "near duplicates":
            order = sorted(before)
            label = components([before[i].text for i in order])
            assert kept == {i for n, i in enumerate(order) if label[n][1] == n}
        elif name == "repeated passages":
            want = cut_by_hand({i: before[i].text or "" for i in sorted(before)})
            assert {r.doc_id: r.text for r in after} == {i: w[0].decode("utf-8", "ignore") for i, w in want.items()}
            assert all(r.n_chars == len(r.text) for r in after)
        else:
            assert kept == set(before)
