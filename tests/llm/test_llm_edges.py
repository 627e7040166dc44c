"""Edge cases of every operator: empty tables, nulls, repeated rows, clashing names, kinds of ids."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import prose

from marketloom.llm import bpe, fingerprints, licenses, near_dedup, packing, quality, rule_ensemble, suffix_dedup, token_store, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, id string, node long, bucket int, c0 string, __kept string, h long"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)] + [(0, 1, 1)], "doc_id long, quality int, toxic int")


def rows(texts):
    return [(k, t, None, "x", 1, 2, "y", "z", 3) for k, t in enumerate(texts)]


def operators(labels):
    return {
        "bpe": lambda d: bpe.decode(bpe.encode(d, PATH), PATH),
        "quality": lambda d: quality.rules(d, labels),
        "keep_good": lambda d: quality.keep_good(d, labels),
        "near": near_dedup.link,
        "keep_first": near_dedup.keep_first,
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "keep_clean": lambda d: toxicity.keep_clean(d, labels),
        "packing": lambda d: packing.pack(packing.sized(d, PATH)),
        "licenses": lambda d: licenses.labels(licenses.scan(d)),
        "fingerprints": fingerprints.compare,
        "rules": lambda d: rule_ensemble.score(d, rule_ensemble.train(d, labels)),
        "suffix": suffix_dedup.cut_repeats,
        "cut_texts": suffix_dedup.cut_texts,
    }


@pytest.mark.parametrize("name", sorted(operators(None)))
def test_empty_and_odd_tables(spark, labels, name):
    run = operators(labels)[name]
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([*rows([None, "", "a", prose(1, 90), prose(1, 90)]), (None, None, None, None, None, None, None, None, None), (None, "b " * 70, *[None] * 7), (3, prose(1, 90), *[None] * 7)], SCHEMA)
    n = run(odd).count()
    assert n == 8 if name not in ("keep_good", "keep_first", "keep_clean") else n <= 8


def test_store_of_an_empty_table(spark, tmp_path):
    token_store.write(spark.createDataFrame([], SCHEMA), str(tmp_path), PATH)
    assert token_store.read(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("run", [near_dedup.link, fingerprints.compare, suffix_dedup.cut_texts])
def test_ids_that_are_no_numbers_are_refused(spark, run):
    with pytest.raises(TypeError, match="whole numbers"):
        run(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_an_id_with_two_texts_ties_their_copies(spark):
    p, q = prose(11, 80), prose(12, 80)
    docs = spark.createDataFrame([(5, p), (5, q), (9, q + " more"), (11, p + " more"), (12, prose(13, 80))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.link(docs).collect()} == {(5, 5), (9, 5), (11, 5), (12, 12)}
    assert sorted((r.doc_id, r.text) for r in near_dedup.keep_first(docs).collect()) == sorted([(5, min(p, q)), (12, prose(13, 80))])


def test_license_labels_do_not_hang_on_the_neighbour(spark):
    texts = ["permission is hereby granted free of charge to any person obtaining a", "hello world today", "Released under the MIT-license", "copy of nothing", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    together = {r.doc_id: r for r in licenses.labels(licenses.scan(docs.coalesce(1))).collect()}
    for k in range(len(texts)):
        assert licenses.labels(licenses.scan(docs.where(F.col("doc_id") == k))).first() == together[k]
    assert together[0].labels == "mit" and together[1].labels == "" and 0.9 < together[0].score < 1


def test_rules_without_a_split_give_the_share(spark):
    docs = spark.createDataFrame([(k, "same text") for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 3)) for k in range(12)], "doc_id long, quality int")
    assert rule_ensemble.score(docs, rule_ensemble.train(docs, labels)).select("score").distinct().first().score == pytest.approx(0.25)


def test_stored_fingerprints_tell_what_differs(spark):
    lines = [f"line {k} {prose(200 + k, 6)}." for k in range(60)]
    docs = spark.createDataFrame([(2, "\n".join(lines)), (1, "\n".join([*lines[:58], "a new line", "and another"]))], "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in fingerprints.compare(docs).collect()}
    pair = spark.createDataFrame([(prints[2], prints[1])], "fingerprint string, edited_fingerprint string")
    own = {r.doc_id: set(r.k) for r in docs.select("doc_id", F.expr(fingerprints.digests("text")).alias("k")).collect()}
    got = fingerprints.difference(pair).collect()
    assert {r.k for r in got if r.n == 1} == own[2] - own[1] and {r.k for r in got if r.n == -1} == own[1] - own[2]


def test_adjacent_prefixes():
    import numpy as np

    m = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 4], [2, 2, 4]])
    assert near_dedup.adjacent_prefixes(m).tolist() == [0, 2, 3, 0]


def test_suffix_order_and_longest_previous():
    import random

    import numpy as np

    from marketloom.llm.common import prefix_sums, span_hashes

    rng = random.Random(5)
    for length in (50, 20, 9):
        raw = bytearray("".join(rng.choice("ab") for _ in range(500)).encode())
        raw[300:400], raw[410:490] = raw[10:110], raw[12:92]
        raw = bytes(raw)
        data, at = np.frombuffer(raw, np.uint8), np.array(rng.sample(range(500 - length), 300))
        docs = np.array([rng.randint(0, 6) for _ in at])
        order, common = suffix_dedup.suffix_order(data, at, span_hashes(prefix_sums(data), at, at + length), length)
        suffixes = [raw[at[k] : at[k] + length] for k in order]
        assert suffixes == sorted(suffixes)
        assert all(len(__import__("os").path.commonprefix([a, b])) == c for a, b, c in zip(suffixes, suffixes[1:], common[1:], strict=False))
        got = suffix_dedup.longest_previous(order, common, docs, length) >= length
        assert [bool(g) for g in got] == [any(docs[j] < docs[k] and raw[at[j] : at[j] + length] == raw[at[k] : at[k] + length] for j in range(len(at))) for k in range(len(at))]
