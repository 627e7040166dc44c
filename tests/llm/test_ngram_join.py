"""The n-gram Jaccard join against all pairs: whole tables, sets at the threshold, crowded nodes, odd rows."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from marketloom.llm import ngram_join, queries

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def joined(texts):
    """{id: (size, component)} and the linked pairs of ids, from counts of shared shingles over all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    shared = Counter()
    for group in holders.values():
        group.sort()
        shared.update((a, b) for n, a in enumerate(group) for b in group[n + 1 :])
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {(a, b): n for (a, b), n in shared.items() if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)}
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: (len(sets[k]), find(k)) for k in texts}, links, sets


def values(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def prose(rng, n, vocabulary=4000):
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


@pytest.mark.parametrize("sf", [SMALL, MORE])
def test_op12_against_all_pairs(spark, sf):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    assert values(queries.op12_ngram_join(spark, sf)) == joined(texts)[0]


@pytest.mark.parametrize("run", [1024, 8])
def test_links_at_the_threshold_and_in_crowded_nodes(spark, monkeypatch, run):
    """Chains of edits whose similarity lies on both sides of 0.85; with small runs every node takes the way of large ones."""
    monkeypatch.setattr(ngram_join, "RUN", run)
    rng = np.random.default_rng(11)
    texts = {}
    for base in range(12):
        words = prose(rng, int(rng.integers(5, 400)))
        for _ in range(25):
            texts[len(texts)] = " ".join(words)
            words = list(words)
            for at in rng.integers(0, len(words), max(1, len(words) // int(rng.integers(20, 60)))):
                words[at] = f"e{rng.integers(10**6)}"
            if rng.random() < 0.5:
                words += prose(rng, max(1, len(words) // 30))
    common = prose(rng, 60)
    for _ in range(120):  # a passage that many share, and one that is nearly all there is
        texts[len(texts)] = " ".join([*common, *prose(rng, int(rng.integers(1, 30)))])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, links, sets = joined(texts)
    assert values(ngram_join.link(df)) == want
    named, members = ngram_join.pairs(df)
    of = {r.doc_id: r["class"] for r in members.collect()}
    got = {(r.class_a, r.class_b): r.shared for r in named.collect()}
    assert of == {k: min(j for j in texts if sets[j] == sets[k]) for k in texts}
    assert got == {(a, b): n for (a, b), n in links.items() if of[a] == a and of[b] == b}


def test_traversal_drops_no_link():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 2**63, 80, dtype=np.uint64) for _ in range(5)]
    sets = [np.unique(np.concatenate([rng.choice(b, 72, replace=False), rng.integers(0, 2**63, int(rng.integers(0, 12)), dtype=np.uint64)])) for b in base for _ in range(40)]
    tree = ngram_join.Tree(np.array([len(s) for s in sets]), np.stack([ngram_join.signature(s) for s in sets]), np.arange(len(sets)))
    got = Counter(tuple(sorted(p)) for i, j in ngram_join.traverse(tree, tree, 85) for p in zip(i.tolist(), j.tolist(), strict=True))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if ngram_join.linked(sets[i], sets[j], 85)}
    assert {tuple(sorted(p)) for p in want} <= set(got) and max(got.values()) == 1 and len(got) < len(sets) ** 2 / 4


def test_odd_rows(spark):
    long = " ".join(prose(np.random.default_rng(4), 400_000, 10**6))
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "one two three", "a b c d", "a b c d e", "é É", long, long + " end", "x y z w " * 50, "x y z w " * 51]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "one"), (5, "another text here now"), (None, "one"), (None, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "doc_id long, text string, node long, token string, n int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(df).collect())
    sizes = lambda t: len(shingles(t))
    least = {4: 3, 6: 5, 11: 10, 13: 12}
    want = Counter((k, sizes(t), None if k is None else least.get(k, k)) for k, t in rows)
    assert got == want
    assert ngram_join.link(df.limit(0)).isEmpty() and ngram_join.pairs(df.limit(0))[0].isEmpty()
    with pytest.raises(TypeError):
        ngram_join.link(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
