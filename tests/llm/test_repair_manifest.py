"""Conversation repair and the Merkle manifest, against brute force on whole tables and small hand-made ones."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import conversations, manifest, queries

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(rows):
    """(cost, audit, repaired lines) by trying every edit; rows: (initial, must go, truncated, role, text)."""

    @functools.cache
    def best(i, q, inserted):
        ways = [(0, "", ())] if i == len(rows) and q in "0a" else []
        new = "a" if q == "u" else "u"
        name = {"u": "user", "a": "assistant"}[new]
        if inserted < 2:
            c, a, lines = best(i, new, inserted + 1)
            ways.append((c + 2, "I" + a, (f"{name}:", *lines)))
        if i < len(rows):
            initial, must, truncated, role, text = rows[i]
            c, a, lines = best(i + 1, q, 0)
            ways.append((c + 3, "D" + a, lines))
            if not must:
                c, a, lines = best(i + 1, new, 0)
                ways.append((c + 2 + truncated, "R" + a, (f"{name}:{text}", *lines)))
                if q + initial in ("0s", "0u", "su", "ua", "au"):
                    c, a, lines = best(i + 1, initial, 0)
                    ways.append((c + truncated, "K" + a, (f"{role}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    return best(0, "0", 0)


def repaired(table):
    """What op11 must return for (conv_id, turn, role, text) rows, as {conv_id: values}."""
    shown = lambda x: " " if x is None else str(x)
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        kept = groups[conv]
        harm = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        if harm:
            kept += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, faults = set(), [], [0, 0, 0]
        for _, role, text in rows:
            bare = text.strip(SPACE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            marked.append((role[:1], fault in (0, 1), int(fault == 2), role, text))
        turns = {t for t, *_ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, lines = cheapest(tuple(marked)) if marked else (0, "", ())
        out[conv] = (gaps, *faults, illegal, cost, audit, sha("\n".join(lines)))
    return out


def values(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_block_tables_give_the_cheapest_and_least_audit():
    random.seed(7)
    rows = [[random.randrange(9) for _ in range(random.randrange(26))] for _ in range(400)]
    counts = np.array([len(r) for r in rows])
    flat = np.array([s for r in rows for s in r])
    cost, audit = conversations.tables().repair(flat, np.cumsum(counts) - counts, counts)
    for r, c, a in zip(rows, cost.tolist(), audit, strict=True):
        want = cheapest(tuple(("suax"[(s - 1) % 4] if s else "x", s == 0, int(s > 4), "", "") for s in r))
        assert (c, a.decode()) == want[:2]


@pytest.mark.parametrize("sf", [SMALL, MORE])
def test_op11_against_brute_force(spark, sf):
    want = repaired(duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall())
    assert values(queries.op11_conversation_repair(spark, sf)) == want


def test_repair_of_odd_conversations(spark):
    random.seed(3)
    words = [None, "", " \t", "Yes.", "No", "a\n", "Why?  ", "x" * 3_000_000 + "."]
    roles = [None, "", "user", "assistant", "system", "tool", "User"]
    table = [(random.choice([None, 1, 2, 3, 4]), random.choice([None, *range(9)]), random.choice(roles), random.choice(words)) for _ in range(150)]
    table += table[:20] + [(9, t, ("user", "assistant")[t % 2], f"turn {t % 97}.") for t in range(220)]
    df = spark.createDataFrame([(*r, 1, "k") for r in table], "conv_id long, turn long, role string, text string, conv int, kind string")
    assert values(conversations.repair(conversations.damage(df), "conv_id")) == repaired(table)
    assert conversations.repair(conversations.damage(df.limit(0)), "conv_id").isEmpty()
    plain = conversations.repair(conversations.undamaged(df.where("conv_id = 9 AND turn < 4")), "conv_id").first()
    assert (plain.cost, plain.audit) == (0, "KKKK")


def merkle(table):
    """What op13 must return for (doc_id, source, lang, n_chars, text) rows without repeats."""

    def leaf(*fields):
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    def climb(nodes):
        """The root and each node's siblings, level by level, as (left, right)."""
        at, proofs = list(range(len(nodes))), [[] for _ in nodes]
        while len(nodes) > 1:
            for k, p in enumerate(proofs):
                first = at[k] // 8 * 8
                p.append(("".join(nodes[first : at[k]]), "".join(nodes[at[k] + 1 : first + 8])))
            nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
            at = [a // 8 for a in at]
        return nodes[0], proofs

    groups = defaultdict(list)
    for r in table:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        subs[lang] = climb([leaf(*r) for r in groups[lang]])
    root, over = climb([subs[x][0] for x in langs])
    out = []
    for x, up in zip(langs, over, strict=True):
        for r, proof in zip(groups[x], subs[x][1], strict=True):
            proof = proof + up
            digest = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                digest = leaf(*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))
            for left, right in proof:
                digest = sha(left + digest + right)
            out.append((r[0], leaf(*r), subs[x][0], root, sha("".join(a + b for a, b in proof)), digest, digest == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
by_key = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("sf", [SMALL, MORE])
def test_op13_against_brute_force(spark, sf):
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op13_merkle_manifest(spark, sf).collect()]
    assert by_key(got) == by_key(merkle(duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{sf}/documents.parquet'").fetchall()))
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_of_odd_tables(spark, tmp_path):
    """Groups of one leaf, of exact powers of the fan-out and beyond one block; null ids, languages and texts; repeats."""
    rows = [(k, "s", "one", 1, "A text") for k in (5,)] + [(k, None, None, None, None) for k in range(8)] + [(None, "s", "é", 3, f"Null {k}") for k in range(3)]
    rows += [(k, "web", "big", 4, "" if k % 2 else f"Text {k}") for k in range(manifest.BLOCK + 1)] + [(k, "s", f"l{k:02}", 1, "x" * 2_000_000) for k in range(9)] + [(7, "s", "two", 1, "Same")] * 2
    spark.createDataFrame([(*r, "g", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, `group` string, pos int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    assert by_key(got) == by_key(merkle(rows))
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op13_merkle_manifest(spark, f"{tmp_path}/none").isEmpty()


def test_a_proof_folds_to_the_root(spark):
    leaves = spark.range(100).select(F.lit("=a").alias("group"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    proved = manifest.prove(leaves, ["id"])
    assert proved.where(manifest.fold(F.col("digest"), F.col("proof")) != F.col("root")).isEmpty() and proved.count() == 100
