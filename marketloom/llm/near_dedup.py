"""MinHash near-dedup with an LSH forest.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; words ``[^\\x20\\x09-\\x0D]+``; with fewer
words the whole sequence; with none nothing, and then it is linked with nothing).  Two documents are linked if
``100 * intersection >= similarity * union``; the component of a document is the smallest id that links lead to.

1. Documents with one set are one class (a group-by of the set's 64-bit hash), so thousands of copies cost one row.
2. The forest: 21 orders of the classes, each by another rotation of a 64-value MinHash signature.  A region is a
   run of an order with a common prefix of 3 values; regions of one class are dropped before signatures move.
3. Longest-common-prefix neighbours: in each sorted order, the common prefixes of adjacent classes give that of any two
   (the least between them); a class looks at its neighbours by longest common prefix, at most REACH on each side, so the
   depth at which it stops is its region's own: the region's prefix where few share it, deeper where many do.  The
   likeliest partners over all orders are confirmed on the full sets.
4. Closure, so that no link is lost in dense regions: with the components so far, every class outside the largest
   component of its region is compared there with all classes of other components, in a grid of blocks; what the
   estimate does not rule out is confirmed on the full sets (in large regions inside the block, until one link for
   each pair of components is found).

A pair of similarity 0.75 meets in no region with probability (1 - 0.75**3)**21 = 1e-5, and is ruled out by the
estimate (below 0.55, 3.7 standard deviations off) with probability 1e-4; both fall fast with similarity.
Components come from alternating large-star and small-star steps over edges, written out at each step.

Nulls are texts without words.  An id that stands with several texts is one document for links (its sets are tied to
each other); every row keeps a row.  Rows with a null id are linked with nothing.  Ties (copies) go to the smallest id.
An empty table gives no rows.  Ids must be whole numbers (others are refused).  Texts of any length are read whole, and
further columns may have any name.  Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import LOWER, arrow_batches, cut, integer_id, mix, partitions, prefix_sums, release, slices, span_hashes, text_column, words

SHINGLE, SIMILARITY = 5, 75
VALUES, ORDERS, DEPTH = 64, 21, 3
#: Neighbours looked at on each side, partners confirmed in the first pass, rows of a closure block.
REACH, PARTNERS, BLOCK = 24, 2, 1024
#: Regions up to this size send their pairs out; larger ones confirm them where they stand.
SMALL = 32
#: Ids (16 bytes each) up to which texts are looked up by a broadcast.
BROADCAST_IDS = 500_000
#: Equal signature values below which a pair is ruled out.
LEAST_EQUAL = 35
_R = np.random.default_rng(5)
_MULTIPLY = _R.integers(1, 2**62, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _R.integers(0, 2**63, VALUES, dtype=np.uint64)
_PLACE = _R.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(array: pa.Array, n: int = SHINGLE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each slice of a text array: its first row, and the sorted distinct shingle hashes of each text."""
    for i, j, raw, off in slices(array):
        raw = LOWER[raw]
        starts, ends, doc = words(raw, off)
        h = span_hashes(prefix_sums(raw), starts, ends)
        count = np.bincount(doc, minlength=j - i)
        grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            grams += h[k : k + len(grams)] * _PLACE[k]
        grams = mix(grams)
        first = np.cumsum(count) - count
        out = []
        for a, c in zip(first.tolist(), count.tolist(), strict=True):
            if c >= n:
                s = np.sort(grams[a : a + c - n + 1])  # np.unique goes by a hash table, which takes longer
                new = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=new[1:])
                out.append(s[new])
            elif c:
                out.append(mix((h[a : a + c] * _PLACE[:c]).sum(dtype=np.uint64, keepdims=True) + _PLACE[n + c]))
            else:
                out.append(np.zeros(0, np.uint64))
        yield i, out


def _node(shingles: np.ndarray) -> int | None:
    """The hash that stands for a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, sets in shingle_sets(batch.column(1)):
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            sig = np.zeros((len(sets), VALUES), ">u4")
            if len(some):
                every = np.concatenate(sets)
                at = (np.cumsum(sizes) - sizes)[some]
                h = np.empty_like(every)
                for k in range(VALUES):
                    np.multiply(every, _MULTIPLY[k], out=h)
                    h += _ADD[k]
                    sig[some, k] = np.minimum.reduceat(h, at) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), pa.array(sizes, pa.int64()), pa.array(map(_node, sets), pa.int64()), pa.array([r.tobytes() if n else None for r, n in zip(sig, sizes, strict=True)], pa.binary())], ["id", "n_shingles", "node", "sig"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, node) of every class and order."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").astype(np.uint64).reshape(-1, VALUES)
        for t in range(ORDERS):
            key = np.full(len(sig), t + 1, np.uint64)
            for k in range(DEPTH):
                key = mix(key * np.uint64(0x100000001B3) + sig[:, t * DEPTH + k])
            key = (key & ~np.uint64(31)) | np.uint64(t)  # the order is the low five bits
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["region", "node"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            now = tuple(c[a] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, VALUES)


def adjacent_prefixes(turned: np.ndarray) -> np.ndarray:
    """How many leading values each row of a sorted matrix has in common with the row before it (the first: 0)."""
    differ = np.ones((len(turned), turned.shape[1] + 1), bool)  # past the last value rows always differ
    differ[1:, :-1] = turned[1:] != turned[:-1]
    out = differ.argmax(axis=1)
    out[:1] = 0
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class's neighbour with the longest common prefix in a sorted order (of equal ones the likeliest), among REACH
    on each side in its region."""
    tail = None
    for batch in batches:
        region = batch.column(0).to_numpy()
        nodes, sig = batch.column(1).to_numpy(), _matrix(batch.column(2))
        if tail is not None:
            region, nodes, sig = np.concatenate([tail[0], region]), np.concatenate([tail[1], nodes]), np.concatenate([tail[2], sig])
        n = len(nodes)
        prefix = adjacent_prefixes(sig)
        prefix[1:][region[1:] != region[:-1]] = 0
        best, likely, who = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        run = prefix[1:]
        for s in range(1, min(REACH, n - 1) + 1):  # run[k]: common prefix of rows k and k + s
            if s > 1:
                run = np.minimum(run[:-1], prefix[s:])
            k = np.flatnonzero(run >= DEPTH)
            if not len(k):
                break
            equal = (sig[k + s] == sig[k]).sum(axis=1)
            for x, y in ((k, k + s), (k + s, k)):
                more = (equal >= LEAST_EQUAL) & ((run[k] > best[x]) | (run[k] == best[x]) & (equal > likely[x]))
                x, y = x[more], y[more]
                best[x], likely[x], who[x] = run[k[more]], equal[more], nodes[y]
        hit = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(who[hit]), pa.array(likely[hit])], ["a", "b", "equal"])
        tail = (region[-REACH:], nodes[-REACH:], sig[-REACH:])


def _candidates(table: pa.Table):
    """The rows of one block of a region, and for each guest those that may be linked with it: of another component,
    not ruled out by the estimate, and met in no earlier order, so that a pair is looked at once over all orders."""
    sig, ids, comp = _matrix(table["sig"]), table["node"].to_numpy(), table["component"].to_numpy()
    is_guest = table["guest"].to_numpy(zero_copy_only=False)
    guests, own = np.flatnonzero(is_guest), np.flatnonzero(~is_guest)
    order = int(table["region"][0].as_py()) & 31
    for g in guests.tolist():
        other = own[comp[own] != comp[g]]
        equal = sig[other] == sig[g]
        first = equal[:, : ORDERS * DEPTH].reshape(-1, ORDERS, DEPTH).all(axis=2).argmax(axis=1)
        total = equal.sum(axis=1)
        hit = (total >= LEAST_EQUAL) & (first == order)
        yield g, other[hit][np.argsort(-total[hit], kind="stable")], ids, comp


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of small regions: at most SMALL - 1 for a class and region."""
    for table in _groups(batches, ["region", "own_part", "guest_part"]):
        a, b = [], []
        for g, hit, ids, _ in _candidates(table):
            a.append(np.minimum(ids[hit], ids[g]))
            b.append(np.maximum(ids[hit], ids[g]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _confirm_across(similarity: int):
    """Links of large regions, confirmed on the sets where the block stands: one for each pair of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["region", "own_part", "guest_part"]):
            column = table["shingles"].combine_chunks()
            at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while x in root:
                    x = root[x]
                return x

            a, b = [], []
            for g, hit, ids, comp in _candidates(table):
                mine = values[at[g] : at[g + 1]]
                for k in hit.tolist():
                    x, y = find(int(comp[g])), find(int(comp[k]))
                    if x == y:
                        continue
                    theirs = values[at[k] : at[k + 1]]
                    if 100 * min(len(mine), len(theirs)) < similarity * max(len(mine), len(theirs)):
                        continue
                    place = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
                    both = int((theirs[place] == mine).sum())
                    if 100 * both >= similarity * (len(mine) + len(theirs) - both):
                        root[max(x, y)] = min(x, y)
                        a.append(ids[g])
                        b.append(ids[k])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sets in shingle_sets(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest connected node) from ``a``, ``b``; nodes without edges are left out."""
    new = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        now = cut(new)
        release(edges.sparkSession)
        # in a forest of stars no node has two centres, and no centre has one
        nodes = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("centres"), F.lit(0).alias("leaves")), F.struct(F.col("v").alias("node"), F.lit(0).alias("centres"), F.lit(1).alias("leaves")))).alias("e")).select("e.*")
        if nodes.groupBy("node").agg(F.sum("centres").alias("centres"), F.sum("leaves").alias("leaves")).where("centres > 1 OR centres = 1 AND leaves > 0").isEmpty():
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def link(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` and ``kept`` (``id`` is the component's) for each row of ``docs``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = text_column(docs.select(integer_id(docs, id).alias("id"), F.col(text).alias("text")), "text")
    signed = cut(rows.mapInArrow(_signatures, "id long, n_shingles long, node long, sig binary"))
    known = signed.where("id IS NOT NULL AND node IS NOT NULL")
    classes = cut(known.groupBy("node").agg(F.min("id").alias("id"), F.first("sig").alias("sig")))
    # the classes of one id are tied
    held = known.select("id", "node").distinct()
    several = held.groupBy("id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    same = cut(held.join(several, "id").where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    reps = classes.select("node", "sig")
    regions = reps.mapInArrow(_regions, "region long, node long")
    crowded = regions.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(regions.join(crowded, "region").select("region", "node", "size"))
    placed = members.join(reps, "node")
    turned = placed.select("region", "node", F.expr(f"concat(substring(sig, cast((region & 31) * {DEPTH * 4} + 1 as int)), substring(sig, 1, cast((region & 31) * {DEPTH * 4} as int)))").alias("turn"))
    near = turned.repartitionByRange(partitions(spark), "region", "turn").sortWithinPartitions("region", "turn").mapInArrow(_neighbours, "a long, b long, equal long")
    top = near.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct("equal", "b")), asc=False), 1, PARTNERS).alias("top"))  # one of each order at most
    pairs = top.select("a", F.explode("top.b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    def sets_of(nodes: DataFrame) -> DataFrame:
        """The shingles of each node, from a text of the class's smallest id."""
        nodes = cut(nodes.distinct().join(classes.select("node", "id"), "node"))
        few = nodes.count() <= BROADCAST_IDS  # else both sides are shuffled, whole texts among them
        ids = nodes.select("id").distinct()
        found = rows.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("text").mapInArrow(_sets, "node long, shingles array<long>").where("node IS NOT NULL")
        return cut(found.dropDuplicates(["node"]))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.withColumn("shared", shared).where(F.col("shared") * 100 >= similarity * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b")

    pairs = cut(pairs)
    release(spark)
    edges = cut(confirmed(pairs, sets_of(ends(pairs))).union(same))
    found = components(edges)
    label = cut(members.join(found, "node", "left").select("region", "node", "size", F.coalesce("component", "node").alias("component")))
    share = label.groupBy("region", "component").agg(F.count("*").alias("n"))
    mixed = share.groupBy("region").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), (F.sum("n") - F.max("n")).alias("guests"), F.count("*").alias("k")).where("k > 1").select("region", "largest", "guests")
    # a grid of blocks: own rows by guests, BLOCK of each at most
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    part = lambda n: F.pmod(F.xxhash64("node"), parts(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    open_ = label.join(mixed, "region")
    own = open_.select("region", part("size").alias("own_part"), every("guests").alias("guest_part"), "node", "component", "size", F.lit(False).alias("guest"))
    guests = open_.where("component <> largest").select("region", every("size").alias("own_part"), part("guests").alias("guest_part"), "node", "component", "size", F.lit(True).alias("guest"))
    grid = own.unionByName(guests)

    def blocks(some: DataFrame) -> DataFrame:
        return some.repartition(partitions(spark), "region", "own_part", "guest_part").sortWithinPartitions("region", "own_part", "guest_part")

    more = blocks(grid.where(F.col("size") <= SMALL).join(reps, "node").drop("size")).mapInArrow(_across, "a long, b long").distinct()
    more = cut(more)
    large = cut(grid.where(F.col("size") > SMALL).drop("size"))
    sets = sets_of(large.select("node").union(ends(more)))
    direct = blocks(large.join(reps, "node").join(sets, "node")).mapInArrow(_confirm_across(similarity), "a long, b long")
    links = cut(found.union(confirmed(more, sets)).union(direct).toDF("a", "b"))
    release(spark)
    found = components(links)
    placed = cut(classes.join(found, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component")))
    smallest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    of_node = placed.join(smallest, "component").select("node", "component_id")
    out = signed.join(of_node, "node", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id)


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` without the rows whose component holds a smaller id.  Of rows with one id, one stays, that with the least
    text (and the least hash of its other columns); rows with a null id all stay."""
    gone = link(docs, id, text, similarity).where("not kept").select(F.col(id).alias("gone")).distinct()
    own = F.col(f"`{id}`")
    left = docs.join(gone, own.cast("long") == F.col("gone"), "left_anti")
    twice = cut(docs.where(own.isNotNull()).groupBy(own.alias("twice")).count().where("count > 1").select("twice"))
    if twice.isEmpty():
        return left
    repeated = left.join(twice, own == F.col("twice"), "left_semi")
    names = [f"`{c}`" for c in docs.columns]
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name != text and not isinstance(f.dataType, MapType)]
    one = repeated.groupBy(own.alias("twice")).agg(F.min_by(F.struct(*names), F.struct(F.col(f"`{text}`"), F.xxhash64(*others))).alias("row"))
    return left.join(twice, own == F.col("twice"), "left_anti").unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
