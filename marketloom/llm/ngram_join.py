"""N-gram Jaccard join with signature trees.

A document's set holds its distinct word shingles (A-Z lower-cased; words ``[^\\x20\\x09-\\x0D]+``; with fewer words the
whole sequence; with none nothing, and then it is linked with nothing).  Two documents link if
``100 * intersection >= similarity * union``.  No link is lost: every step that leaves pairs out does so by a bound on
their greatest possible overlap.

1. Documents with one set are one class, so copies cost one row.  The same pass counts all shingles of all texts in
   COUNTERS counters; rare before frequent, then by hash, is the order of shingles from there on.
2. Top of the tree: a node for each shingle, with the classes that have it among their first ``size - least + 1`` ones
   (``least``: the overlap that any link needs).  Two sets with no node in common cannot overlap enough, so only
   pairs inside a node are left: an equi-join.  Members without another of a size near theirs go; nodes with the same
   members are one.
3. Below: the members of a node, by size, under nodes of FANOUT children with the OR of their bitmaps, the range of their
   sizes and the most shingles that share a bit.  A bitmap has two to four bits for each shingle; sets that may link are
   of one width or of adjacent ones, and then the wider is folded.  A dual traversal goes down from (root, root) and drops pairs of nodes
   whose sizes are too far apart, or whose common bits and shared-bit shingles can't make the overlap.
   Large nodes are first cut into runs by size band and hash; the runs' own bitmaps and sizes prune pairs of runs
   before any member is sent to them.
4. Components: classes that have a partner left are linked inside the largest node that still has some of them (on full sets,
   which move once); then only nodes that hold several components are traversed, passing over pairs of one component:
   first the likeliest pair of every two components of a node, then, with the components that this gives, all
   that are left.  They are confirmed on full sets.

``pairs`` gives all links between classes, and their members, instead.

Nulls are texts without words.  An id that stands with several texts is one document for links; every row keeps a row.
Rows with a null id are linked with nothing.  Ties (copies) go to the smallest id.  An empty table gives no rows.  Ids
must be whole numbers (others are refused).  Texts of any length are read whole, and further columns may have any name.
Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut, integer_id, partitions, release, text_column
from .near_dedup import components, shingle_sets

SHINGLE, SIMILARITY = 4, 85
#: Counters of shingles (1 MB in all), and those in one row.
COUNTERS, CHUNK = 1 << 18, 1 << 14
#: Least bits of a signature, children of a node, members of a run, words of bitmaps worked on at once, pairs confirmed at once.
BITS, FANOUT, RUN, FRONT, CONFIRM = 512, 8, 1024, 1 << 19, 256
#: Nodes that a class lists, the smallest ones.
LISTED = 64
#: Ids (16 bytes each) up to which texts are looked up by a broadcast.
BROADCAST_IDS = 500_000


def _set_hash(shingles: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def _classes(shingle: int):
    """Id, size and set hash of every text; behind the last one of a task its counts of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(COUNTERS, np.uint64), ["id", "n_shingles", "node", "chunk", "counts"]
        seen: set[int] = set()
        for batch in batches:
            for i, sets in shingle_sets(batch.column(1), shingle):
                nodes = [_set_hash(s) for s in sets]
                new = [s for s, node in zip(sets, nodes, strict=True) if node is not None and node not in seen]
                seen.update(n for n in nodes if n is not None)
                if new:
                    counts += np.bincount((np.concatenate(new) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint64)
                none = pa.nulls(len(sets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        for k in np.flatnonzero(counts.reshape(-1, CHUNK).any(axis=1)).tolist():
            packed = pa.compress(counts[k * CHUNK : (k + 1) * CHUNK].tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1).cast(pa.int64())] * 3, pa.array([k], pa.int32()), pa.array([packed], pa.binary())], names)

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each chunk of counters; a task holds the sums of its chunks only."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(pa.decompress(packed, decompressed_size=8 * CHUNK, codec="zstd", asbytes=True), np.uint64)
            held[k] = held[k] + part if k in held else part
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pa.compress(v.tobytes(), codec="zstd", asbytes=True) for v in held.values()], pa.binary())], ["chunk", "counts"])


def least_overlap(size: int, similarity: int) -> int:
    """The overlap that a set of this size needs with any set it links with."""
    return -(-similarity * size // 100)


def _postings(shingle: int, similarity: int, counts: np.ndarray):
    """(token, size, node) of the first shingles of every set, rare ones first; a set counts once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), shingle):
                tokens, nodes = [], []
                for s in sets:
                    node = _set_hash(s)
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    first = len(s) - least_overlap(len(s), similarity) + 1
                    order = np.argsort(counts[s & np.uint64(COUNTERS - 1)], kind="stable")[:first]  # s is sorted, so ties go by hash
                    tokens.append(s[order])
                    nodes.append((node, len(s), first))
                if nodes:
                    node, size, first = (np.array(x) for x in zip(*nodes, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(size, first)), pa.array(np.repeat(node, first))], ["token", "size", "node"])

    return run


def _shared(similarity: int):
    """Sorted (token, size, node) rows, once each, of those that have another of their token whose size is near enough to link:
    the next smaller or the next larger."""

    def out(rows: list[np.ndarray], before: tuple[int, int] | None, after: tuple[int, int] | None) -> pa.RecordBatch:
        token, size, node = rows
        near = (token[1:] == token[:-1]) & (100 * size[:-1] >= similarity * size[1:])
        hit = np.zeros(len(token), bool)
        hit[1:] |= near
        hit[:-1] |= near
        if len(token):
            hit[0] |= before is not None and token[0] == before[0] and 100 * before[1] >= similarity * size[0]
            hit[-1] |= after is not None and token[-1] == after[0] and 100 * size[-1] >= similarity * after[1]
        return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in rows], ["token", "size", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [np.zeros(0, np.int64)] * 3, None  # the row before those held
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(rows)]
            new = np.ones(len(rows[0]), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[2][1:] != rows[2][:-1])
            rows = [x[new] for x in rows]
            yield out([x[:-1] for x in rows], last, (rows[0][-1], rows[1][-1]))
            last = (rows[0][-2], rows[1][-2]) if len(rows[0]) > 1 else last
            rows = [x[-1:] for x in rows]
        if len(rows[0]):
            yield out(rows, last, None)

    return run


def _sets(shingle: int, whole: bool, more: list[str]):
    """The bitmap, and the set with its size where ``whole``, of the texts that have the set that is asked for, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            asked = batch.column(1).to_numpy()
            for i, sets in shingle_sets(batch.column(0), shingle):
                hit = []
                for k, s in enumerate(sets):
                    node = int(asked[i + k])
                    if node not in seen and _set_hash(s) == node:
                        seen.add(node)
                        hit.append(k)
                at = pa.array([i + k for k in hit], pa.int64())
                own = [pa.array([signature(sets[k]).tobytes() for k in hit], pa.binary())]
                if whole:
                    own += [pa.array([len(sets[k]) for k in hit], pa.int64()), pa.array([np.sort(sets[k].view(np.int64)) for k in hit], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ["node", *more]], *own], ["node", *more, "bits", *(["size", "shingles"] if whole else [])])

    return run


def signature(shingles: np.ndarray) -> np.ndarray:
    """The bitmap of a set, as 64-bit words: a power of two of bits, at least two for each shingle."""
    bits = max(BITS, 1 << (2 * len(shingles) - 1).bit_length())
    bit = np.unique((shingles.view(np.uint64) >> np.uint64(16)) & np.uint64(bits - 1))
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps with fewer words, a power of two."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


class Tree:
    """Levels of nodes over members sorted by size, the leaves first: OR of the bitmaps, least and greatest size, the most
    shingles beyond one a bit, and the label where all members have one, else -1."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, label: np.ndarray, levels: int | None = None):
        self.order = np.lexsort((label, size))
        size, bits, label = size[self.order], bits[self.order], label[self.order]
        excess = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, size, size, excess, label)]
        self.leaf_labels = label
        while len(self.levels[-1][1]) > 1 or levels and len(self.levels) < levels:
            bits, low, high, excess, label = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            mixed = np.minimum.reduceat(label, at) != np.maximum.reduceat(label, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), np.where(mixed, -1, label[at])))


def possible(a, b, similarity: int) -> np.ndarray:
    """Which pairs of nodes (bitmap, sizes, excess, label of each) may hold a link between two labels."""
    some = (100 * a[2] >= similarity * b[1]) & (100 * b[2] >= similarity * a[1]) & ((a[4] != b[4]) | (a[4] < 0))
    k = np.flatnonzero(some)
    most = np.bitwise_count(a[0][k] & b[0][k]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][k], b[3][k])
    most = np.minimum(most, np.minimum(a[2][k], b[2][k]))
    some[k] = (100 + similarity) * most >= similarity * (a[1][k] + b[1][k])
    return some


def traverse(one: Tree, other: Tree, similarity: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members (row numbers before sorting) that pass all bounds, from a dual traversal; of one tree each pair once."""
    front = max(256, FRONT // one.levels[0][0].shape[1])
    same = one is other
    zero = np.zeros(1, np.int64)
    stack = [(len(one.levels) - 1, zero, zero)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > front:
            stack += [(level, i[k : k + front], j[k : k + front]) for k in range(0, len(i), front)]
            continue
        on = possible([x[i] for x in one.levels[level]], [x[j] for x in other.levels[level]], similarity)
        i, j = i[on], j[on]
        if level == 0:
            if len(i):
                yield one.order[i], other.order[j]
            continue
        if not len(i):
            continue
        child = np.arange(FANOUT)
        i = np.repeat((i[:, None] * FANOUT + child).ravel(), FANOUT)
        j = np.repeat((j[:, None] * FANOUT + child)[:, None, :], FANOUT, axis=1).ravel()
        there = (i < len(one.levels[level - 1][1])) & (j < len(other.levels[level - 1][1]))
        if same:
            there &= i < j if level == 1 else i <= j
        stack.append((level - 1, i[there], j[there]))


def forest(size: np.ndarray, bits: list[bytes], label: np.ndarray, second: np.ndarray | None = None) -> Iterator[tuple[Tree, Tree, np.ndarray, np.ndarray]]:
    """Two trees to traverse, and the rows of their members, for each width of bitmaps and each pair of adjacent widths; with
    ``second``, the members where it is 0 against those where it is 1.  Labels are read when a tree is built."""
    words = np.array([len(b) // 8 for b in bits])
    sides = [np.ones(len(words), bool)] if second is None else [second == 0, second == 1]

    def tree(rows: np.ndarray, w: int, depth: int | None = None) -> Tree:
        return Tree(size[rows], folded(np.frombuffer(b"".join(bits[r] for r in rows.tolist()), np.uint64).reshape(len(rows), -1), w), label[rows], depth)

    for w in np.unique(words).tolist():
        at = [[np.flatnonzero(s & (words == v)) for v in (w, 2 * w)] for s in sides]
        if second is None:
            own, wider = at[0]
            if len(own) > 1:
                t = tree(own, w)
                yield t, t, own, own
            todo = [(own, wider)]
        else:
            todo = [(at[0][0], at[1][0]), (at[0][0], at[1][1]), (at[0][1], at[1][0])]
        for x, y in todo:
            if len(x) and len(y):
                depth = max(len(tree(k, w).levels) for k in (x, y))
                yield tree(x, w, depth), tree(y, w, depth), x, y
    # bitmaps narrower than any on the other side link with nothing there: their sizes are too far apart


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(keys)]
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


def linked(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets link."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < similarity * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= similarity * (len(x) + len(y) - both)


def _link_inside(similarity: int):
    """Links inside each (token, run), confirmed on the sets, none between members that links lead to already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 2):
            node = table["node"].to_numpy()
            if len(node) < 2:
                continue
            column = table["shingles"].combine_chunks()
            at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            label, a, b = np.arange(len(node)), [], []
            for one, other, left, right in forest(table["size"].to_numpy(), table["bits"].to_pylist(), label):
                for i, j in traverse(one, other, similarity):
                    i, j = left[i], right[j]
                    while len(i := i[apart := label[i] != label[j]]):
                        j = j[apart]
                        for x, y in zip(i[:CONFIRM].tolist(), j[:CONFIRM].tolist(), strict=True):
                            if label[x] != label[y] and linked(values[at[x] : at[x + 1]], values[at[y] : at[y + 1]], similarity):
                                label[label == label[y]] = label[x]
                                for tree, rows in ((one, left), (other, right)):  # later pairs of one component are passed over
                                    tree.leaf_labels[:] = label[rows[tree.order]]
                                a.append(node[x])
                                b.append(node[y])
                        i, j = i[CONFIRM:], j[CONFIRM:]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node over each run (token, band, part): a tree's root."""
    for table in _runs(batches, 3):
        size, label = table["size"].to_numpy(), table["label"].to_numpy()
        bits = np.concatenate([folded(np.frombuffer(b, np.uint64)[None, :], BITS // 64) for b in table["bits"].to_pylist()])
        excess = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        whole = int(label[0]) if label.min() == label.max() else -1
        own = table.select(["token", "band", "part"]).slice(0, 1).combine_chunks().to_batches()[0].columns
        out = [np.bitwise_or.reduce(bits, axis=0).tobytes(), int(size.min()), int(size.max()), int(excess.max()), whole]
        yield pa.RecordBatch.from_arrays([*own, *[pa.array([v]) for v in out]], ["token", "band", "part", "bits", "low", "high", "excess", "label"])


def _prune(similarity: int):
    """Pairs of runs that may hold a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = lambda s: [np.frombuffer(b"".join(batch[f"bits_{s}"].to_pylist()), np.uint64).reshape(-1, BITS // 64), *[batch[f"{k}_{s}"].to_numpy() for k in ("low", "high", "excess", "label")]]  # noqa: B023, E731
            if batch.num_rows:
                keep = pa.array(possible(side("a"), side("b"), similarity))
                yield batch.select(["token", "band_a", "part_a", "band_b", "part_b"]).filter(keep)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, Iterator]]:
    """Each block (token and pair of runs), its labels, and its trees."""
    for table in _runs(batches, 5):
        label, second = np.array(table["label"].to_numpy()), table["second"].to_numpy()
        yield table, label, forest(table["size"].to_numpy(), table["bits"].to_pylist(), label, second if second.any() else None)


def _candidates(similarity: int, likeliest: bool):
    """Pairs inside each block that pass all bounds, unless a smaller token that both list has them too; where ``likeliest``, for each
    two labels the pair with the most common bits (in all their bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, label, trees in _blocks(batches):
            node, token, found = table["node"].to_numpy(), table["token"][0].as_py(), []
            before = [frozenset(t for t in tokens if t < token) for tokens in table["tokens"].to_pylist()]
            for one, other, x, y in trees:
                for i, j in traverse(one, other, similarity):
                    here = np.array([before[p].isdisjoint(before[q]) for p, q in zip(x[i].tolist(), y[j].tolist(), strict=True)])
                    i, j = i[here], j[here]
                    if likeliest:
                        p, q = (t.levels[0][0][np.argsort(t.order)[k]] for t, k in ((one, i), (other, j)))
                        like = np.bitwise_count(p & q).sum(axis=1) / np.bitwise_count(p | q).sum(axis=1)
                        found = _best(label, [*found, (x[i], y[j], like)])
                    else:
                        found.append((x[i], y[j], None))
            if found:
                p, q = (node[np.concatenate([f[k] for f in found])] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    return run


def _best(label: np.ndarray, found: list[tuple]) -> list[tuple]:
    """Of pairs (member, member, likeness), the likeliest one of each two labels."""
    i, j, like = (np.concatenate([f[k] for f in found]) for k in range(3))
    a, b = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
    order = np.lexsort((-like, b, a))
    first = np.ones(len(order), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    keep = order[first]
    return [(i[keep], j[keep], like[keep])]


def _open(similarity: int):
    """Members of each block that have any pair that passes all bounds; two members known to have one are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, label, trees in _blocks(batches):
            found = np.zeros(table.num_rows, bool)
            for one, other, x, y in trees:
                for i, j in traverse(one, other, similarity):
                    found[x[i]] = found[y[j]] = True
                    for tree, rows in ((one, x), (other, y)):
                        tree.leaf_labels[found[rows[tree.order]]] = 0
                label[found] = 0
            hit = np.flatnonzero(found)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(table["token"].to_numpy()[hit]), pa.array(table["node"].to_numpy()[hit])], ["token", "node"])

    return run


class _Index:
    """What both outputs share: rows with their classes, the nodes' members, and sets of the classes that stand in any."""

    def __init__(self, docs: DataFrame, id: str, text: str, shingle: int, similarity: int):
        self.spark, self.similarity = docs.sparkSession, similarity
        spark = self.spark
        arrow_batches(spark)
        rows = text_column(docs.select(integer_id(docs, id).alias("id"), F.col(f"`{text}`").alias("text")), "text")
        told = cut(rows.mapInArrow(_classes(shingle), "id long, n_shingles long, node long, chunk int, counts binary"))
        chunks = told.where("chunk IS NOT NULL").select("chunk", "counts").repartition(partitions(spark), "chunk").mapInArrow(_total, "chunk int, counts binary").collect()  # COUNTERS numbers
        counts = np.zeros(COUNTERS, np.uint64)
        for r in chunks:
            counts[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(pa.decompress(r.counts, decompressed_size=8 * CHUNK, codec="zstd", asbytes=True), np.uint64)
        self.signed = told.where("chunk IS NULL").select("id", "n_shingles", "node")
        self.known = self.signed.where("id IS NOT NULL AND node IS NOT NULL")
        postings = rows.where("id IS NOT NULL").select("text").mapInArrow(_postings(shingle, similarity, counts), "token long, size long, node long")
        shared = cut(postings.repartition(partitions(spark), "token").sortWithinPartitions("token", "size", "node").mapInArrow(_shared(similarity), "token long, size long, node long"))
        regions = shared.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(1 << 31))).alias("s"))
        chosen = regions.groupBy("n", "x", "s").agg(F.min("token").alias("token")).select("token", "n")
        self.members = cut(shared.join(chosen, "token"))
        self.classes = cut(self.known.groupBy("node").agg(F.min("id").alias("id")))
        self.rows, self.shingle = rows, shingle
        self.info = cut(self.sets(self.members.select("node").distinct(), whole=False))
        release(spark)

    def sets(self, nodes: DataFrame, whole: bool = True) -> DataFrame:
        """``nodes`` (``node`` and further longs) with bitmaps, and sets and sizes where ``whole``, from a text of the class's smallest
        id.  Of repeated rows each task gives one."""
        more = [c for c in nodes.columns if c != "node"]
        asked = cut(nodes.join(self.classes, "node"))
        found = self.rows.join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, "id").select("text", "node", *more)
        kind = ", ".join(f"{c} long" for c in ["node", *more]) + ", bits binary" + (", size long, shingles array<long>" if whole else "")
        return found.mapInArrow(_sets(self.shingle, whole, more), kind)

    def own_labels(self) -> DataFrame:
        return self.info.select("node", F.expr("greatest(1L, node & 9223372036854775807)").alias("label"))

    def blocks(self, label: DataFrame) -> DataFrame:
        """Members of the nodes that hold several labels, a block for each node or pair of runs that may hold a link."""
        spark, similarity = self.spark, self.similarity
        labelled = self.members.join(label, "node")
        mixed = labelled.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token")
        rows = labelled.join(mixed, "token").join(self.info.dropDuplicates(["node"]), "node")
        band = F.when(F.col("n") > RUN, F.floor(F.log("size") / float(-np.log(similarity / 100)))).otherwise(0).cast("int")
        part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / RUN)).cast("int")
        # a pair is told in the first of the nodes that both list; a list is cut, and pairs with none in common are told in all
        listed = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("token")), 1, LISTED).alias("tokens"))
        rows = cut(rows.join(listed, "node").select("token", "n", band.alias("band"), part.alias("part"), "node", "size", "bits", "label", "tokens"))
        small = rows.where(F.col("n") <= RUN).select("token", *[F.lit(0).alias(c) for c in ("band_a", "part_a", "band_b", "part_b")], F.lit(0).alias("second"), "node", "size", "bits", "label", "tokens")
        large = rows.where(F.col("n") > RUN).drop("n")
        dealt = large.drop("tokens").repartition(partitions(spark), "token", "band", "part").sortWithinPartitions("token", "band", "part")
        heads = cut(dealt.mapInArrow(_heads, "token long, band int, part int, bits binary, low long, high long, excess long, label long"))
        side = lambda s: heads.select("token", *[F.col(c).alias(f"{c}_{s}") for c in heads.columns if c != "token"])
        near = side("b").withColumn("band_a", F.explode(F.array(F.col("band_b"), F.col("band_b") - 1)))  # linked sizes lie in one band or in adjacent ones
        both = side("a").join(near, ["token", "band_a"]).where("band_a < band_b OR part_a <= part_b")
        open_ = cut(both.mapInArrow(_prune(similarity), "token long, band_a int, part_a int, band_b int, part_b int"))
        own = open_.join(large.withColumnsRenamed({"band": "band_a", "part": "part_a"}), ["token", "band_a", "part_a"]).withColumn("second", F.lit(0))
        other = open_.where("band_a <> band_b OR part_a <> part_b").join(large.withColumnsRenamed({"band": "band_b", "part": "part_b"}), ["token", "band_b", "part_b"]).withColumn("second", F.lit(1))
        key = ["token", "band_a", "part_a", "band_b", "part_b"]
        blocks = reduce(DataFrame.unionByName, [small, own, other]).select(*key, "second", "node", "size", "bits", "label", "tokens")
        return blocks.repartition(partitions(spark), *key).sortWithinPartitions(*key)

    def candidates(self, label: DataFrame, likeliest: bool = False) -> DataFrame:
        """``a``, ``b``: pairs of classes of two labels that may link."""
        return self.blocks(label).mapInArrow(_candidates(self.similarity, likeliest), "a long, b long").distinct()

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, by their full sets."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        sets = cut(self.sets(ends).select("node", "shingles")).dropDuplicates(["node"])
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("sum")).where(F.col("shared") * 100 >= self.similarity * (F.col("sum") - F.col("shared"))).select("a", "b", "shared")


def link(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` (the smallest id that links lead to) of each row of ``docs``."""
    index = _Index(docs, id, text, shingle, similarity)
    spark = index.spark
    held = index.known.select("id", "node").distinct()
    several = held.groupBy("id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    same = held.join(several, "id").where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    open_ = cut(index.blocks(index.own_labels()).mapInArrow(_open(similarity), "token long, node long").distinct())
    first = open_.join(open_.groupBy("token").agg(F.count("*").alias("n")), "token").groupBy("node").agg(F.max(F.struct("n", "token")).alias("m")).select("node", "m.n", "m.token")
    run = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (2 * RUN))).alias("run")
    placed = index.sets(first.select("node", "token", run)).select("token", "run", "node", "size", "bits", "shingles")
    inside = placed.repartition(partitions(spark), "token", "run").sortWithinPartitions("token", "run").mapInArrow(_link_inside(similarity), "a long, b long")
    edges = cut(inside.union(same))
    found = components(edges)
    # only classes with a partner left, in the nodes where they have one; labels are not negative, as -1 marks mixed nodes
    index.members = cut(index.members.join(open_, ["token", "node"], "left_semi"))
    tried = None
    for likeliest in (True, False):
        label = index.members.select("node").distinct().join(found, "node", "left").select("node", F.expr("greatest(1L, coalesce(component, node) & 9223372036854775807)").alias("label"))
        more = index.candidates(label, likeliest)
        more = cut(more if tried is None else more.join(tried, ["a", "b"], "left_anti"))
        found = components(cut(found.union(index.confirmed(more).select("a", "b")).toDF("a", "b")))
        tried = more
    placed = cut(index.classes.join(found, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component")))
    smallest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    of_node = placed.join(smallest, "component").select("node", "component_id")
    out = index.signed.join(of_node, "node", "left")
    return out.select(F.col("id").alias(id), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def pairs(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """All links between different sets: (``class_a``, ``class_b``, ``shared``) by the smallest ids of two classes; and the
    membership, (``id``, ``class``).  Documents of one class are linked with each other."""
    index = _Index(docs, id, text, shingle, similarity)
    links = index.confirmed(cut(index.candidates(index.own_labels())))
    name = lambda s: index.classes.select(F.col("node").alias(s), F.col("id").alias(f"class_{s}"))
    named = links.join(name("a"), "a").join(name("b"), "b")
    named = named.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"), "shared")
    members = index.known.join(index.classes.select("node", F.col("id").alias("class")), "node").select(F.col("id").alias(id), "class")
    return named, members
