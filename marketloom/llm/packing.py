"""Conflict-constrained best-fit packing of documents into bins of ``capacity`` tokens.

Two documents of one source, or of one duplicate cluster, never share a bin.  Documents go largest first into the
tightest bin that has room and no conflict.  Bins stand in the order of what is left in them; each carries bitmaps of
its sources and clusters, and a run of neighbouring bins carries the bits that all of them have, so the search for
the next larger bin passes over whole runs that conflict and stops at the tightest compatible bin, however far.

Documents are dealt into blocks by a hash of all they carry, and each block is packed on its own: a hot source or
cluster is spread over all blocks.  A document over the capacity is cut into full pieces, which fill bins alone, and
a rest.  Every row is packed; none is dropped.

Null or negative sizes count as 0; empty documents take a place in a bin without room.  A null source or cluster
conflicts with nothing.  Repeated rows are packed as often as they stand.  An empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec
from .common import arrow_batches, cut, slices

CAPACITY = 4096
#: Documents in a block, and bins in a run.
BLOCK_ROWS, RUN = 20_000, 64


class Bins:
    """Open bins in ascending order of what is left, in runs with the bits common to all of their bins."""

    def __init__(self):
        self.runs: list[list[tuple[int, int]]] = []
        self.tops: list[int] = []
        self.common: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _renew(self, r: int) -> None:
        run = self.runs[r]
        if not run:
            del self.runs[r], self.tops[r], self.common[r]
            return
        if len(run) > 2 * RUN:
            self.runs[r : r + 1] = [run[:RUN], run[RUN:]]
            self.tops.insert(r, 0)
            self.common.insert(r, (0, 0))
            self._renew(r + 1)
            run = self.runs[r]
        s = c = -1
        for _, b in run:
            s &= self.sources[b]
            c &= self.clusters[b]
        self.tops[r], self.common[r] = run[-1][0], (s, c)

    def _insert(self, item: tuple[int, int]) -> None:
        r = min(bisect_left(self.tops, item[0]), len(self.runs) - 1)
        if r < 0:
            self.runs.append([item])
            self.tops.append(0)
            self.common.append((0, 0))
            r = 0
        else:
            insort(self.runs[r], item)
        self._renew(r)

    def put(self, size: int, source: int, cluster: int, capacity: int) -> tuple[int, int]:
        """The bin for a document with these bits, and the offset in it."""
        for r in range(bisect_left(self.tops, size), len(self.runs)):
            s, c = self.common[r]
            if s & source or c & cluster:
                continue
            run = self.runs[r]
            for k in range(bisect_left(run, (size, -1)), len(run)):
                left, b = run[k]
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    del run[k]
                    self._renew(r)
                    self.sources[b] |= source
                    self.clusters[b] |= cluster
                    self._insert((left - size, b))
                    return b, capacity - left
        self.sources.append(source)
        self.clusters.append(cluster)
        b = len(self.sources) - 1
        self._insert((capacity - size, b))
        return b, 0


def _bits(values: list) -> list[int]:
    """A bit for each distinct value that stands more than once; others cannot conflict."""
    count: dict = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    at = {v: 1 << k for k, v in enumerate(v for v, n in count.items() if n > 1 and v is not None)}
    return [at.get(v, 0) for v in values]


def _pack(capacity: int):
    def run(key, table):
        block = key[0].as_py()
        table = table.sort_by([("size", "descending"), ("id", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        ids, sizes = table["id"], table["size"].to_numpy()
        source, cluster = _bits(table["source"].to_pylist()), _bits(table["cluster"].to_pylist())
        bins = Bins()
        row, piece, took, where, offset = [], [], [], [], []
        alone = 0
        for k, n in enumerate(sizes.tolist()):
            full = n // capacity if n > capacity else 0
            for p in range(full):
                for out, v in zip((row, piece, took, where, offset), (k, p, capacity, -1 - alone, 0), strict=True):
                    out.append(v)
                alone += 1
            rest = n - full * capacity
            if rest or not full:
                b, at = bins.put(rest, source[k], cluster[k], capacity)
                for out, v in zip((row, piece, took, where, offset), (k, full, rest, b, at), strict=True):
                    out.append(v)
        w = np.array(where, np.int64)
        w[w < 0] = len(bins.sources) - 1 - w[w < 0]  # full bins after the shared ones
        return pa.table({"id": ids.take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int64()), "n_tokens": pa.array(took, pa.int64()), "bin_id": pa.array([f"{block}-{b}" for b in w.tolist()], pa.string()), "bin_offset": pa.array(offset, pa.int64())})

    return run


def pack(sized: DataFrame, id: str = "doc_id", size: str = "n_tokens", source: str = "source", cluster: str = "cluster", capacity: int = CAPACITY) -> DataFrame:
    """``id``, ``piece``, ``n_tokens``, ``bin_id`` and ``bin_offset`` of every document or piece of one."""
    kind = sized.schema[id].dataType.simpleString()
    rows = sized.select(F.col(id).alias("id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"))
    rows = cut(rows)  # sizes are costly: counted and packed from one writing
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "size", "source", "cluster"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(_pack(capacity), f"id {kind}, piece long, n_tokens long, bin_id string, bin_offset long").withColumnRenamed("id", id)


def sized(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", source: str = "source", linked: bool = False) -> DataFrame:
    """``id``, ``n_tokens``, ``source`` and ``cluster`` (SHA-256 of the text lower-cased and with white space collapsed) of
    each row; nothing is shuffled.  ``linked`` leaves the cluster null where ``with_components`` puts the component."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        codec = Codec.of(tokenizer)
        for batch in batches:
            for i, j, raw, off in slices(batch.column(2)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec.count_slice(raw, off), pa.int64()), part.column(1), part.column(3)], [id, "n_tokens", "source", "cluster"])

    text_ = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).alias(id), F.col(source).cast("string").alias("source"), text_.alias("text"))
    cluster = F.sha2(F.regexp_replace(F.trim(F.lower("text")), "\\s+", " "), 256)
    if linked:
        cluster = F.when(F.col(id).isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), cluster)
    rows = rows.withColumn("cluster", cluster)
    return rows.mapInArrow(run, f"`{id}` {kind}, n_tokens long, source string, cluster string")


def with_components(sized: DataFrame, linked: DataFrame, id: str = "doc_id") -> DataFrame:
    """``sized`` with the near-copy component (of ``near_dedup.link``) as the cluster.  Texts without words and null ids,
    which are linked with nothing, keep the cluster of their folded text."""
    near = linked.where(F.col(id).isNotNull() & (F.col("n_shingles") > 0)).groupBy(id).agg(F.min("component_id").alias("component"))
    return sized.join(near, id, "left").withColumn("cluster", F.coalesce(F.concat(F.lit("near-"), "component"), "cluster")).drop("component")
