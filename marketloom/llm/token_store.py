"""Token ids on disk, with random access to short documents.

Layout under one folder, written and read by Spark on any file system that it knows:

* ``blocks`` (Parquet, not compressed again): ``part``, ``seq``, ``start`` (ids in the part before the block),
  ``first_id``, ``last_id``, ``n_tokens``, ``width`` (bytes of an id), ``dict_hash``, ``doc_ids``, ``counts``,
  ``offsets`` (the offset index: byte offset of each document and the end), ``payload``.
* ``dictionary`` (Parquet): the shared zstandard dictionary and its SHA-256.

Each document is compressed on its own with the shared dictionary, so one document is read without its
neighbours.  Documents are in ascending id order (null first; equal ids in text order), each closed by ``end_id``.
Null and empty texts hold the end id alone.  Repeated rows are written as often as they stand.  An empty table
gives an empty store.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Codec
from .common import arrow_batches, partitions, slices, text_column

BLOCK = "part int, seq int, start long, first_id long, last_id long, n_tokens long, width int, dict_hash string, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary"
#: Rows that the dictionary is trained on at most, ids in a window of a row, windows of a row; the dictionary's size.
SAMPLE_ROWS, SAMPLE_IDS, SAMPLE_WINDOWS, DICTIONARY_BYTES = 1000, 512, 4, 65_536
#: A block is closed at so many documents or payload bytes.
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20


def _narrow(ids: np.ndarray, end_id: int) -> tuple[np.ndarray, int]:
    a = np.append(ids, np.uint32(end_id))
    width = 2 if a.max() < 65_536 else 4
    return a.astype("<u2" if width == 2 else "<u4"), width


def train_dictionary(docs: DataFrame, tokenizer: str, id: str, text: str, end_id: int) -> bytes:
    """A dictionary from at most SAMPLE_ROWS rows, those of the whole table with the smallest hash of their text, and
    from windows of SAMPLE_IDS ids spread evenly over each; empty where the sample is too small to train one."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer)
        for batch in batches:
            out = []
            for _, _, raw, off in slices(batch.column(0)):
                ids, at = codec.encode_slice(raw, off)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = _narrow(ids[a:b], end_id)[0]
                    step = max(SAMPLE_IDS, len(own) // SAMPLE_WINDOWS)
                    out += [own[k : k + SAMPLE_IDS].tobytes() for k in range(0, len(own), step)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["s"])

    rows = text_column(docs.select(F.col(text).alias("text")), "text")
    picked = rows.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(SAMPLE_ROWS)  # hashes alone are sorted
    rows = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), "h").dropDuplicates(["h"]).select("text").mapInArrow(run, "s binary").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(bytes(r.s) for r in rows)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def write(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Encode every text and write the store."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = text_column(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), "text")
    dictionary = train_dictionary(docs, tokenizer, id, text, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, (packer, _) = Codec.of(tokenizer), _compressor(dictionary)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        names = [f.split()[0] for f in BLOCK.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.binary()]
        block: list[tuple[int, np.ndarray, int]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal block, seq, start, size
            width = max(w for _, _, w in block)
            frames = [packer.compress(a.astype(f"<u{width}").tobytes()) for _, a, _ in block]
            ids, counts = [i for i, _, _ in block], [len(a) for _, a, _ in block]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            row = [part, seq, start, ids[0], ids[-1], sum(counts), width, digest, ids, counts, offsets, b"".join(frames)]
            start, seq, block, size = start + sum(counts), seq + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, j, raw, off in slices(batch.column(1)):
                ids, at = codec.encode_slice(raw, off)
                for k in range(i, j):
                    a, b = int(at[k - i]), int(at[k - i + 1])
                    block.append((doc_ids[k], *_narrow(ids[a:b], end_id)))
                    size += 4 * (b - a)
                    if len(block) >= BLOCK_DOCS or size >= 4 * BLOCK_BYTES:
                        yield close()
        if block:
            yield close()

    ordered = rows.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(run, BLOCK).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")


def read(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian unsigned
    32-bit) of every stored document, or of the given ones, whose blocks alone are then read."""
    digest, dictionary = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(dictionary)
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the dictionary's hash differs from its bytes")
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row for each written partition: their running sum is small whatever the data's size
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    wanted = set(ids) if ids is not None else None
    if wanted is not None:
        near = F.lit(False)
        for i in sorted(wanted):
            near = near | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
        blocks = blocks.where(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpacker = _compressor(dictionary)
        for batch in batches:
            for r in batch.to_pylist():
                if r["dict_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                at, out = r["base"] + r["start"], ([], [], [], [])
                for k, doc in enumerate(r["doc_ids"]):
                    if wanted is None or doc in wanted:
                        a = np.frombuffer(unpacker.decompress(r["payload"][r["offsets"][k] : r["offsets"][k + 1]]), f"<u{r['width']}").astype("<u4")
                        for column, v in zip(out, (doc, at, len(a), a.tobytes()), strict=True):
                            column.append(v)
                    at += r["counts"][k]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(base, "part").select("base", "start", "dict_hash", "doc_ids", "counts", "offsets", "width", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
