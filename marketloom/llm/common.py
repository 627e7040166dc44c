"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: Bytes of text that one vectorised step works on; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names.  Where none is named, a temporary one, in local mode only: on a cluster the
    executors could not see it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, with no lineage behind it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more (a loop leaves many behind)."""
    spark.sparkContext._jvm.System.gc()


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small where texts are long; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def integer_id(df: DataFrame, id: str) -> Column:
    """The id column as a long; ids of another kind than whole numbers are refused before any work."""
    kind = df.schema[id].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"column {id} must hold whole numbers, not {kind.simpleString()}")
    return F.col(f"`{id}`").cast("long")


def text_column(df: DataFrame, text: str) -> DataFrame:
    """``text`` as a string, null as the empty text."""
    return df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 offsets of its values (null: empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind, width = pa.large_binary(), np.int64
    else:
        kind, width = pa.binary(), np.int32
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    array = array.view(kind) if array.offset == 0 else array.cast(kind)
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], width)[array.offset : array.offset + n + 1].astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(array: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: first row, end row, bytes, offsets from 0."""
    raw, off = utf8(array)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array over the bytes of ``data`` with n + 1 byte offsets (under 2 GB)."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


_RANDOM = np.random.default_rng(20240607)
#: One random odd-mixed value for each byte.
BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    while len(_POWERS[0]) < n:
        have = len(_POWERS[0])
        for k, x in enumerate((BASE, _BASE_INVERSE)):
            _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k] * np.uint64(pow(x, have, 2**64))])
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = sum of value(raw[t]) * BASE**t for i <= t < j (modulo 2**64)."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * powers(len(raw))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [start, end), wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def separators(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Words ``[^\x20\x09-\x0D]+``.
SPACES = separators((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word of a slice; no word goes over the end of a text."""
    if not len(raw):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~breaks[raw]
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, inside[:-1]
    before[off[:-1][off[:-1] < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1
