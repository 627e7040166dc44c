"""Removal of passages that a document with a smaller id already holds.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller id.  That is
the longest-previous-factor test: in the order of all suffixes, a suffix whose previous or next smaller position
(here: document id) has a common prefix of ``length`` bytes or more repeats earlier text.

How it runs: documents are dealt into chunks of a few MB by a hash of their id and text.

1. In each chunk every window of ``length`` bytes gets a key: the least hash of its ``gram``-byte strings.  Equal
   windows have equal keys, and neighbouring windows mostly share one, so a chunk sends one 48-bit value for each
   distinct key (packed, sorted), not one row for each position.  Keys found in one chunk alone go no farther.
2. For keys that two or more chunks hold, each chunk sends the bytes of the runs of windows with that key, once
   for each distinct run.  Where a key's runs meet, ``suffix_order`` sorts all suffixes there by their first ``length``
   bytes and takes the common prefix of neighbours; ``longest_previous`` finds, for each suffix, the nearest one before
   it and the nearest after it in that order that starts in a document with a smaller id, and the longer of the two
   common prefixes.  Where it reaches ``length``, the suffix repeats earlier text.
3. Each chunk takes back its later copies, with those that the same two functions found inside it in step 2, and
   cuts its texts.

The texts are shuffled once, with their other columns, and that shuffle is read three times.  Nothing is collected.  A
task holds the runs of one bucket of keys: a key that every chunk holds brings one run (some 90 bytes) for each chunk.

Nulls are empty texts.  Documents with equal ids do not cut each other, so repeated rows of one id all stay as they
are; of equal texts (ties) the one with the smallest id stays.  A null id neither cuts nor is cut.  An empty table gives
no rows.  Ids must be whole numbers (others are refused).  Further columns may have any name.  A text is one group's row,
so texts of any length that Spark can hold in a row are read whole.  Cutting may split a UTF-8 character: ``kept`` is
binary, and ``cut_texts`` drops broken characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import integer_id, mix, powers, prefix_sums, ragged, slices, span_hashes

LENGTH, GRAM = 50, 16
#: Bytes of text in a chunk, and of text that sends its keys to one bucket.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
#: Windows in one sent run at most.
RUN = 32
#: Bytes of a sent key.
KEY_BYTES = 6
_KEY_MASK = np.uint64((1 << (8 * KEY_BYTES)) - 1)
#: A word of 8 bytes under the k-th of these has k + 1 leading bytes of 0.
_LEADING = np.array([1 << (8 * k) for k in range(7, -1, -1)], np.uint64)


def _window_keys(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and key of each run of windows that share a key; runs stay in their text."""
    n, w = len(raw), length - gram + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, np.zeros(0, np.uint64)
    sums = prefix_sums(raw)
    g = mix((sums[gram:] - sums[:-gram]) * powers(len(sums))[1][: n - gram + 1])
    least, have = g, 1
    while have < w:  # least of w neighbours, by doubling
        step = min(have, w - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    valid = np.zeros(len(least), bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        valid[a : max(a, b - length + 1)] = True
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    new &= valid
    starts = np.flatnonzero(new)
    edges = np.flatnonzero(new | ~valid)
    ends = np.append(edges, len(least))[np.searchsorted(edges, starts) + 1]
    counts = ends - starts
    if len(counts) and counts.max() > RUN:
        reps = (counts + RUN - 1) // RUN
        k = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        whole = np.repeat(counts, reps)
        starts = np.repeat(starts, reps) + k * RUN
        counts = np.minimum(RUN, whole - k * RUN)
    return starts, counts, least[starts] & _KEY_MASK


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return mix(keys) % np.uint64(buckets)


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def suffix_order(raw: np.ndarray, at: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at ``at`` in the order of their first ``length`` bytes (8 or more), and the common prefix
    of each with the one before it, ``length`` at most.  ``h`` are hashes of these first bytes: equal ones are put
    together by them, so that each distinct prefix is compared once."""
    n = len(at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    head = np.ones(n, bool)
    head[1:] = h[order][1:] != h[order][:-1]
    group = np.flatnonzero(head)
    first, size = at[order[group]], np.diff(group, append=n)
    word = np.ndarray((len(raw) - 7,), ">u8", np.ascontiguousarray(raw), strides=(1,))
    # distinct prefixes: eight bytes at a time, and only where all bytes before are equal
    w = word[first].astype(np.uint64)
    rank = np.argsort(w, kind="stable")
    w = w[rank]
    common = np.zeros(len(rank), np.int64)
    common[1:] = ((w[1:] ^ w[:-1])[:, None] < _LEADING).sum(axis=1)
    for o in [*range(8, length - 8, 8), length - 8] if length > 8 else ():
        tie = common >= min(o + (o == length - 8) * (-o % 8), length)
        tie[0] = False
        inside = tie.copy()
        inside[:-1] |= tie[1:]
        open_ = np.flatnonzero(inside)
        if not len(open_):
            break
        w = word[first[rank[open_]] + o].astype(np.uint64)
        turn = np.lexsort((w, np.cumsum(~tie)[open_]))
        rank[open_], w = rank[open_][turn], w[turn]
        again = np.flatnonzero(tie[open_])
        common[open_[again]] = o + ((w[again] ^ w[again - 1])[:, None] < _LEADING).sum(axis=1)
    out = np.full(n, length, np.int64)
    out[np.cumsum(size[rank]) - size[rank]] = np.minimum(common, length)
    return order[ragged(group[rank], size[rank])], out


def longest_previous(order: np.ndarray, common: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, the common prefix with the nearest suffix before it, or the nearest after it, in suffix order that
    starts in a smaller document, whichever is longer (0: neither reaches ``length``).  The nearest smaller is found by
    following links over suffixes that are not smaller, all suffixes at once, so a row of n takes log n rounds."""
    n = len(order)
    best = np.zeros(n, np.int64)
    d = docs[order]
    for back in (False, True):
        if back:  # the next smaller is the previous smaller of the reversed order
            d, common = d[::-1], np.concatenate([[0], common[1:][::-1]])
        link, shared = np.arange(n) - 1, common.copy()
        shared[:1] = 0
        open_ = np.flatnonzero((shared >= length) & (d[link] >= d))
        while len(open_):
            p = link[open_]
            link[open_], shared[open_] = link[p], np.minimum(shared[open_], shared[p])
            open_ = open_[(shared[open_] >= length) & (d[link[open_]] >= d[open_])]
        found = np.where((shared >= length) & (d[link] < d), shared, 0)
        best = np.maximum(best, found[::-1] if back else found)
    out = np.empty(n, np.int64)
    out[order] = best
    return out


class _Chunk:
    """The rows of one chunk in id order (then text order), and its runs of windows; null ids stand apart."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.nulls = table.filter(pc.is_null(table["id"]))
        self.table = table.filter(pc.is_valid(table["id"])).sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.ids = self.table["id"].to_numpy(zero_copy_only=False).astype(np.int64)
        self.texts = self.table["text"].combine_chunks() if self.table.num_rows else pa.array([], pa.string())
        self.length, self.gram = length, gram

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for i, j, raw, off in slices(self.texts):
            yield (i, j, raw, off, *_window_keys(raw, off, self.length, self.gram))

    def keys(self) -> np.ndarray:
        found = [np.unique(keys) for *_, keys in self.parts()]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _send_keys(length: int, gram: int, buckets: int):
    def run(key, table):
        keys = _Chunk(table, length, gram).keys()
        b = _bucket(keys, buckets)
        order = np.argsort(b, kind="stable")
        keys, b = keys[order], b[order]
        cuts = np.flatnonzero(np.diff(b, prepend=b[:1] + 1)) if len(b) else np.zeros(0, int)
        return pa.table({"bucket": pa.array(b[cuts].astype(np.int32)), "chunk": pa.array([key[0].as_py()] * len(cuts), pa.int32()), "keys": pa.array([_packed(x) for x in np.split(keys, cuts[1:])] if len(cuts) else [], pa.binary())})

    return run


def _shared_keys(key, table):
    """For each chunk, its keys that another chunk holds too."""
    chunks = table["chunk"].to_pylist()
    lists = [_unpacked(x) for x in table["keys"].to_pylist()]
    every = np.sort(np.concatenate(lists))
    more = np.unique(every[1:][every[1:] == every[:-1]])
    out = [np.intersect1d(x, more, assume_unique=True) for x in lists]
    some = [k for k, x in enumerate(out) if len(x)]
    return pa.table({"chunk": pa.array([chunks[k] for k in some], pa.int32()), "keys": pa.array([_packed(out[k]) for k in some], pa.binary())})


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among distinct sorted values."""
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _in_two_documents(chunk: _Chunk) -> np.ndarray:
    """Keys that two or more ids of the chunk hold."""
    found = []
    for i, _j, _raw, off, starts, _counts, keys in chunk.parts():
        doc = chunk.ids[i + np.searchsorted(off, starts, side="right") - 1]
        order = np.argsort(keys, kind="stable")  # ids ascend inside a part
        k, d = keys[order], doc[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        found.append((k[new], d[new]))
    if not found:
        return np.zeros(0, np.uint64)
    k, d = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    order = np.argsort(k, kind="stable")
    k, d = k[order], d[order]
    return np.unique(k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])])


def _bits(flags: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One bit for each window of each run (RUN at most)."""
    first = np.cumsum(counts) - counts
    place = (np.arange(len(flags)) - np.repeat(first, counts)).astype(np.uint64)
    return np.bitwise_or.reduceat(flags.astype(np.uint64) << place, first) if len(counts) else np.zeros(0, np.uint64)


_SENT = {"bucket": pa.int32(), "chunk": pa.int32(), "rows": pa.binary(), "pos": pa.binary(), "ids": pa.binary(), "sizes": pa.binary(), "data": pa.binary(), "bits": pa.binary()}


def _send_runs(length: int, gram: int, buckets: int):
    """The runs that other chunks have to see, once for each distinct run of the chunk; and, as ``bits`` for the chunk
    itself, the windows that are later copies inside it."""

    def run(key, left, right):
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        me = key[0].as_py()
        chunk = _Chunk(left, length, gram)
        shared = np.unique(np.concatenate([_unpacked(x) for x in right["keys"].to_pylist()] or [np.zeros(0, np.uint64)]))
        twice = _in_two_documents(chunk)
        rows: list[tuple] = []
        known_h, known_d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for i, _j, raw, off, starts, counts, keys in chunk.parts() if len(shared) or len(twice) else ():
            ask, local = _member(shared, keys), _member(twice, keys)
            pick = np.flatnonzero(ask | local)
            if not len(pick):
                continue
            starts, counts, keys, ask, local = starts[pick], counts[pick], keys[pick], ask[pick], local[pick]
            doc = i + np.searchsorted(off, starts, side="right") - 1
            fresh = np.ones(len(keys), bool)
            if local.any():
                at = ragged(starts[local], counts[local])
                h = span_hashes(prefix_sums(raw), at, at + length)
                own = np.repeat(chunk.ids[doc[local]], counts[local])
                order, common = suffix_order(raw, at, h, length)
                later = longest_previous(order, common, own, length) >= length
                uniq, k = np.unique(h, return_index=True)  # parts and rows come in id order, so the first is the smallest
                least = own[k]
                if len(known_h):  # and earlier parts of the chunk
                    where = np.minimum(np.searchsorted(known_h, h), len(known_h) - 1)
                    later |= (known_h[where] == h) & (known_d[where] < own)
                if i + len(off) - 1 < len(chunk.ids):  # parts follow
                    known_h, k = np.unique(np.concatenate([known_h, uniq]), return_index=True)  # the earlier part's stays
                    known_d = np.concatenate([known_d, least])[k]
                bits = _bits(later, counts[local])
                hit = np.flatnonzero(bits)
                if len(hit):
                    d = doc[local][hit]
                    rows.append((me % buckets, d.astype(np.int32).tobytes(), (starts[local][hit] - off[d - i]).astype(np.int32).tobytes(), b"", b"", b"", bits[hit].astype(np.uint32).tobytes()))
                # a run whose windows are all later copies here has nothing new for others
                fresh[local] = np.bitwise_count(bits).astype(np.int64) < counts[local]
            pick = np.flatnonzero(ask & fresh)
            if not len(pick):
                continue
            b = _bucket(keys[pick], buckets)
            order = np.lexsort((keys[pick], b))
            pick, b = pick[order], b[order]
            size = counts[pick] + length - 1
            data = raw[ragged(starts[pick], size)]
            at = np.concatenate([[0], np.cumsum(size)])
            d = doc[pick]
            for lo, hi in zip(cuts := np.flatnonzero(np.diff(b, prepend=b[:1] + 1)), [*cuts[1:], len(b)], strict=True):
                rows.append((int(b[lo]), d[lo:hi].astype(np.int32).tobytes(), (starts[pick[lo:hi]] - off[d[lo:hi] - i]).astype(np.int32).tobytes(), chunk.ids[d[lo:hi]].tobytes(), size[lo:hi].astype(np.uint8).tobytes(), packer.compress(data[at[lo] : at[hi]].tobytes()), b""))
        columns = list(zip(*[(r[0], me, *r[1:]) for r in rows], strict=True)) or [[] for _ in _SENT]
        return pa.table({k: pa.array(list(v), t) for (k, t), v in zip(_SENT.items(), columns, strict=True)})

    return run


def _later_copies(length: int):
    def run(key, table):
        out = [(r["chunk"], r["rows"], r["pos"], r["bits"]) for r in table.filter(pc.equal(pc.binary_length(table["data"]), 0)).select(["chunk", "rows", "pos", "bits"]).to_pylist()]
        table = table.filter(pc.greater(pc.binary_length(table["data"]), 0))
        if table.num_rows:
            import zstandard

            unpacker = zstandard.ZstdDecompressor()
            cols = {k: table[k].to_pylist() for k in ("chunk", "rows", "pos", "ids", "sizes", "data")}
            cols["data"] = [unpacker.decompress(x) for x in cols["data"]]
            n = [len(x) // 4 for x in cols["rows"]]
            every = lambda name, kind: np.frombuffer(b"".join(cols[name]), kind)
            rows, pos, ids, size = every("rows", np.int32), every("pos", np.int32), every("ids", np.int64), every("sizes", np.uint8).astype(np.int64)
            chunk, raw = np.repeat(np.array(cols["chunk"], np.int32), n), every("data", np.uint8)
            counts = size - length + 1
            at = ragged(np.cumsum(size) - size, counts)
            h = span_hashes(prefix_sums(raw), at, at + length)
            doc = np.repeat(ids, counts)
            later = longest_previous(*suffix_order(raw, at, h, length), doc, length) >= length
            bits = _bits(later, counts)
            hit = np.flatnonzero(bits)
            order = hit[np.argsort(chunk[hit], kind="stable")]
            c = chunk[order]
            for lo, hi in zip(cuts := np.flatnonzero(np.diff(c, prepend=c[:1] - 1)), [*cuts[1:], len(c)], strict=True):
                part = order[lo:hi]
                out.append((int(c[lo]), rows[part].tobytes(), pos[part].tobytes(), bits[part].astype(np.uint32).tobytes()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({k: pa.array(list(v), t) for (k, t), v in zip({"chunk": pa.int32(), "rows": pa.binary(), "pos": pa.binary(), "bits": pa.binary()}.items(), columns, strict=True)})

    return run


def _cut(length: int, gram: int, as_text: bool):
    def run(key, left, right):
        chunk = _Chunk(left, length, gram)
        every = lambda name, kind: np.frombuffer(b"".join(right[name].to_pylist()), kind)
        rows, pos, bits = every("rows", np.int32).astype(np.int64), every("pos", np.int32).astype(np.int64), every("bits", np.uint32).astype(np.uint64)
        order = np.argsort(rows, kind="stable")
        rows, pos, bits = rows[order], pos[order], bits[order]
        out: dict[str, list] = {k: [] for k in ("id", "n_bytes", "kept", "from", "to")}
        shift = np.arange(RUN, dtype=np.uint64)
        for i, _j, raw, off in slices(chunk.texts):
            mark = np.zeros(len(raw) + 1, np.int32)
            lo, hi = np.searchsorted(rows, [i, i + len(off) - 1])
            for a in range(lo, hi, 100_000):
                part = np.s_[a : min(hi, a + 100_000)]
                r, k = np.nonzero((bits[part, None] >> shift) & np.uint64(1))
                starts = off[rows[part][r] - i] + pos[part][r] + k
                np.add.at(mark, starts, 1)
                np.add.at(mark, starts + length, -1)
            gone = np.cumsum(mark[:-1]) > 0
            touched = np.add.reduceat(np.append(gone, False), np.minimum(off[:-1], len(raw))) if len(off) > 1 else []
            for k in range(len(off) - 1):
                a, b = int(off[k]), int(off[k + 1])
                ups = downs = []
                kept = raw[a:b]
                if b > a and touched[k]:
                    g = gone[a:b]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                    ups, downs, kept = edge[::2].tolist(), edge[1::2].tolist(), kept[~g]
                for name, v in zip(out, (int(chunk.ids[i + k]), b - a, kept.tobytes(), ups, downs), strict=True):
                    out[name].append(v)
        if as_text:  # broken characters go
            texts = pa.array([x.decode("utf-8", "ignore") for x in out["kept"]], pa.string())
            done = chunk.table.set_column(chunk.table.schema.get_field_index("text"), "text", texts)
            return pa.concat_tables([done, chunk.nulls.select(done.column_names)]).drop_columns(["chunk", "id"])
        for x in chunk.nulls["text"].to_pylist():
            for name, v in zip(out, (None, len(x.encode()), x.encode(), [], []), strict=True):
                out[name].append(v)
        return pa.table({"id": pa.array(out["id"], pa.int64()), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "kept": pa.array(out["kept"], pa.binary()), "span_from": pa.array(out["from"], pa.list_(pa.int64())), "span_to": pa.array(out["to"], pa.list_(pa.int64()))})

    return run


def _run(docs: DataFrame, id: str, text: str, length: int, gram: int, carried: list[str], schema: StructType) -> DataFrame:
    """The three steps; with ``carried`` columns the result is the cut text and these columns (``text``, ``c0``, ...)."""
    if not 8 <= gram <= length <= gram + 255 - RUN:
        raise ValueError("gram must be 8 or more, length gram or more")
    rows = docs.select(integer_id(docs, id).alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)])
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, -(-total // CHUNK_BYTES)), max(1, -(-total // BUCKET_BYTES))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    keys = dealt.groupBy("chunk").applyInArrow(_send_keys(length, gram, buckets), "bucket int, chunk int, keys binary")
    shared = keys.groupBy("bucket").applyInArrow(_shared_keys, "chunk int, keys binary")
    runs = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_send_runs(length, gram, buckets), "bucket int, chunk int, rows binary, pos binary, ids binary, sizes binary, data binary, bits binary")
    later = runs.groupBy("bucket").applyInArrow(_later_copies(length), "chunk int, rows binary, pos binary, bits binary")
    return dealt.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(_cut(length, gram, bool(carried)), schema)


def cut_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id``, ``n_bytes``, ``kept`` (binary), ``span_from`` and ``span_to`` (the removed byte runs) for each row."""
    schema = StructType([StructField("id", LongType()), StructField("n_bytes", LongType()), StructField("kept", BinaryType()), StructField("span_from", ArrayType(LongType())), StructField("span_to", ArrayType(LongType()))])
    return _run(docs, id, text, length, gram, [], schema).withColumnRenamed("id", id)


def cut_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with every repeat cut from ``text``; a document of which nothing is left stays with an empty text, as
    does one without a text."""
    carried = [c for c in docs.columns if c != text]
    schema = StructType([StructField("text", StringType()), *(StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(carried))])
    out = _run(docs, id, text, length, gram, carried, schema)
    at = {c: F.col(f"c{k}") for k, c in enumerate(carried)} | {text: F.col("text")}
    return out.select([at[c].alias(c) for c in docs.columns])
