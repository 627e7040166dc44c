"""BPE encoding and decoding.

``encode`` gives the ids that the tokenizers library gives for the whole text, ``decode`` the text of ids.

* A text is first cut at spaces and single line ends between two visible characters, and between an ASCII letter and
  a mark.  The byte-level pre-tokenizer always starts a piece there, so the cut parts ("units") encode on their own.
  Each task keeps the ids of units it has met in a table of bounded size, looked up for a whole slice of texts at
  once; units are compared by all of their bytes.  A full table is kept as it is, so frequent units stay known, and
  begun anew only after RENEW times as many units were encoded beside it.
* A text of over ``split_chars`` characters is dealt out as pieces of that size, cut anywhere, to many
  tasks.  The ids of neighbouring pieces are then joined as a tree: a window around each join is encoded
  anew and grows until it agrees with both sides at a word start on its left and on its right.

Nulls are empty texts.  Empty texts have no ids.  Repeated rows each keep a row, equal texts (ties) get equal ids, and
an empty table gives no rows.  Ids may be of any type.  Only the named columns are read, so further columns may have
any name.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, binary_array, mix, partitions, ragged, slices, text_column, utf8

#: Units that a task keeps, and how many times as many are encoded beside a full table before it is begun anew; the longest unit in the exact 24-byte table, and in the table of longer ones.
MEMO_UNITS, RENEW, TABLE_BYTES, LONG_BYTES = 1 << 20, 4, 24, 96
_SLOTS = 1 << 22
#: Characters at a cut that may belong to a special token or a contraction split by it.
MARGIN = 32

_CODECS: dict[str, Codec] = {}
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LETTER, _MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _PLAIN[0x21:0x7F] = True
_MARK[list(b",.;:!?")] = True


def _visible(raw: np.ndarray) -> np.ndarray:
    """Which bytes are of characters that are surely no white space."""
    visible = _PLAIN[raw]
    high = raw >= 0x80
    if high.any():
        visible |= high
        for lead, second, size in ((0xC2, (0x85, 0xA0), 2), (0xE1, (0x9A,), 3), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
            at = np.flatnonzero(raw[:-1] == lead)
            for p in range(size) if len(at) else ():  # these may be white space
                visible[at[np.isin(raw[at + 1], second)] + p] = False
    return visible


def units(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the units of a slice of texts: each text's start, each space and each line end between two visible
    characters (and what follows the line end), and each mark after an ASCII letter."""
    n = len(raw)
    visible = _visible(raw)
    first = np.zeros(n + 1, bool)
    first[off] = True
    inner = ~first[:n]
    between = np.zeros(n, bool)  # a visible character of the same text on either side
    between[1:-1] = visible[:-2] & visible[2:] & inner[1:-1] & inner[2:]
    start = ~inner
    start |= between & ((raw == 0x20) | (raw == 0x0A))
    start[1:] |= between[:-1] & (raw[:-1] == 0x0A)
    start[1:] |= _MARK[raw[1:]] & _LETTER[raw[:-1]]
    return np.flatnonzero(start)


class _Ids:
    """A growing array."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, more) -> None:
        n = self.n + len(more)
        if n > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(n, 2 * len(self.data)) - self.n, self.data.dtype)])
        self.data[self.n : n] = more
        self.n = n


class Codec:
    """The tokenizer of one vocabulary file, with a bounded table of units.  One per Python worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        table = {c: b for b, c in byte_letters().items()}
        self.tokens = {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        size = max(self.tokens) + 1
        self.token_size = np.array([len(self.tokens.get(i, b"")) for i in range(size)] + [0], np.int64)  # the last: outside
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self._forget()

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in _CODECS:
            _CODECS[path] = cls(path)
        return _CODECS[path]

    def _forget(self) -> None:
        self.slot = np.full(_SLOTS, -1, np.int32)
        self.key = [_Ids(np.uint64) for _ in range(3)]
        self.size, self.at, self.count, self.ids = _Ids(np.int32), _Ids(np.int64), _Ids(np.int64), _Ids(np.uint32)
        self.long: dict[bytes, int] = {}
        self.full: tuple[int, int] | None = None  # units and ids of a full table
        self.beside = 0

    def _bound(self) -> None:
        """Take back what the last slice encoded beside a full table; after many such units forget all."""
        if self.full:
            self.beside += self.size.n - self.full[0]
            if self.beside > RENEW * MEMO_UNITS:
                self._forget()
                return
            for kept in (*self.key, self.size, self.at, self.count):
                kept.n = self.full[0]
            self.ids.n = self.full[1]
        elif self.size.n > MEMO_UNITS or self.ids.n > 16 * MEMO_UNITS:
            self.full = self.size.n, self.ids.n

    def _alone(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after the other, and how many each has."""
        coded = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        counts = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(counts.sum())), counts

    def _together(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``_alone``, for units with a visible end that begin with a space before a visible character (``gap`` 0) or with a
        visible character (``gap`` 1: a line end goes behind each): put one after the other they are a text whose units they
        are, so one call encodes all.  None if a token goes over a unit's end after all."""
        ends = np.cumsum(size + gap) - gap
        text = np.full(int(ends[-1]) + gap, 0x0A, np.uint8)
        text[ragged(ends - size, size)] = raw[ragged(starts, size)]
        ids = np.array(self.tokenizer.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
        at = np.cumsum(self.token_size[ids])
        last = np.searchsorted(at, ends)
        if len(at) == 0 or at[-1] != len(text) or (at[last] != ends).any() or (at[last + gap] != ends + gap).any():
            return None
        return np.delete(ids, last + 1) if gap else ids, np.diff(last, prepend=-1 - gap) - gap

    def _add_units(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """Encode units that stand in ``raw`` and keep their ids; their entry numbers."""
        ends = starts + size
        visible = _visible(raw)
        spaced = (size > 1) & (raw[starts] == 0x20) & visible[np.minimum(starts + 1, len(raw) - 1)]
        out, left = np.empty(len(starts), np.int64), np.ones(len(starts), bool)
        for gap, begins in enumerate((spaced, visible[starts])):
            k = np.flatnonzero(begins & visible[ends - 1])
            coded = self._together(raw, starts[k], size[k], gap) if len(k) else None
            if coded:
                out[k] = self._keep(*coded, [x[k] for x in keys], size[k])
                left[k] = False
        rest = np.flatnonzero(left)
        if len(rest):
            data = raw.tobytes()
            out[rest] = self._add([data[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)], [k[rest] for k in keys], size[rest])
        return out

    def _add(self, texts: list[bytes], keys: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """Encode units and keep their ids; their entry numbers."""
        return self._keep(*self._alone(texts), keys, sizes)

    def _keep(self, ids: np.ndarray, counts: np.ndarray, keys: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        first = self.size.n
        self.at.extend(self.ids.n + np.cumsum(counts) - counts)
        self.count.extend(counts)
        self.ids.extend(ids)
        for have, more in zip(self.key, keys, strict=True):
            have.extend(more)
        self.size.extend(sizes)
        return np.arange(first, self.size.n)

    def entries(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each unit of a slice, and the first unit of each text and the end."""
        self._bound()
        starts = units(raw, off) if len(raw) else np.zeros(0, np.int64)
        distinct = binary_array(raw, np.append(starts, len(raw))).dictionary_encode()
        which, first = distinct.indices.to_numpy(), np.searchsorted(starts, off)
        raw, bounds = utf8(distinct.dictionary)
        starts, size = bounds[:-1], np.diff(bounds)
        padded = np.concatenate([raw, np.zeros(TABLE_BYTES + 8, np.uint8)])
        word = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        keys = [word[starts + 8 * k] & _LOW_BYTES[np.clip(size - 8 * k, 0, 8)] for k in range(3)]
        h = mix(keys[0] + mix(keys[1] + mix(keys[2] + size.astype(np.uint64))))
        slots = [((h >> np.uint64(k)) & np.uint64(_SLOTS - 1)).astype(np.int64) for k in (0, 32)]
        entry, hit = np.full(len(size), -1, np.int64), np.zeros(len(size), bool)
        for slot in slots:
            at = self.slot[slot].astype(np.int64)
            same = (at >= 0) & (size <= TABLE_BYTES) & (self.size.data[at] == size)
            for have, k in zip(self.key, keys, strict=True):
                same &= have.data[at] == k
            entry[same] = at[same]
            hit |= same
        new = np.flatnonzero(~hit & (size <= TABLE_BYTES))
        if len(new):
            got = entry[new] = self._add_units(raw, starts[new], size[new], [k[new] for k in keys])
            if not self.full:
                free = self.slot[slots[0][new]] < 0  # else the unit goes to its other slot
                self.slot[np.where(free, slots[0][new], slots[1][new])] = got
        far = np.flatnonzero(size > TABLE_BYTES).tolist()
        if far:
            texts = [raw[starts[k] : starts[k] + size[k]].tobytes() for k in far]
            ask = [t for t in dict.fromkeys(texts) if t not in self.long]
            zero = np.zeros(len(ask), np.uint64)
            known = self.long | dict(zip(ask, self._add(ask, [zero] * 3, zero.astype(np.int32)).tolist(), strict=True)) if ask else self.long
            entry[far] = [known[t] for t in texts]
            if not self.full:
                self.long.update({t: known[t] for t in ask if len(t) <= LONG_BYTES})
        return entry[which], first

    def encode_slice(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a slice, one after the other, and the n + 1 offsets of each text's ids."""
        entry, first = self.entries(raw, off)
        counts = self.count.data[entry]
        at = np.concatenate([[0], np.cumsum(counts)])
        return self.ids.data[ragged(self.at.data[entry], counts)], at[first]

    def count_slice(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """How many ids each text of a slice has."""
        entry, first = self.entries(raw, off)
        return np.diff(np.concatenate([[0], np.cumsum(self.count.data[entry])])[first])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for _, _, raw, off in slices(pa.array(texts, pa.large_string())):
            ids, at = self.encode_slice(raw, off)
            out += [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    def decode_slice(self, raw: np.ndarray, off: np.ndarray) -> list[str]:
        """The texts of little-endian ids (as bytes, with offsets); bytes that are no UTF-8 give U+FFFD."""
        ids = np.minimum(np.frombuffer(raw.tobytes(), "<u4"), np.uint32(len(self.token_size) - 1)).astype(np.int64)
        size = self.token_size[ids]
        data = self.token_bytes[ragged(self.token_at[ids], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[off // 4].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian ids, special tokens kept."""
        return self.decode_slice(np.frombuffer(ids, np.uint8), np.array([0, len(ids)]))[0]

    def words(self, text: str) -> tuple[np.ndarray, list[int]]:
        """Ids of a text and, for each, the number of the pre-tokenizer's word that it is in."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(e.ids, np.int64), e.word_ids

    def join(self, left: bytes, right: bytes, left_text: str, right_text: str) -> bytes:
        """The ids of the joined text, from those of its parts and of a window around the join."""
        a, b = np.frombuffer(left, "<u4").astype(np.int64), np.frombuffer(right, "<u4").astype(np.int64)
        reach = 2 * MARGIN
        while True:
            lo, hi = max(0, len(left_text) - reach), min(len(right_text), reach)
            start, end = lo == 0, hi == len(right_text)
            if start and end:
                return self.encode([left_text + right_text])[0]
            ids, _ = self.words(left_text[lo:] + right_text[:hi])
            sizes = np.array([len(self.tokens[i]) for i in ids.tolist()], np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])  # bytes from the window's start
            before = len(left_text[lo:].encode())
            whole = int(at[-1])
            i = (0, 0) if start else self._agree(ids, at, a, before, self._bytes_before(left_text[lo:]), left=True)
            j = (len(ids), len(b)) if end else self._agree(ids, at, b, before, whole - before - self._bytes_before(right_text[:hi][::-1]), left=False)
            if i is not None and j is not None and i[0] <= j[0]:
                return np.concatenate([a[: i[1]], ids[i[0] : j[0]], b[j[1] :]]).astype("<u4").tobytes()
            reach *= 2

    @staticmethod
    def _bytes_before(text: str) -> int:
        """Bytes of the half of a side that is farther from the join."""
        return len(text[: len(text) // 2].encode())

    def _agree(self, ids: np.ndarray, at: np.ndarray, side: np.ndarray, join: int, half: int, left: bool) -> tuple[int, int] | None:
        """A token start where window and side agree: same place, the two tokens on either side of it equal,
        and a visible character met by a space there, which the pre-tokenizer always starts a word at."""
        if left:
            step = side[-int(2 * join + 8) :] if join else side[:0]
            own = np.array([len(self.tokens[i]) for i in step.tolist()], np.int64)
            ends = join - np.concatenate([np.cumsum(own[::-1])[::-1], [0]])  # window offset of each token start
            first, places = len(side) - len(step), {int(p): k for k, p in enumerate(ends.tolist())}
            order = [k for k in range(1, len(ids)) if at[k] < join - MARGIN and at[k] <= half]
            order.reverse()
        else:
            span = int(at[-1]) - join
            step = side[: int(2 * span + 8)]
            own = np.array([len(self.tokens[i]) for i in step.tolist()], np.int64)
            starts = join + np.concatenate([[0], np.cumsum(own)])
            first, places = 0, {int(p): k for k, p in enumerate(starts.tolist())}
            order = [k for k in range(1, len(ids)) if at[k] > join + MARGIN and at[k] <= join + half]
        for k in order:
            m = places.get(int(at[k]))
            if m is None or m + first < 1 or m + first + 1 >= len(side) or k + 1 >= len(ids):
                continue
            m += first
            if side[m - 1] == ids[k - 1] and side[m] == ids[k] and self._word_start(ids, k):
                return k, m
        return None

    def _word_start(self, ids: np.ndarray, k: int) -> bool:
        """Does a space between two visible ASCII characters start token k?"""
        one, two = self.tokens[int(ids[k - 1])], self.tokens[int(ids[k])]
        if len(two) == 1 and k + 1 < len(ids):
            two += self.tokens[int(ids[k + 1])]
        return len(two) > 1 and two[0] == 0x20 and 0x21 <= two[1] <= 0x7E and 0x21 <= one[-1] <= 0x7E


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is visible in
    Latin-1, else the next letter from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + n) for n, b in enumerate(rest)}


def _encode_rows(path: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            kept = [i for i, f in enumerate(batch.schema) if f.name != text]
            names = [*(batch.schema.field(i).name for i in kept), "n_tokens", "ids"]
            for i, j, raw, off in slices(batch.column(batch.schema.get_field_index(text))):
                ids, at = codec.encode_slice(raw, off)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in kept), pa.array(np.diff(at), pa.int64()), binary_array(ids.astype("<u4"), 4 * at)], names)

    return run


def _join_rows(path: str):
    def run(key, table):
        codec = Codec.of(path)
        rows = sorted(table.select(["piece", "text", "ids"]).to_pylist(), key=lambda r: r["piece"])
        parts = [(r["text"], r["ids"]) for r in rows]
        while len(parts) > 1:  # a tree: neighbours join, level by level
            parts = [(a[0] + b[0], codec.join(a[1], b[1], a[0], b[0])) if b else a for a, b in zip(parts[::2], [*parts[1::2], None][: len(parts[::2])], strict=True)]
        text, ids = parts[0]
        first = table.slice(0, 1)
        return pa.table({"id": first["id"], "copies": first["copies"], "n_tokens": pa.array([len(ids) // 4], pa.int64()), "ids": pa.array([ids], pa.binary())})

    return run


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", split_chars: int = 32_768) -> DataFrame:
    """``id``, ``n_tokens`` and ``ids`` (binary: little-endian unsigned 32-bit) for each row of ``docs``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    kind = docs.schema[id].dataType.simpleString()
    rows = text_column(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text")
    short = rows.where(F.length("text") <= split_chars).mapInArrow(_encode_rows(path, "text"), f"id {kind}, n_tokens long, ids binary")
    size = F.lit(split_chars)
    long = (
        rows.where(F.length("text") > split_chars)
        .groupBy("id", F.sha2("text", 256).alias("digest"))
        .agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        .select("id", "digest", "copies", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int")), lambda k: F.col("text").substr(k * size + 1, size))).alias("piece", "text"))
        .repartition(partitions(spark), "id", "digest", "piece")
        .select("id", "digest", "copies", "piece", "text", F.col("text").alias("source"))
        .mapInArrow(_encode_rows(path, "source"), f"id {kind}, digest string, copies long, piece int, text string, n_tokens long, ids binary")
        .groupBy("id", "digest")
        .applyInArrow(_join_rows(path), f"id {kind}, copies long, n_tokens long, ids binary")
        .select("id", "n_tokens", "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .drop("copy")
    )
    return short.unionByName(long).withColumnRenamed("id", id)


def decode(coded: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``id`` and ``text`` for each row with little-endian ``ids`` (null: empty).  Ids outside the vocabulary
    have no text, as in the tokenizers library."""
    kind = coded.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for i, j, raw, off in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(codec.decode_slice(raw, off), pa.string())], ["id", "text"])

    return coded.select(F.col(id).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id)


def round_trip(coded: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``coded`` (``id``, ``n_tokens``, ``ids``) with SHA-256 of the ids and of the text decoded from them."""
    import hashlib

    kind = coded.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for i, j, raw, off in slices(batch.column(2)):
                texts = [hashlib.sha256(t.encode()).hexdigest() for t in codec.decode_slice(raw, off)]
                own = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(own, pa.string()), pa.array(texts, pa.string())], [id, "n_tokens", "ids_sha256", "decoded_sha256"])

    return coded.select(F.col(id), "n_tokens", F.col(ids)).mapInArrow(run, f"`{id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
