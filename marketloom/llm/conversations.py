"""Conversation structure repair by Four-Russians block tables.

Rows of a conversation stand by turn (nulls first, ties by role, then text).  Each row's first fault counts: blank (no
visible character), duplicate (role and text seen earlier), truncated (last visible character not ``[.!?]``).  Edits keep
a row (0), give it another role, user or assistant (2), delete it (3; required for blank and duplicate rows) or insert an
empty user or assistant row (2); a truncated row that stays adds 1.  The cheapest edits whose role initials read
``(s?(ua)+)?`` are the audit, a string of K, R, D and I; of equally cheap ones the least in ASCII.

1. A row is one of nine symbols; the cost of finishing from the four states of the pattern is a vector.  Less its least
   value it is one of few, so a table holds, for each vector behind a block of BLOCK symbols and each block, the vector
   before the block and what was taken off.
2. All conversations of a batch go through the table at once, from their last block to the first.
3. Tracing goes forward from the first block: each block is expanded backward from the vector behind it, and a second table
   names the least edit on a cheapest path for (vector behind the row, symbol, state), so ties go to the least string.

Rows are dealt by conversation and sorted; a task holds, for one conversation at a time, some 30 bytes for each of its rows
(its audit, one value of the result, is as long), and never its texts: those go by once more, in order, into a running
SHA-256, behind the row that carries the audit.

Nulls in role and text are one space, and so are null ids and turns where the row's damage is drawn; a null conversation id
is a conversation of its own.  Repeated rows are duplicates.  A conversation without rows has zeros, an empty audit and
the hash of the empty string.  An empty table gives no rows.  Texts of any length are read whole; only the four named
columns are read, so further ones may have any name.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut, partitions

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Symbols in a block.
BLOCK = 4
#: States of the pattern: nothing yet, after s, after u, after a; the next one by an inserted or reroled row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
ENDS = (START, ASSISTANT)
#: Symbols: 0 must go; 1 to 4 are roles s, u, a and others, 5 to 8 the same, truncated.
SYMBOLS = 9
ROLES = "sua"
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def keeps(symbol: int, state: int) -> int | None:
    """The state after a row that is kept as it is, if it may be."""
    role = (symbol - 1) % 4 if symbol else 3
    return {(0, START): SYSTEM, (1, START): USER, (1, SYSTEM): USER, (1, ASSISTANT): USER, (2, USER): ASSISTANT}.get((role, state))


def _with_inserts(raw: tuple[int, ...]) -> tuple[int, ...]:
    """The vector when rows may be inserted before what follows (two lead from any state to any that rows can reach)."""
    one = [min(raw[q], INSERT + raw[NEXT[q]]) for q in range(4)]
    return tuple(min(one[q], INSERT + one[NEXT[q]]) for q in range(4))


def _before(behind: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """The vector before a row from that behind it."""
    out = []
    for q in range(4):
        ways = [DELETE + behind[q]]
        if symbol:
            extra = TRUNCATED if symbol > 4 else 0
            ways.append(REROLE + extra + behind[NEXT[q]])
            kept = keeps(symbol, q)
            if kept is not None:
                ways.append(extra + behind[kept])
        out.append(min(ways))
    return _with_inserts(tuple(out))


class Tables:
    """Transitions between normalised vectors for every symbol and every block, and the least edit of each step."""

    def __init__(self, block: int = BLOCK):
        far = 1 << 20
        last = _with_inserts(tuple(0 if q in ENDS else far for q in range(4)))
        vectors, at, k = [last], {last: 0}, 0
        step, took, edit = [], [], []
        while k < len(vectors):  # every vector that rows can lead to
            behind, k = vectors[k], k + 1
            rows, costs, edits = [], [], []
            for symbol in range(SYMBOLS):
                full = _before(behind, symbol)
                least = min(full)
                vector = tuple(x - least for x in full)
                if vector not in at:
                    at[vector] = len(vectors)
                    vectors.append(vector)
                rows.append(at[vector])
                costs.append(least)
                edits.append([self._least(behind, full, symbol, q) for q in range(4)])
            step.append(rows)
            took.append(costs)
            edit.append(edits)
        self.vectors, self.step, self.took = np.array(vectors), np.array(step), np.array(took)
        self.edit = np.array([[[ord(c) for c in s] for s in v] for v in edit], np.uint8)
        self.kept = np.array([[-1 if keeps(s, q) is None else keeps(s, q) for q in range(4)] for s in range(SYMBOLS)])
        self.block = block
        # a block's code has its first symbol as the highest digit; transitions of n symbols come from those of n - 1
        to, cost = np.arange(len(vectors))[:, None], np.zeros((len(vectors), 1), np.int64)
        for _ in range(block):  # the new symbol stands in front
            width = to.shape[1]
            to, cost = self.step[to].transpose(0, 2, 1).reshape(-1, SYMBOLS * width), (cost[:, None, :] + self.took[to].transpose(0, 2, 1)).reshape(-1, SYMBOLS * width)
        self.block_to, self.block_cost = to, cost

    @staticmethod
    def _least(behind, full, symbol, q) -> str:
        """The least of D, I, K and R on a cheapest path."""
        extra = TRUNCATED if symbol > 4 else 0
        if DELETE + behind[q] == full[q]:
            return "D"
        if INSERT + full[NEXT[q]] == full[q]:
            return "I"
        kept = keeps(symbol, q)
        return "K" if symbol and kept is not None and extra + behind[kept] == full[q] else "R"

    def repair(self, symbols: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Cost and audit of each of many conversations, whose symbols stand one after the other."""
        n, b = len(counts), self.block
        whole = counts // b
        vector, cost = np.zeros(n, np.int64), np.zeros(n, np.int64)
        # the rows behind the last whole block one by one, then the blocks from the last to the first
        for k in range(int((counts % b).max(initial=0)) - 1, -1, -1):
            on = np.flatnonzero(counts % b > k)
            s = symbols[starts[on] + whole[on] * b + k]
            cost[on] += self.took[vector[on], s]
            vector[on] = self.step[vector[on], s]
        first = np.cumsum(whole) - whole
        behind = np.zeros(int(whole.sum()), np.int64)  # the vector behind each block
        weights = SYMBOLS ** np.arange(b - 1, -1, -1)
        by_length = np.argsort(-whole, kind="stable")
        for k in range(int(whole.max(initial=0)) - 1, -1, -1):
            on = by_length[: int(np.searchsorted(-whole[by_length], -k, side="left"))]
            code = symbols[(starts[on] + k * b)[:, None] + np.arange(b)] @ weights
            behind[first[on] + k] = vector[on]
            cost[on] += self.block_cost[vector[on], code]
            vector[on] = self.block_to[vector[on], code]
        cost += self.vectors[vector, START]
        return cost, [self._trace(symbols[a : a + c], behind[f : f + w]) for a, c, f, w in zip(starts.tolist(), counts.tolist(), first.tolist(), whole.tolist(), strict=True)]

    def _trace(self, symbols: np.ndarray, behind: np.ndarray) -> bytes:
        b, out, q = self.block, bytearray(), START
        step, edit, kept, rows = self.step, self.edit, self.kept, symbols.tolist()
        for k in range(len(behind) + 1):
            part = rows[k * b : (k + 1) * b]
            v, vectors = (int(behind[k]) if k < len(behind) else 0), []
            for s in reversed(part):  # the block expanded backward
                vectors.append(v)
                v = int(step[v, s])
            for s in part:
                v = vectors.pop()
                while (e := int(edit[v, s, q])) == 73:  # I
                    out.append(e)
                    q = int(NEXT[q])
                out.append(e)
                q = q if e == 68 else int(kept[s, q]) if e == 75 else int(NEXT[q])
        while q not in ENDS:
            out.append(73)
            q = int(NEXT[q])
        return bytes(out)


@functools.cache
def tables() -> Tables:
    return Tables()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole conversations and where each begins, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and batch.column(0)[-1] == held[-1].column(0)[-1] and batch.column(0)[0] == batch.column(0)[-1]:
            held.append(batch)  # the same conversation goes on
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        starts = _starts(table.column(0))
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1])), starts[:-1]
        held = table.slice(int(starts[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table.column(0))


def _starts(column: pa.ChunkedArray) -> np.ndarray:
    codes = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults, cost and audit of every conversation, from sorted rows without texts."""
    of = tables()
    for table, starts in _conversations(batches):
        ids = table.column(0).combine_chunks().take(pa.array(starts))
        n_all, group = table.num_rows, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        there = np.flatnonzero(~table["dropped"].to_numpy())
        group, n = group[there], len(there)
        has_turn = pc.is_valid(table["turn"]).to_numpy()[there]
        turn = pc.fill_null(table["turn"], 0).to_numpy()[there]
        initial = np.array([{"s": 0, "u": 1, "a": 2}.get(x, 3) for x in table["initial"].to_pylist()])[there] if n_all else np.zeros(0, int)
        blank, open_end = table["blank"].to_numpy()[there], table["truncated"].to_numpy()[there]
        one, two = table["one"].to_numpy()[there], table["two"].to_numpy()[there]
        order = np.lexsort((np.arange(n), two, one, group))  # equal rows of a conversation in their order
        again = np.zeros(n, bool)
        again[order[1:]] = (group[order][1:] == group[order][:-1]) & (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        again &= ~blank
        open_end = open_end & ~blank & ~again
        symbols = np.where(blank | again, 0, initial + 1 + 4 * open_end).astype(np.int64)
        counts = np.bincount(group, minlength=len(starts))
        begin = np.cumsum(counts) - counts
        cost, audit = of.repair(symbols, begin, counts)
        total = lambda flag: np.bincount(group, weights=flag, minlength=len(starts)).astype(np.int64)
        wrong = np.zeros(n, bool)
        if n > 1:
            pair = initial[:-1] * 4 + initial[1:]
            wrong[1:] = (group[1:] == group[:-1]) & ~np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
        new = has_turn.copy()
        new[1:] &= (group[1:] != group[:-1]) | ~has_turn[:-1] | (turn[1:] != turn[:-1])
        gaps = np.zeros(len(starts), np.int64)
        some = np.unique(group[has_turn])
        if len(some):
            firsts = np.searchsorted(group * 2 + has_turn, some * 2 + 1)  # nulls stand first
            lasts = np.searchsorted(group, some, side="right") - 1
            gaps[some] = turn[lasts] - turn[firsts] + 1 - total(new)[some]
        facts = [gaps, total(blank), total(again), total(open_end), total(wrong), cost]
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in facts], pa.array([a.decode() for a in audit], pa.string())], ["conv", *FACTS, "audit"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every repaired conversation: behind the row with its audit its rows go by in order."""
    now, audit, at, state, digest, empty = None, "", 0, START, None, True
    done: list[tuple] = []

    def line(role: str, text: str) -> None:
        nonlocal empty
        digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
        empty = False

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = int(NEXT[state])
            line("user" if state == USER else "assistant", "")
            at += 1

    def finish() -> None:
        if now is not None:
            inserts()
            done.append((*now, digest.hexdigest()))

    names = ["conv", *FACTS, "audit"]
    schema = None
    for batch in batches:
        schema = schema or pa.schema([*[batch.schema.field(n) for n in names], pa.field("repaired_sha256", pa.string())])
        for row in batch.to_pylist():
            if row["kind"] == 0:
                finish()
                now, audit, at, state, digest, empty = tuple(row[n] for n in names), row["audit"], 0, START, hashlib.sha256(), True
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "R":
                state = int(NEXT[state])
                line("user" if state == USER else "assistant", row["text"])
            elif edit == "K":
                state = keeps(1 + max(ROLES.find(row["role"][:1]), 0), state)
                line(row["role"], row["text"])
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done.clear()
    finish()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


def damage(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` and ``dropped`` of each row, damaged by crc32(`id:turn`) % 20: 0 drops it (the
    row stays, marked), 1 empties the text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's."""
    shown = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(id), F.lit(":"), shown(turn))) % 20
    base = rows.select(F.col(f"`{id}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), kind.alias("harm"))
    base = base.select("conv", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "harm")
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return base.select("conv", "turn", "role", "text", (F.col("harm") == 0).alias("dropped"), copies).drop("copy")


def undamaged(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as ``repair`` takes them, with nothing done to them."""
    shown = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{id}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), F.lit(False).alias("dropped"))


def repair(rows: DataFrame, id: str = "conv_id") -> DataFrame:
    """For each conversation of ``damage`` or ``undamaged`` rows: ``id``, the counts of its faults, ``cost``, ``audit`` and
    ``repaired_sha256``."""
    spark = rows.sparkSession
    arrow_batches(spark)
    kind = rows.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "role", "text"]
    rows = cut(rows)
    seen = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)  # the last visible character
    marks = rows.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~seen.isin(".", "!", "?")).alias("truncated"), F.xxhash64("role", "text").alias("one"), F.xxhash64(F.lit(1), "text", "role").alias("two"), "dropped", "role", "text")
    dealt = marks.repartition(partitions(spark), "conv").sortWithinPartitions(*order)
    facts = ", ".join(f"{f} long" for f in FACTS)
    audits = dealt.drop("role", "text").mapInArrow(_audits, f"conv {kind}, {facts}, audit string")
    audits = cut(audits)
    none = lambda names: [F.lit(None).cast("long").alias(n) for n in names]
    heads = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *FACTS, "audit")
    lines = rows.where("NOT dropped").select("conv", F.lit(1).alias("kind"), "turn", "role", "text", *none(FACTS), F.lit(None).cast("string").alias("audit"))
    stream = heads.unionByName(lines).repartition(partitions(spark), "conv").sortWithinPartitions("conv", "kind", "turn", "role", "text")
    return stream.mapInArrow(_hashes, f"conv {kind}, {facts}, audit string, repaired_sha256 string").withColumnRenamed("conv", id)
