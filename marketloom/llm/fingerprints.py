"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with Spark functions only.

A paragraph is a line with a visible character, or a piece of one.  Every line, of whatever size, is also cut at its
sentence ends, and every sentence into pieces of at most 192 code points: after a word of a class of last letters past 64
code points, else at the last white space, else at 192.  The cuts hang on what stands there, not on the size of the text,
so an edited text keeps the digests of what it keeps.

A digest (64 bits) goes into one cell of each of three parts of a sketch; a cell holds a count, the XOR of its digests and
the XOR of their checks.  The difference of two sketches holds the differing digests alone; peeling takes a digest from
each cell that holds just one, until the cells are empty.

The fingerprint is a sketch as text, with a cell in each part for every DIGESTS digests, so it is small and two versions
that differ little can be compared by their fingerprints alone (``difference``; a wider one is folded to the narrower).
``compare`` knows both texts, so it begins with a sketch of the size that their digest counts let expect to do, and rows
whose cells stay are tried again with a larger one, up to TRIES times; what stays then counts as the least that it can
hold.  Cells are rows of an aggregation, and only those that hold something are rows, so a wide sketch costs no more than
a narrow one.  All steps of a row are done where its id range stands: one shuffle of the texts, none for the sketches.
Likeness: shared / all digests, from the sizes of both and the number of digests that differ.

Nulls are empty texts.  Texts without paragraphs are alike (1), and unlike any other (0).  Equal texts (ties) have equal
fingerprints.  Repeated rows and equal ids follow each other in text order, null ids come last, and an empty table gives no
rows.  Ids must be whole numbers (others are refused).  Only the id and text columns are read, so further columns may have
any name; texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import integer_id, partitions, shared_dir, text_column

#: Digests for each cell of a part of a fingerprint, and its least cells; cells of a part for each digest in a comparison,
#: their least and most, and how much wider the next try is.
DIGESTS, LEAST_CELLS = 8, 8
WIDER, FIRST_CELLS, MOST_CELLS, NEXT = 64, 1 << 14, 1 << 20, 16
#: Tries of a comparison, and turns over the three parts in each.
TRIES, TURNS = 3, 2
#: Rows of an id range.
RANGE = 250
#: Least and most code points of a piece that is cut inside a sentence.
LEAST, MOST = 64, 192
PIECE = f"(?s).{{{LEAST - 1},{MOST - 1}}}?[aeiout,;:](?= )|.{{1,{MOST}}}(?![^ ])|.{{1,{MOST}}}"


def digests(text: str) -> str:
    """SQL: the distinct paragraph digests of a text column."""
    lines = f"split({text}, '\\n')"
    pieces = f"flatten(transform(split(l, '(?<=[.!?]) +'), s -> regexp_extract_all(s, '{PIECE}', 0)))"
    parts = f"flatten(transform({lines}, l -> concat(array(l), {pieces})))"
    return f"array_distinct(transform(filter(transform({parts}, p -> trim(p)), p -> p <> ''), p -> xxhash64(p)))"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def width(n: str, least: int = LEAST_CELLS, most: int = MOST_CELLS) -> str:
    """SQL: the least power of two that reaches ``n``, between two limits."""
    return f"shiftleft(1L, least({most.bit_length() - 1}, greatest({least.bit_length() - 1}, coalesce(cast(ceil(log2({n})) as int), 0))))"


def _place(key: str, part: str, size: str) -> str:
    return f"shiftright({key}, 20 * {part}) & ({size} - 1L)"


def _cells(rows: DataFrame) -> DataFrame:
    """What each cell holds, from contributions; empty cells vanish."""
    held = rows.groupBy("bucket", "place", "sketch", "part", "cell").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"), F.max("size").alias("size"))
    return held.where("n <> 0 OR k <> 0 OR h <> 0")


#: Sketches of a row: the differences to the edited text and to the next text, the stored ones of both texts, plain facts.
EDIT, STEP, OWN, OTHER, FACTS = range(5)
_ROW = "named_struct('sketch', {0}, 'part', {1}, 'cell', {2}, 'n', {3}, 'k', {4}, 'h', {5}, 'size', {6})"


def _sizes(wider: int) -> str:
    """SQL: the cells in a part of each sketch of a row."""
    pair = lambda other: width(f"{wider} * greatest(size(own), size({other}))", FIRST_CELLS)
    return f"named_struct('e', {pair('other')}, 's', {pair('following')}, 'o', {width(f'size(own) / {DIGESTS}')}, 't', {width(f'size(other) / {DIGESTS}')})"


def _lists() -> str:
    """SQL: the digests of each sketch of a row, one array after the other."""
    of = [("own", EDIT, 1, "e"), ("other", EDIT, -1, "e"), ("own", STEP, 1, "s"), ("following", STEP, -1, "s"), ("own", OWN, 1, "o"), ("other", OTHER, 1, "t")]
    return ", ".join(f"transform({keys}, k -> {_ROW.format(sketch, 0, '0L', f'{n}L', 'k', '0L', f'sizes.{size}')})" for keys, sketch, n, size in of)


def peeled(cells: DataFrame, turns: int = TURNS, keep: bool = False) -> DataFrame:
    """The cells after peeling, part by part (a digest has one cell in a part, so it is taken once), with a row of part 3 for
    the digests taken of each side, or for each digest where ``keep`` (``k``, and ``n``: 1 or -1)."""
    for turn in range(3 * turns):
        p = turn % 3
        q, r = [x for x in range(3) if x != p]
        side = _ROW.format("sketch", "3", "k" if keep else "n", "n" if keep else "1L", "k" if keep else "0L", "0L", "size")
        taken = [_ROW.format("sketch", str(x), _place("k", str(x), "size"), "-n", "k", "h", "size") for x in (q, r)]
        stays = _ROW.format("sketch", "part", "cell", "n", "k", "h", "size")
        pure = f"sketch <= {STEP} AND part = {p} AND abs(n) = 1 AND h = xxhash64(k)"
        moved = cells.select("bucket", "place", F.expr(f"explode(CASE WHEN {pure} THEN array({side}, {', '.join(taken)}) ELSE array({stays}) END)").alias("x")).select("bucket", "place", "x.*")
        cells = _cells(moved)
    return cells


def stored(text: str) -> str:
    """SQL: the cells of a fingerprint: a map from place (part * size + cell) to count, digests and checks."""
    number = lambda at: f"cast(conv(split(c, '[.]')[{at}], 16, -10) as bigint)"
    cell = f"named_struct('key', cast(split(c, '[.]')[0] as bigint), 'value', named_struct('n', cast(split(c, '[.]')[1] as bigint), 'k', {number(2)}, 'h', {number(3)}))"
    return f"map_from_entries(transform(filter(split(split({text}, ':')[2], ','), c -> c <> ''), c -> {cell}))"


def difference(pairs: DataFrame, a: str = "fingerprint", b: str = "edited_fingerprint") -> DataFrame:
    """From pairs of fingerprints alone: ``row`` (a number of the pair), ``k`` and ``n``: each digest that peeling recovers,
    1 if the first has it, -1 if the second; ``n`` is null, and ``k`` too, for what can't be peeled."""
    numbered = pairs.select(F.monotonically_increasing_id().alias("place"), F.expr("0").alias("bucket"), F.col(a).alias("a"), F.col(b).alias("b"))
    sized = numbered.withColumn("size", F.expr("least(cast(split(a, ':')[1] as bigint), cast(split(b, ':')[1] as bigint))"))
    side = lambda f, sign: sized.select("bucket", "place", F.expr(f"cast(split({f}, ':')[1] as bigint)").alias("own"), "size", F.expr(f"explode({stored(f)})").alias("at", "c")).select("bucket", "place", F.lit(EDIT).alias("sketch"), F.expr("cast(at div own as int)").alias("part"), F.expr("at % own & (size - 1L)").alias("cell"), (F.col("c.n") * sign).alias("n"), "c.k", "c.h", "size")
    left = peeled(_cells(side("a", 1).unionByName(side("b", -1))), keep=True)
    return left.select(F.col("place").alias("row"), F.expr("CASE WHEN part = 3 THEN k END").alias("k"), F.expr("CASE WHEN part = 3 THEN n END").alias("n"))


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """``bucket`` and ``place`` (which tell rows apart), ``id``, ``text``, ``n_chars``, digests (``keys``), and text and digests of the next document in descending id order
    (after the last: the first).  Rows are dealt by id range, so a window never holds all; the text after the last of a range comes by an
    equi-join.  Repeated ids follow each other in descending text order; null ids come last."""
    rows = text_column(docs.select(integer_id(docs, id).alias("id"), F.col(text).alias("text")), "text")
    spread = rows.agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    n, lo, hi = spread.n, spread.lo or 0, spread.hi or 0
    buckets = buckets or max(1, -(-n // RANGE))
    bounds = rows.agg(F.percentile_approx("id", [(k + 1) / buckets for k in range(min(buckets, 512) - 1)], 100_000)).first()[0] if 1 < buckets <= 512 else None
    if bounds:
        at = F.aggregate(F.array(*[F.lit(b) for b in sorted(set(bounds))]), F.lit(0), lambda s, b: s + F.when(F.col("id") > b, 1).otherwise(0))
    else:  # too many ranges to list: equal widths
        at = F.floor((F.col("id") - F.lit(lo)) / F.lit(max(1, -(-(hi - lo + 1) // buckets)))).cast("int")
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(at)).repartition(max(partitions(docs.sparkSession), buckets), "bucket").withColumn("keys", F.expr(digests("text")))
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("id"), F.desc("text"))
    placed = rows.withColumn("following", F.lead(F.struct("text", "keys")).over(order)).withColumn("place", F.row_number().over(order))
    tops = placed.where("place = 1").select(F.col("bucket").alias("next"), F.col("text").alias("head"))  # the same shuffle, read again
    # one row for each range, ids only
    ring = rows.groupBy("bucket").agg(F.lit(1).alias("one")).select("bucket", F.coalesce(F.lead("bucket").over(Window.orderBy(F.desc("bucket"))), F.max("bucket").over(Window.partitionBy())).alias("next"))
    heads = ring.join(tops, "next").select("bucket", "head")
    both = placed.join(heads, "bucket")
    return both.select("bucket", "place", "id", "text", F.length("text").alias("n_chars"), "keys", F.expr("CASE WHEN following IS NULL THEN head ELSE following.text END").alias("next_text"), F.expr(f"CASE WHEN following IS NULL THEN {digests('head')} ELSE following.keys END").alias("next_keys"))


def edited(text: str = "text", n: str = "n_chars", following: str = "next_text") -> str:
    """SQL: the text with its last floor(n/2) code points replaced by the first as many of the next."""
    half = f"cast(floor({n} / 2) as int)"
    return f"concat(substring({text}, 1, cast({n} as int) - {half}), substring({following}, 1, {half}))"


def compare(docs: DataFrame, id: str = "doc_id", text: str = "text", recovered: bool = False) -> DataFrame:
    """``id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``; with
    ``recovered`` also ``lost`` and ``gained``, the digests that peeling finds in the text alone and in the edited text
    alone."""
    rows = with_next(docs, id, text).withColumn("edited", F.expr(edited()))
    keyed = rows.select("bucket", "place", "id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("keys").alias("own"), F.expr(digests("edited")).alias("other"), F.col("next_keys").alias("following"))
    # the facts of a row travel as numbers beside its cells, so that the texts are gone through once
    word = lambda k: f"cast(conv(substring(edited_sha256, {16 * k + 1}, 16), 16, -10) as bigint)"
    facts = [_ROW.format(FACTS, 0, "0L", "CASE WHEN id IS NULL THEN 2L ELSE 1L END", "coalesce(id, 0L)", "n_chars", "0L"), _ROW.format(FACTS, 1, "cast(size(own) as bigint)", "1L", word(0), word(1), "cast(size(other) as bigint)"), _ROW.format(FACTS, 2, "cast(size(following) as bigint)", "1L", word(2), word(3), "0L")]

    def run(some: DataFrame, wider: int) -> DataFrame:
        sizes, lists = _sizes(wider), _lists()
        single = some.withColumn("sizes", F.expr(sizes)).select("bucket", "place", F.expr(f"explode(concat(array({', '.join(facts)}), {lists}))").alias("d")).select("bucket", "place", "d.*")
        parts = ", ".join(_ROW.format("sketch", p, _place("k", str(p), "size"), "n", "k", "xxhash64(k)", "size") for p in range(3))
        every = single.select("bucket", "place", F.expr(f"explode(CASE WHEN sketch = {FACTS} THEN array({_ROW.format('sketch', 'part', 'cell', 'n', 'k', 'h', 'size')}) ELSE array({parts}) END)").alias("d")).select("bucket", "place", "d.*")
        return peeled(_cells(every), keep=recovered)

    def whole(cells: DataFrame) -> DataFrame:
        pick = lambda what, of: F.max(F.expr(f"CASE WHEN sketch = {FACTS} AND part = {of} THEN {what} END"))
        taken = lambda s: F.coalesce(F.sum(F.expr(f"CASE WHEN sketch = {s} AND part = 3 THEN abs(n) END")), F.lit(0))
        stuck = lambda s: F.coalesce(F.sum(F.expr(f"CASE WHEN sketch = {s} AND part = 0 THEN greatest(abs(n), 2L) END")), F.lit(0))
        cell = lambda s: F.collect_list(F.expr(f"CASE WHEN sketch = {s} THEN named_struct('at', part * size + cell, 'size', size, 'n', n, 'k', k, 'h', h) END"))
        digest = lambda n: F.collect_list(F.expr(f"CASE WHEN sketch = {EDIT} AND part = 3 AND n = {n} THEN k END"))
        more = [digest(1).alias("lost"), digest(-1).alias("gained")] if recovered else []
        return cells.groupBy("bucket", "place").agg(
            pick("CASE WHEN n = 1 THEN k END", 0).alias("id"), pick("h", 0).alias("n_chars"), pick("cell", 1).alias("n_own"), pick("size", 1).alias("n_other"), pick("cell", 2).alias("n_following"),
            *[pick(c, p).alias(f"w{k}") for k, (c, p) in enumerate((("k", 1), ("h", 1), ("k", 2), ("h", 2)))],
            (taken(EDIT) + stuck(EDIT)).alias("d_edit"), (taken(STEP) + stuck(STEP)).alias("d_step"), (stuck(EDIT) + stuck(STEP)).alias("stuck"), cell(OWN).alias("own"), cell(OTHER).alias("other"), *more,
        )

    near = lambda a, b, d: F.expr(f"CASE WHEN {a} + {b} = 0 THEN 1D ELSE greatest(0D, ({a} + {b} - {d}) / cast({a} + {b} + {d} as double)) END")
    text_of = lambda c, n: F.expr(f"concat({n}, ':', coalesce(get({c}, 0).size, {LEAST_CELLS}), ':', array_join(transform(sort_array({c}), c -> concat(c.at, '.', c.n, '.', hex(c.k), '.', hex(c.h))), ','))")
    digest = F.expr("lower(concat(" + ", ".join(f"lpad(hex(w{k}), 16, '0')" for k in range(4)) + "))")
    columns = [F.col("id").alias(id), "n_chars", digest.alias("edited_sha256"), text_of("own", "n_own").alias("fingerprint"), text_of("other", "n_other").alias("edited_fingerprint"), near("n_own", "n_other", "d_edit").alias("near_edited"), near("n_own", "n_following", "d_step").alias("near_next"), *(["lost", "gained"] if recovered else [])]

    done = whole(run(keyed, WIDER)).select("bucket", "place", "stuck", *columns)
    for k in range(1, TRIES):
        path = f"{shared_dir(docs.sparkSession)}/fingerprints-{uuid.uuid4().hex}"
        done.write.option("compression", "zstd").parquet(path)  # compressed, as a checkpoint is not
        done = docs.sparkSession.read.parquet(path)
        failed = done.where("stuck > 0").select("bucket", "place")
        if failed.isEmpty():
            break
        # one row in some 100 million: their ids are few, and only their texts are gone through again
        again = whole(run(keyed.join(F.broadcast(failed), ["bucket", "place"], "left_semi"), WIDER * NEXT**k)).select("bucket", "place", "stuck", *columns)
        done = done.where("stuck = 0").unionByName(again)
    return done.drop("bucket", "place", "stuck")
