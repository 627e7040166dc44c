"""Merkle manifest of a table: every row is a leaf, leaves of a group form a tree, the groups' roots form another.

H is the lowercase hex SHA-256 of its inputs one after the other.  A leaf is H of its fields, each ``-`` if null, else its
UTF-8 byte count, ``:`` and its value.  While a tree has several nodes, each run of FANOUT consecutive ones (the last may be
shorter) becomes its H.  A proof is the siblings of a row's node, level by level, from which its root can be folded.

1. One pass hashes the texts; what is shuffled from there on are digests.
2. Leaves are dealt by (group, order, digest) ranges, counted in each part, and numbered by the part's offset, so no task
   holds a group.
3. Nodes of a group are cut into blocks of FANOUT**LEVELS.  In a block's window each level reads its siblings by lag and
   lead columns of fixed offsets j * FANOUT**level, masked by the slot of the node and the length of its run; the
   first child of a run hashes the parent, which stands on its row for the next level.
4. The blocks' tops are the nodes of the next climb; its proofs come back by a join on (group, block).

Nulls: a null field is ``-``; null groups come first, null orders before others.  Ties and repeated rows stand by their digest and
are leaves each.  An empty table gives no rows.  Texts of any length are read whole.  Only the named columns are read,
so further ones may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

FANOUT, LEVELS = 8, 4
BLOCK = FANOUT**LEVELS
_PROOF = "array<struct<left:string,right:string>>"


def leaf(*fields: Column) -> Column:
    """The digest of the fields of a row."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[one(c) for c in fields]), 256)


def number(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``leaves`` with ``pos`` (from 0 in its group by ``order``) and ``n`` (leaves of its group)."""
    spark = leaves.sparkSession
    told = cut(leaves.withColumn("row", F.monotonically_increasing_id()))  # ranges are sampled from it, and equal rows split
    dealt = told.repartitionByRange(partitions(spark), group, *order, "row").withColumn("part", F.spark_partition_id())
    dealt = cut(dealt)
    held = dealt.groupBy(group, "part").agg(F.count("*").alias("held"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(group, "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"), F.sum("held").over(Window.partitionBy(group)).alias("n"))
    within = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order, "row")) - 1
    return dealt.withColumn("within", within).join(offsets, [group, "part"]).withColumn("pos", F.col("offset") + F.col("within")).drop("row", "part", "offset", "within")


def _levels(nodes: DataFrame) -> DataFrame:
    """``nodes`` (group, pos, n, digest) with ``block``, ``top`` (on a block's first row) and the ``proof`` of each row up to
    its block's top."""
    order = Window.partitionBy("group", "block").orderBy("pos")
    out = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("d0", F.col("digest"))
    for k in range(LEVELS):
        step = FANOUT**k
        own, many = F.expr(f"pos % {step} = 0"), F.expr(f"n > {step}")
        slot = F.expr(f"pos div {step} % {FANOUT}")
        run = F.expr(f"least({FANOUT}L, (n + {step - 1}) div {step} - (pos div {step} - pos div {step} % {FANOUT}))")
        digest = F.col(f"d{k}")
        left = [F.when(slot >= j, F.lag(digest, j * step).over(order)) for j in range(FANOUT - 1, 0, -1)]
        right = [F.when(slot + j < run, F.lead(digest, j * step).over(order)) for j in range(1, FANOUT)]
        sides = F.struct(F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right"))
        out = out.withColumn(f"s{k}", F.when(own & many, sides))
        parent = F.sha2(F.concat_ws("", digest, F.col(f"s{k}.right")), 256)
        out = out.withColumn(f"d{k + 1}", F.when(own & (slot == 0), F.when(many, parent).otherwise(digest)))
    # a node's sides stand on its first row, which is the last one before each of its rows that has any
    sides = [F.col("s0"), *[F.last(f"s{k}", ignorenulls=True).over(order) for k in range(1, LEVELS)]]
    alive = [F.when(F.col("n") > FANOUT**k, s) for k, s in enumerate(sides)]
    return out.withColumn("proof", F.filter(F.array(*alive), lambda p: p.isNotNull()).cast(_PROOF)).withColumnRenamed(f"d{LEVELS}", "top").drop(*[f"d{k}" for k in range(LEVELS)], *[f"s{k}" for k in range(LEVELS)])


def _climb(nodes: DataFrame, most: int, crown) -> DataFrame:
    """``group``, ``pos``, ``proof`` and what ``crown`` gives for each group's root; ``most``: nodes of the largest group."""
    if most <= 1:
        return crown(nodes.select("group", "digest")).withColumn("pos", F.lit(0).cast("long"))
    tops = cut(_levels(nodes).where(f"pos % {BLOCK} = 0").select("group", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("digest")))
    above = _climb(tops, -(-most // BLOCK), crown).withColumnRenamed("pos", "block").withColumnRenamed("proof", "above")
    joined = _levels(nodes).select("group", "block", "pos", "proof").join(above, ["group", "block"])
    return joined.withColumn("proof", F.concat("proof", "above")).drop("above", "block")


def _tree(leaves: DataFrame, order: list[str], crown) -> tuple[DataFrame, DataFrame]:
    """Numbered leaves (``group``, ``digest``, further columns) and the paths of their nodes."""
    numbered = cut(number(leaves, "group", order))
    most = numbered.agg(F.max("n")).first()[0] or 0
    return numbered, _climb(numbered.select("group", "pos", "n", "digest"), most, crown)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, digest, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def prove(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (``group``, ``digest`` and further columns) with ``proof``, ``subroot`` (of its group) and ``root``.  Groups
    must sort as strings and not be null (``group_key``)."""

    def crown(roots: DataFrame) -> DataFrame:
        over = roots.select(F.lit("").alias("group"), F.col("group").alias("of"), "digest")
        numbered, paths = _tree(over, ["of"], lambda top: top.select("group", F.col("digest").alias("root"), F.array().cast(_PROOF).alias("proof")))
        both = numbered.join(paths, ["group", "pos"])
        return cut(both.select(F.col("of").alias("group"), F.col("digest").alias("subroot"), "root", "proof"))

    numbered, paths = _tree(leaves, order, crown)
    return numbered.join(paths, ["group", "pos"]).drop("pos", "n", "group")


def group_key(c: Column) -> Column:
    """A string that sorts as the value does, nulls first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)
