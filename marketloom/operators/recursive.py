"""Recursive series whose history may be split: y = a * y_before + b, for any a and b of the row.

Such steps are affine maps, and two of them in a row are one again, so a block of rows is a pair (a, b): blocks are
reduced inside themselves, their pairs are put through the same scan one level up, and each row takes what its
block begins with.  A ticker's history lies in as many tasks as it has blocks; the last pair, applied to a stored value,
is also how a stream goes on (``carried``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block: a power of two.
BLOCK = 64


def affine_scan(df: DataFrame, series: dict[str, tuple[Column, Column]], by: str = "ticker", order: str = "session_no", block: int = BLOCK) -> DataFrame:
    """``df`` with a column for each series: name -> (a, b).  ``order`` must be a whole number, once in each key.  The first row
    of a key has nothing before it, as if a were 0.  Where a or b is null the value before stays."""
    maps = {}
    for k, (a, b) in enumerate(series.values()):
        still = a.isNull() | b.isNull()
        maps |= {f"__a{k}": F.when(still, 1.0).otherwise(a), f"__b{k}": F.when(still, 0.0).otherwise(b)}
    span = df.agg((F.max(order) - F.min(order)).cast("long")).first()[0] or 0
    out = _scan(df.withColumns(maps), len(series), by, order, block, span)
    return out.withColumns({name: F.col(f"__y{k}") for k, name in enumerate(series)}).drop(*[f"__{x}{k}" for x in "aby" for k in range(len(series))])


def _scan(df: DataFrame, n: int, by: str, order: str, block: int, span: int) -> DataFrame:
    """``df`` with ``__y0``, ... from the maps ``__a0``, ``__b0``, ..."""
    d = df.withColumn("__block", F.floor(F.col(order) / block).cast("long"))
    inner = Window.partitionBy(by, "__block").orderBy(order)
    step = 1
    while step < block:  # each row's map becomes that of the 2 * step rows that end at it
        d = d.withColumns({f"__p{x}{k}": F.lag(f"__{x}{k}", step).over(inner) for x in "ab" for k in range(n)})
        some = F.col("__pa0").isNotNull()
        d = d.withColumns({f"__b{k}": F.when(some, F.col(f"__a{k}") * F.col(f"__pb{k}") + F.col(f"__b{k}")).otherwise(F.col(f"__b{k}")) for k in range(n)} | {f"__a{k}": F.when(some, F.col(f"__a{k}") * F.col(f"__pa{k}")).otherwise(F.col(f"__a{k}")) for k in range(n)})
        d = d.drop(*[f"__p{x}{k}" for x in "ab" for k in range(n)])
        step *= 2
    if span < block:  # two blocks at most: no further level
        ends = _ends(d, n, by, order).select(by, "__block", *[F.col(f"__b{k}").alias(f"__y{k}") for k in range(n)], *[F.col(f"__a{k}") for k in range(n)])
        w = Window.partitionBy(by).orderBy("__block")
        carry = ends.select(by, "__block", *[F.lag(f"__y{k}").over(w).alias(f"__c{k}") for k in range(n)])
    else:
        ends = _ends(d, n, by, order).withColumnRenamed("__block", "__at")
        above = _scan(ends, n, by, "__at", block, span // block + 1)
        w = Window.partitionBy(by).orderBy("__at")
        carry = above.select(by, F.col("__at").alias("__block"), *[F.lag(f"__y{k}").over(w).alias(f"__c{k}") for k in range(n)])
    out = d.join(carry, [by, "__block"])
    return out.withColumns({f"__y{k}": F.coalesce(F.col(f"__a{k}") * F.col(f"__c{k}"), F.lit(0.0)) + F.col(f"__b{k}") for k in range(n)}).drop("__block", *[f"__c{k}" for k in range(n)])


def _ends(d: DataFrame, n: int, by: str, order: str) -> DataFrame:
    last = F.max_by(F.struct(*[f"__{x}{k}" for x in "ab" for k in range(n)]), order)
    return d.groupBy(by, "__block").agg(last.alias("e")).select(by, "__block", "e.*")


def smooth(value: Column, alpha: float, first: Column) -> tuple[Column, Column]:
    """The map of exponential smoothing that begins with the value of the ``first`` row; nulls leave the mean as it is."""
    return F.when(first, 0.0).when(value.isNotNull(), 1 - alpha), F.when(first, value).otherwise(alpha * value)


def _first(by: str, order: str) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(order)) == 1


def ema(bars: DataFrame, spans: tuple[int, ...] = (9, 20, 50), price: str = "close", block: int = BLOCK) -> DataFrame:
    """``bars`` with ``ema_<span>``, begun by the first price (the session with no price before it)."""
    starts = F.lag(price).over(Window.partitionBy("ticker").orderBy("session_no")).isNull()
    b = bars.withColumn("__first", starts)
    return affine_scan(b, {f"ema_{s}": smooth(F.col(price), 2 / (s + 1), F.col("__first")) for s in spans}, block=block).drop("__first")


def wilder_rsi(bars: DataFrame, n: int = 14, block: int = BLOCK) -> DataFrame:
    """``bars`` with ``gain``, ``loss`` (Wilder's means, begun by the plain means of the first n moves) and ``rsi`` over the whole
    history; null before n moves.  100 without losses, 0 without gains."""
    w = Window.partitionBy("ticker").orderBy("session_no")
    move = F.col("close") - F.lag("close").over(w)
    b = bars.withColumn("__move", move).withColumn("__n", F.count("__move").over(w))
    up, down = F.greatest("__move", F.lit(0.0)), F.greatest(-F.col("__move"), F.lit(0.0))
    b = b.withColumns({"__up": F.avg(up).over(w.rowsBetween(-(n - 1), 0)), "__down": F.avg(down).over(w.rowsBetween(-(n - 1), 0))})
    seeded = lambda x, mean: (F.when(F.col("__n") <= n, 0.0).otherwise(1 - 1 / n), F.when(F.col("__n") < n, 0.0).when(F.col("__n") == n, mean).otherwise(x / n))
    out = affine_scan(b, {"gain": seeded(up, F.col("__up")), "loss": seeded(down, F.col("__down"))}, block=block)
    live = lambda x: F.when(F.col("__n") >= n, x)
    rsi = F.when(F.col("loss") == 0, 100.0).when(F.col("gain") == 0, 0.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss")))
    return out.withColumns({"rsi": live(rsi), "gain": live(F.col("gain")), "loss": live(F.col("loss"))}).drop("__move", "__n", "__up", "__down")


def adx(bars: DataFrame, n: int = 14, block: int = BLOCK) -> DataFrame:
    """``bars`` with ``adx`` (Wilder's smoothing, begun by the first bar); null until prices have moved."""
    w = Window.partitionBy("ticker").orderBy("session_no")
    before = {c: F.lag(c).over(w) for c in ("high", "low", "close")}
    b = bars.withColumns({f"__{c}": x for c, x in before.items()})
    up, down = F.coalesce(F.col("high") - F.col("__high"), F.lit(0.0)), F.coalesce(F.col("__low") - F.col("low"), F.lit(0.0))
    true = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__close")), F.abs(F.col("low") - F.col("__close")))
    first = F.col("__close").isNull()
    moved = {"__p": F.when((up > down) & (up > 0), up).otherwise(0.0), "__m": F.when((down > up) & (down > 0), down).otherwise(0.0), "__t": true}
    b = affine_scan(b, {f"{c}s": smooth(x, 1 / n, first) for c, x in moved.items()}, block=block)
    both = F.col("__ps") + F.col("__ms")
    dx = F.when((F.col("__ts") != 0) & (both != 0), 100 * F.abs(F.col("__ps") - F.col("__ms")) / both)
    b = b.withColumn("__dx", dx).withColumn("__seen", F.count("__dx").over(w))
    b = affine_scan(b, {"adx": smooth(F.col("__dx"), 1 / n, (F.col("__seen") <= 1) & F.col("__dx").isNotNull())}, block=block)
    return b.withColumn("adx", F.when(F.col("__seen") > 0, F.col("adx"))).drop("__high", "__low", "__close", "__ps", "__ms", "__ts", "__dx", "__seen")


def carried(stored: DataFrame, new: DataFrame, spans: tuple[int, ...] = (9, 20), block: int = BLOCK) -> DataFrame:
    """EMAs of ``new`` bars that go on from the ``stored`` values (``ticker``, ``ema_<span>``) of the bars before them; tickers without
    any begin with their first new price."""
    held = stored.select("ticker", *[F.col(f"ema_{s}").alias(f"__h{s}") for s in spans])
    b = new.join(held, "ticker", "left").withColumn("__first", _first("ticker", "session_no"))

    def go_on(s: int) -> tuple[Column, Column]:
        alpha, price = 2 / (s + 1), F.col("close")
        begun = F.when(F.col(f"__h{s}").isNull(), price).otherwise((1 - alpha) * F.col(f"__h{s}") + alpha * price)
        return F.when(F.col("__first"), 0.0).otherwise(1 - alpha), F.when(F.col("__first"), begun).otherwise(alpha * price)

    return affine_scan(b, {f"ema_{s}": go_on(s) for s in spans}, block=block).drop("__first", *[f"__h{s}" for s in spans])


#: SQL functions over an array of values, oldest first (nulls are passed over); registered for a session.
SQL_FUNCTIONS = {
    "ema_last": "(xs ARRAY<DOUBLE>, span INT) RETURNS DOUBLE RETURN aggregate(filter(xs, x -> x IS NOT NULL), CAST(NULL AS DOUBLE), (y, x) -> coalesce(y + (x - y) * 2 / (span + 1), x))",
    "wilder_last": "(xs ARRAY<DOUBLE>, n INT) RETURNS DOUBLE RETURN aggregate(filter(xs, x -> x IS NOT NULL), named_struct('k', 0, 'y', CAST(0 AS DOUBLE)), (s, x) -> named_struct('k', s.k + 1, 'y', CASE WHEN s.k < n THEN (s.y * s.k + x) / (s.k + 1) ELSE (s.y * (n - 1) + x) / n END), s -> CASE WHEN s.k >= n THEN s.y END)",
}


def register(spark) -> None:
    """``ema_last(values, span)`` and ``wilder_last(values, n)`` as SQL functions of the session."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
