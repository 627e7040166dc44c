"""Time-series windows for each ticker, in session order.  All share one partitioning and order, so Spark plans one
exchange and one sort for any number of them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def order() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("session_no")


def settled(df: DataFrame) -> DataFrame:
    """``df`` behind an Arrow pass that does nothing: the optimizer does not copy what stands below it into what comes after."""
    return df.mapInArrow(lambda batches: batches, df.schema)


def last(n: int, end: int = 0) -> WindowSpec:
    """The n rows that end ``end`` rows before this one (0: here)."""
    return order().rowsBetween(-(n - 1) - end, -end)


def full(value: Column, n: int) -> Column:
    """``value`` where the last n rows are all there."""
    return F.when(F.count("close").over(last(n)) == n, value)


def ret(n: int, price: str = "close") -> Column:
    base = F.lag(price, n).over(order())
    return F.when(base != 0, F.col(price) / base - 1)


def with_returns(bars: DataFrame) -> DataFrame:
    """``ret``: the day's return in percent."""
    return bars.withColumn("ret", ret(1) * 100)


def sma(n: int) -> Column:
    return full(F.avg("close").over(last(n)), n)


def high_low(n: int = 252) -> dict[str, Column]:
    return {"high_n": F.max("high").over(last(n)), "low_n": F.min("low").over(last(n))}


def volume_ratio(n: int = 30) -> Column:
    return F.col("volume") / F.avg("volume").over(last(n))


def rvol(n: int = 20) -> Column:
    return full(F.col("volume") / F.avg("volume").over(last(n)), n)


def ends(bars: DataFrame, returns: tuple[int, ...] = (), averages: tuple[int, ...] = (), volumes: int = 0) -> DataFrame:
    """Each ticker's last row with ``n`` (its rows), and there ``ret_<k>``, ``sma_<k>`` and with ``volumes`` ``rvol``, as the windows above give them.
    One aggregation over the row's distance from the end: a window goes over its whole frame again for every row."""
    back = F.col("__back")
    b = bars.withColumn("__back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("session_no"))) - 1)
    at = lambda k, c: F.max(F.when(back == k, F.col(c)))
    seen = lambda k, c: F.when(back < k, F.col(c))
    whole = lambda k, value: F.when(F.count(seen(k, "close")) == k, value)
    out = [at(0, c).alias(c) for c in bars.columns if c != "ticker"] + [F.count("*").alias("n")]
    out += [F.when(at(k, "close") != 0, at(0, "close") / at(k, "close") - 1).alias(f"ret_{k}") for k in returns]
    out += [whole(k, F.avg(seen(k, "close"))).alias(f"sma_{k}") for k in averages]
    if volumes:
        out.append(whole(volumes, at(0, "volume") / F.avg(seen(volumes, "volume"))).alias("rvol"))
    return b.groupBy("ticker").agg(*out)


def rvol_prior(n: int = 20, least: int = 5) -> Column:
    """Against the mean of the n sessions before this one, if there are ``least``."""
    w = last(n, 1)
    return F.when(F.count("volume").over(w) >= least, F.col("volume") / F.avg("volume").over(w))


def slope(n: int = 14, least: int = 5) -> Column:
    """Least-squares slope of the last returns against their number."""
    w = last(n)
    return F.when(F.count("ret").over(w) >= least, F.regr_slope(F.col("ret"), F.col("session_no").cast("double")).over(w))


def acceleration(short: int = 5, long: int = 14) -> Column:
    return F.when(F.count("ret").over(last(long)) >= short, F.avg("ret").over(last(short)) - F.avg("ret").over(last(long)))


def annual_vol(n: int = 30, least: int = 10) -> Column:
    return F.when(F.count("ret").over(last(n)) >= least, F.stddev_samp("ret").over(last(n)) * math.sqrt(252))


def realized_vol(bars: DataFrame, n: int = 30, least: int = 9, name: str = "realized_vol") -> DataFrame:
    """Annualised deviation of the last n log returns."""
    logs = bars.withColumn("__log", F.log(F.col("close") / F.lag("close").over(order())))
    w = last(n)
    return logs.withColumn(name, F.when(F.count("__log").over(w) >= least, F.stddev_samp("__log").over(w) * math.sqrt(252))).drop("__log")


def _wilder(seen: np.ndarray, size: np.ndarray, period: int) -> np.ndarray:
    """RSI of each row of ``seen`` (returns, oldest first, right-aligned, ``size`` of them), all rows at once."""
    n, width = seen.shape
    gain, loss = np.maximum(seen, 0), np.maximum(-seen, 0)
    start = width - size
    at = np.arange(width)[None, :]
    first = (at >= start[:, None]) & (at < (start + period)[:, None])
    g, drop = (gain * first).sum(axis=1) / period, (loss * first).sum(axis=1) / period
    for k in range(period, width):
        on = k >= start + period
        g, drop = np.where(on, (g * (period - 1) + gain[:, k]) / period, g), np.where(on, (drop * (period - 1) + loss[:, k]) / period, drop)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(drop == 0, 100.0, np.where(g == 0, 0.0, 100 - 100 / (1 + g / drop)))
    return np.where(size > period, out, np.nan)


def _streak(seen: np.ndarray, have: np.ndarray, run: int) -> np.ndarray:
    """Signed run of up (zero counts) or down days at the end of each row of ``seen``, within its last ``have`` values."""
    tail = seen[:, ::-1][:, :run]
    up = tail[:, 0] >= 0
    same = ((tail >= 0) == up[:, None]) & (np.arange(tail.shape[1])[None, :] < have[:, None])
    length = np.where(same.all(axis=1), same.shape[1], np.argmin(same, axis=1))
    return np.where(have > 0, np.where(up, length, -length), np.nan)


def run_ends(df: DataFrame, returns: str, have: str, bars_seen: int = 120, period: int = 14, run: int = 14, block: int = 4096) -> DataFrame:
    """What ``run_features`` gives at a ticker's last row, from one row a ticker: ``returns`` is an array of those known of its last ``bars_seen``
    rows, oldest first, ``have`` says how many of them are of the last ``run`` rows.  Both columns go."""

    def add(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column(returns)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)
        seen = np.zeros((len(rows), bars_seen))
        seen[np.arange(bars_seen)[None, :] >= (bars_seen - size)[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        more = [pa.array(_wilder(seen, size, period), pa.float64(), from_pandas=True), pa.array(size.astype(np.int32), pa.int32())]
        more.append(pa.array(_streak(seen, rows.column(have).to_numpy(zero_copy_only=False), run), pa.int32(), from_pandas=True))
        kept = [n for n in rows.schema.names if n not in (returns, have)]
        return pa.RecordBatch.from_arrays([*[rows.column(n) for n in kept], *more], [*kept, "rsi", "n_returns", "streak"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), block):
                yield add(b.slice(lo, block))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(returns, have).schema)
    return df.mapInArrow(walk, f"{kinds}, rsi double, n_returns int, streak int")


def dealt(bars: DataFrame) -> DataFrame:
    """``bars`` dealt by ticker, in session order."""
    return bars.repartition("ticker").sortWithinPartitions("ticker", "session_no")


def run_features(bars: DataFrame, bars_seen: int = 120, period: int = 14, run: int = 14, block: int = 4096, extremes: int = 0, ready: bool = False) -> DataFrame:
    """``bars`` with ``rsi`` (Wilder's, over the last ``bars_seen`` returns), ``n_returns`` (how many of these there are) and
    ``streak`` (signed run of up, zero counts, or down days that ends here, within ``run`` returns); with ``extremes``, also
    ``high_n`` and ``low_n`` of so many sessions.  One Arrow pass in session order over blocks of rows, whatever their tickers: a
    block takes with it the rows that its first ticker still looks back on.  ``ready``: ``bars`` come ``dealt`` (windows on
    ``order()`` keep that)."""
    back = max(bars_seen, run, extremes)

    def seen_by(v: np.ndarray, start: np.ndarray, held: int, n: int) -> np.ndarray:
        """Of each row after the ``held`` ones, the last n values of its ticker, right-aligned."""
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), v]), n)[held:]
        at = np.arange(held, len(v))[:, None] - np.arange(n - 1, -1, -1)[None, :]
        return np.where(at >= start[held:, None], view, np.nan)

    def add(rows: pa.RecordBatch, held: int, start: np.ndarray, values: dict[str, np.ndarray]) -> pa.RecordBatch:
        seen = seen_by(values["ret"], start, held, bars_seen)
        known = ~np.isnan(seen)
        size = known.sum(axis=1)
        if not known[:, ::-1][np.arange(bars_seen)[None, :] < size[:, None]].all():  # gaps: close them up
            seen = np.take_along_axis(seen, np.argsort(known, axis=1, kind="stable"), axis=1)
        seen = np.where(np.arange(bars_seen)[None, :] >= (bars_seen - size)[:, None], seen, 0.0)
        rsi = _wilder(seen, size, period)
        streak = _streak(seen, np.minimum(run, known[:, ::-1][:, :run].sum(axis=1)), run)
        more = [("rsi", rsi, pa.float64()), ("n_returns", size.astype(np.int32), pa.int32()), ("streak", streak, pa.int32())]
        for name, column, best in (("high_n", "high", np.fmax), ("low_n", "low", np.fmin)) if extremes else ():
            more.append((name, best.reduce(seen_by(values[column], start, held, extremes), axis=1), pa.float64()))
        return pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(v, kind, from_pandas=True) for _, v, kind in more]], [*rows.schema.names, *[name for name, _, _ in more]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ret", "high", "low"] if extremes else ["ret"]
        last, before = None, {n: np.zeros(0) for n in names}
        for b in batches:
            for lo in range(0, len(b), block):
                rows = b.slice(lo, block)
                key = rows.column("ticker")
                one = key.cast(pa.string()).fill_null("\0").to_numpy(zero_copy_only=False)
                first = np.concatenate([[True], one[1:] != one[:-1]])
                go_on = last is not None and one[0] == last
                held = len(before["ret"]) if go_on else 0
                values = {n: np.concatenate([before[n][len(before[n]) - held :], rows.column(n).to_numpy(zero_copy_only=False).astype(float)]) for n in names}
                start = np.maximum.accumulate(np.where(first, np.arange(held, held + len(rows)), 0))
                if go_on:  # the first ticker began in the rows held
                    start = np.where(start == held, 0, start)
                start = np.concatenate([np.zeros(held, np.int64), start])
                yield add(rows, held, start, values)
                last, whence = one[-1], max(int(start[-1]), len(start) - back)
                before = {n: v[whence:] for n, v in values.items()}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema)
    sized = ", high_n double, low_n double" if extremes else ""
    return (bars if ready else dealt(bars)).mapInArrow(walk, f"{kinds}, rsi double, n_returns int, streak int{sized}")


def forward(n: int) -> Column:
    return F.lead("close", n).over(order()) / F.col("close") - 1


def support_resistance(bars: DataFrame, n: int = 14, k: int = 2) -> DataFrame:
    """Of the last n bars, those that top or bottom the k bars on each side: nearest above and below the close."""
    centred = order().rowsBetween(-k, k)
    whole = F.count("close").over(centred) == 2 * k + 1
    b = bars.withColumn("__top", F.when(whole & (F.col("high") == F.max("high").over(centred)), F.col("high"))).withColumn("__low", F.when(whole & (F.col("low") == F.min("low").over(centred)), F.col("low")))
    inner = order().rowsBetween(-(n - 1 - k), -k)  # bars whose k followers are inside the n
    tops, lows = F.collect_list("__top").over(inner), F.collect_list("__low").over(inner)
    return b.withColumn("resistance", F.array_min(F.filter(tops, lambda x: x > F.col("close")))).withColumn("support", F.array_max(F.filter(lows, lambda x: x < F.col("close")))).drop("__top", "__low")


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range of the last n bars; the first of them has no earlier close."""
    before = F.lag("close").over(order())
    true = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    b = bars.withColumn("__tr", true).withColumn("__hl", F.col("high") - F.col("low"))
    size, w = F.count("close").over(last(n)), last(n)
    rest = F.sum("__tr").over(w) - F.first("__tr").over(w) + F.first("__hl").over(w)
    return b.withColumn("atr", F.when(size < 2, 0.0).otherwise(rest / size)).drop("__tr", "__hl")


def percentile_last(column: str, n: int, least: int = 20) -> Column:
    """Share (in percent) of the last n values that are at most this one."""
    seen = F.collect_list(column).over(last(n))
    return F.when(F.size(seen) >= least, F.size(F.filter(seen, lambda x: x <= F.col(column))) * 100.0 / F.size(seen))


def percentile_score(value: Column, by: list[str], higher: bool = True, least: int = 6, digits: int = 4) -> Column:
    """Rank within the group with average ranks for ties, on [-1, 1]; null for fewer than ``least`` values, 0 where
    they are all equal.  Needs ``value`` to be a column expression of the row."""
    some = value.isNotNull()
    group = Window.partitionBy(*by)
    n = F.count(value).over(group)
    ordered = group.orderBy(value.asc_nulls_last())  # one sort gives both ends of a row of ties
    rank = F.rank().over(ordered) - 1
    ties = F.count(value).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - 1 - rank
    flat = F.min(value).over(group) == F.max(value).over(group)
    score = F.round(((rank + ties / 2) / (n - 1) * 2 - 1) * (1 if higher else -1), digits)
    return F.when(some & (n >= least), F.when(flat, 0.0).otherwise(score))


def percentile_scores(df: DataFrame, scores: dict[str, tuple[str, bool]], by: list[str], least: int = 6, digits: int = 4) -> DataFrame:
    """``df`` with a column for each of ``scores`` (name -> column, is more better): ``percentile_score`` for any number of
    columns in one Arrow pass over the groups, which are put together once.  A group is the basket of a day, so the
    instruments that are listed bound it."""

    def add(table: pa.Table) -> pa.Table:
        for name, (column, higher) in scores.items():
            known = table[column].is_valid().to_numpy(zero_copy_only=False)
            v = table[column].to_numpy(zero_copy_only=False).astype(float)[known]
            out = np.full(len(known), np.nan)
            if len(v) >= least:
                _, which, count = np.unique(v, return_inverse=True, return_counts=True)
                before = np.cumsum(count) - count
                out[known] = (((before + (count - 1) / 2) / (len(v) - 1) * 2 - 1) * (1 if higher else -1))[which] if len(count) > 1 else 0.0
            table = table.append_column(name, pa.array(out, pa.float64(), from_pandas=True))
        return table

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{name}` double" for name in scores])
    return df.groupBy(*by).applyInArrow(add, kinds).withColumns({name: F.round(name, digits) for name in scores})


def smoothers(bars: DataFrame, spans: tuple[int, ...] = (9, 20, 50), rsi: int = 14) -> DataFrame:
    """Recursive series (EMA seeded by the first close; RSI of price differences): one pass for each ticker in Arrow."""
    names = [f"ema_{s}" for s in spans]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session_no")
        out = pdf[["ticker", "session_no"]].copy()
        for s, name in zip(spans, names, strict=True):
            out[name] = pdf["close"].ewm(span=s, adjust=False).mean()
        d = pdf["close"].diff()
        gain, loss = d.clip(lower=0).ewm(alpha=1 / rsi, adjust=False).mean(), (-d.clip(upper=0)).ewm(alpha=1 / rsi, adjust=False).mean()
        out["rsi"] = 100 - 100 / (1 + gain / loss.where(loss != 0))
        return out

    kind = bars.schema["ticker"].dataType.simpleString()
    schema = f"ticker {kind}, session_no int, " + ", ".join(f"{n} double" for n in names) + ", rsi double"
    return bars.select("ticker", "session_no", "close").groupBy("ticker").applyInPandas(run, schema)
