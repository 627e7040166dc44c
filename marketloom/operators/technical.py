"""Trend states of a ticker: directional index, index trend, technical opportunity, setup quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import windows as W


def trend_series(bars: DataFrame, spans: tuple[int, ...] = (20, 50, 200), n: int = 14) -> DataFrame:
    """EMAs of the close and ``adx`` (Wilder's smoothing, seeded by the first bar), one Arrow pass for each ticker, whose
    history one task holds (its sessions bound it).  ``adx`` is null until prices have moved."""
    names = [f"ema_{s}" for s in spans]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session_no")
        out = pdf[["ticker", "session_no"]].copy()
        for s, name in zip(spans, names, strict=True):
            out[name] = pdf["close"].ewm(span=s, adjust=False).mean()
        before = pdf["close"].shift()
        ranges = pd.concat([pdf["high"] - pdf["low"], (pdf["high"] - before).abs(), (pdf["low"] - before).abs()], axis=1).max(axis=1)
        up, down = pdf["high"].diff().fillna(0.0), -pdf["low"].diff().fillna(0.0)
        moved = pd.DataFrame({"up": up.where((up > down) & (up > 0), 0.0), "down": down.where((down > up) & (down > 0), 0.0), "range": ranges})
        m = moved.ewm(alpha=1 / n, adjust=False).mean()
        both = m["up"] + m["down"]
        dx = (100 * (m["up"] - m["down"]).abs() / both).where((m["range"] != 0) & (both != 0))
        out["adx"] = dx.ewm(alpha=1 / n, adjust=False).mean()
        return out

    kind = bars.schema["ticker"].dataType.simpleString()
    schema = f"ticker {kind}, session_no int, " + ", ".join(f"{x} double" for x in names) + ", adx double"
    return bars.select("ticker", "session_no", "high", "low", "close").groupBy("ticker").applyInPandas(run, schema)


def _smoothed(x: np.ndarray, alpha: np.ndarray | float) -> Iterator[np.ndarray]:
    """The exponential means of the columns of ``x``, row by row, as pandas has them (first value as seed, gaps weigh less)."""
    mean, old = np.full(x.shape[1], np.nan), np.ones(x.shape[1])
    for now in x:
        known, begun = ~np.isnan(now), ~np.isnan(mean)
        old = np.where(begun, old * (1 - alpha), 1.0)
        mean = np.where(begun, np.where(known & (mean != now), (old * mean + alpha * now) / (old + alpha), mean), now)
        old = np.where(known, 1.0, old)
        yield mean


def trend_ends(bars: DataFrame, spans: tuple[int, ...] = (20, 50, 200), n: int = 14, block: int = 1 << 16, most: int = 1 << 20) -> DataFrame:
    """The last row of each ticker's ``trend_series``.  Whole tickers go by in session order, as many as ``block`` rows hold, and are worked
    out side by side, one a column; ``most`` bounds the cells of such a table."""
    names = [f"ema_{s}" for s in spans]
    alphas = np.array([2 / (s + 1) for s in spans] + [1 / n] * 3)

    def side_by_side(high: np.ndarray, low: np.ndarray, close: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Columns of ``names`` and ``adx``, a row for each ticker."""
        gap = np.full((1, close.shape[1]), np.nan)
        before = np.concatenate([gap, close[:-1]])
        ranges = np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before))
        step = lambda v: np.nan_to_num(v - np.concatenate([gap, v[:-1]]))
        up, down = step(high), -step(low)
        moved = [np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0), ranges]
        wide = np.concatenate([close] * len(spans) + [np.where(inside, m, np.nan) for m in moved], axis=1)
        t, dx, last = close.shape[1], np.full(close.shape, np.nan), np.full(wide.shape[1], np.nan)
        for k, last in enumerate(_smoothed(wide, np.repeat(alphas, t))):
            plus, minus, spread = (last[(len(spans) + i) * t : (len(spans) + i + 1) * t] for i in range(3))
            dx[k] = np.where(inside[k] & (spread != 0) & ~np.isnan(spread) & (plus + minus != 0), 100 * np.abs(plus - minus) / (plus + minus), np.nan)
        *_, adx = _smoothed(dx, 1 / n)
        return np.column_stack([*[last[i * t : (i + 1) * t] for i in range(len(spans))], adx])

    def worked(rows: pa.Table) -> pa.RecordBatch:
        key = rows.column("ticker").combine_chunks()
        one = key.cast(pa.string()).fill_null("\0").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
        size = np.diff(np.append(starts, len(one)))
        values = [rows.column(c).to_numpy().astype(float) for c in ("high", "low", "close")]
        out, by_size, lo = np.full((len(size), len(spans) + 1), np.nan), np.argsort(-size, kind="stable"), 0
        while lo < len(size):
            longest = size[by_size[lo]]
            which = by_size[lo : lo + max(1, most // longest)]
            inside = np.arange(longest)[:, None] < size[which][None, :]
            at = np.where(inside, starts[which][None, :] + np.arange(longest)[:, None], 0)
            out[which] = side_by_side(*[np.where(inside, v[at], np.nan) for v in values], inside)
            lo += len(which)
        return pa.RecordBatch.from_arrays([key.take(pa.array(starts)), *[pa.array(c, pa.float64(), from_pandas=True) for c in out.T]], ["ticker", *names, "adx"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        with np.errstate(all="ignore"):
            for b in batches:
                t = pa.Table.from_batches([b])
                held = t if held is None else pa.concat_tables([held, t])
                if len(held) >= block:
                    key = held.column("ticker").combine_chunks()
                    one = key.cast(pa.string()).fill_null("\0").to_numpy(zero_copy_only=False)
                    begins = np.flatnonzero(one != one[-1])
                    if len(begins):
                        yield worked(held.slice(0, int(begins[-1]) + 1))
                        held = held.slice(int(begins[-1]) + 1)
            if held is not None and len(held):
                yield worked(held)

    kind = bars.schema["ticker"].dataType.simpleString()
    return W.dealt(bars.select("ticker", "session_no", "high", "low", "close")).mapInArrow(run, f"ticker {kind}, " + ", ".join(f"{x} double" for x in names) + ", adx double")


def _panel(bars: DataFrame) -> DataFrame:
    """Last row of each ticker with its returns in percent, relative volume and trend series."""
    ends = W.ends(bars, returns=(5, 20, 60), averages=(200,), volumes=20)
    return ends.withColumns({f"ret_{k}": F.col(f"ret_{k}") * 100 for k in (5, 20, 60)}).join(trend_ends(bars), "ticker")


def index_trend(bars: DataFrame, least: int = 60) -> DataFrame:
    """Vote of level, alignment and momentum in [-1, 1] at each ticker's last bar; no score under ``least`` bars."""
    p = _panel(bars)

    def vote(cond: Column) -> Column:
        return F.when(cond, 1.0).when(~cond, -1.0)

    close = F.col("close")
    e20, e50, e200 = (F.when(F.col("n") >= s, F.col(f"ema_{s}")) for s in (20, 50, 200))
    parts = [
        (vote(close > e20), 0.25), (vote(close > e50), 0.20), (vote(e20 > e50), 0.20), (vote(e50 > e200), 0.15),
        (S.clamp(F.col("ret_20") / 10, -1.0, 1.0), 0.10), (S.clamp(F.col("ret_60") / 20, -1.0, 1.0), 0.10),
    ]
    weight = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in parts), F.lit(0.0))
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts), F.lit(0.0))
    enough = F.col("n") >= least
    return p.select(
        "ticker", "session_no", F.when(enough, S.clamp(total / F.nullif(weight, F.lit(0.0)), -1.0, 1.0)).alias("score"),
        F.when(enough, F.least(weight, F.lit(1.0))).otherwise(0.0).alias("confidence"),
    )


def technical_opportunity(bars: DataFrame, benchmarks: tuple[int, int] = (1, 2), least: int = 30) -> DataFrame:
    """States at each ticker's last bar; relative strength is against the two benchmark tickers."""
    p = _panel(bars)
    close, e20, e50, s200 = (F.col(c) for c in ("close", "ema_20", "ema_50", "sma_200"))
    strong = F.when(F.col("adx") >= 25, F.lit("STRONG ")).otherwise(F.lit(""))
    up = (close > e20) & (e20 > e50) & (s200.isNull() | (e50 > s200))
    down = (close < e20) & (e20 < e50) & (s200.isNull() | (e50 < s200))
    m20 = F.coalesce("ret_20", F.lit(0.0))
    accel = F.col("ret_5") - F.col("ret_20") / 4
    # a window by ticker lets the filter pass below it, so only the benchmarks' bars are read again
    bench = bars.withColumn("r", W.ret(20) * 100).where(F.col("ticker").isin(*benchmarks)).groupBy("ticker").agg(F.max_by("r", "session_no").alias("r"))
    rs, rvol = F.col("ret_20") - bench.agg(F.avg("r")).scalar(), F.col("rvol")
    known = lambda x: F.when(F.col("n") >= least, x).otherwise("UNKNOWN")
    return p.select(
        "ticker", "session_no", "adx", "rvol",
        known(F.when(up, F.concat(strong, F.lit("BULL"))).when(down, F.concat(strong, F.lit("BEAR"))).otherwise("MIXED")).alias("trend_state"),
        known(F.when(accel.isNull(), "UNKNOWN").when((accel > 1) & (m20 > 0), "ACCELERATING BULLISH").when((accel < -1) & (m20 < 0), "ACCELERATING BEARISH")
              .when(m20 > 0, "POSITIVE").when(m20 < 0, "NEGATIVE").otherwise("FLAT")).alias("momentum_state"),
        known(F.when(rs >= 5, "STRONG").when(rs >= 1, "POSITIVE").when(rs <= -5, "WEAK").when(rs <= -1, "LAGGING").otherwise("NEUTRAL")).alias("strength_state"),
        known(F.when(rvol >= 1.5, "CONFIRMED").when(rvol >= 1.1, "ABOVE AVERAGE").when(rvol < 0.8, "WEAK").otherwise("NORMAL")).alias("volume_state"),
    )


def setup_quality(df: DataFrame) -> DataFrame:
    """Points of 0 to 100 with label, strengths and risks (four of each kept), from score, coverage, the technical
    states, iv_pct and event_days (no lower bound: past events count as near)."""
    score, coverage = F.abs(F.coalesce("score", F.lit(0.0))), F.col("coverage")
    strengths = [
        F.when(score >= 0.4, "Strong directional signal"), F.when(coverage >= 0.7, "High signal coverage"),
        F.when(F.col("trend_state").contains("STRONG"), F.concat(F.initcap("trend_state"), F.lit(" trend"))),
        F.when(F.col("momentum_state").contains("ACCELERATING"), F.initcap("momentum_state")), F.when(F.col("volume_state") == "CONFIRMED", "Volume confirms move"),
        F.when(F.col("strength_state") == "STRONG", "Strong relative strength"), F.when(F.col("iv_pct") < 40, "Relatively inexpensive IV"),
    ]
    risks = [F.when(coverage < 0.45, "Low signal coverage"), F.when(F.col("iv_pct") > 80, "Very high IV / rich premium"),
             F.when(F.col("event_days") <= 7, F.concat(F.lit("Event/earnings risk in "), F.col("event_days"), F.lit("d")))]
    good, bad = (F.filter(F.array(*x), lambda v: v.isNotNull()) for x in (strengths, risks))
    points = S.clamp(50 + 35 * score + 10 * (F.coalesce(F.nullif(coverage, F.lit(0.0)), F.lit(0.5)) - 0.5) + 4 * F.size(good) - 5 * F.size(bad), 0.0, 100.0)
    return df.withColumns({"points": points, "strengths": F.slice(good, 1, 4), "risks": F.slice(bad, 1, 4)}).withColumn(
        "label", F.when(F.col("points") >= 75, "HIGH").when(F.col("points") >= 55, "MODERATE").otherwise("LOW"))
