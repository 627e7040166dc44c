"""European option values and Greeks as column arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .scalars import ERFC, norm_cdf, with_norm_cdf

RATE = 0.042


def _d1(spot: Column, strike: Column, t: Column, vol: Column, rate: float) -> Column:
    return (F.log(spot / strike) + (rate + vol * vol / 2) * t) / (vol * F.sqrt(t))


def price(spot: Column, strike: Column, t: Column, vol: Column, right: Column, rate: float = RATE) -> Column:
    """Black-Scholes; at or past expiry the intrinsic value, without volatility the discounted forward's."""
    call = right == "C"
    intrinsic = lambda k: F.when(call, F.greatest(spot - k, F.lit(0.0))).otherwise(F.greatest(k - spot, F.lit(0.0)))
    d1 = _d1(spot, strike, t, vol, rate)
    d2, discounted = d1 - vol * F.sqrt(t), strike * F.exp(-rate * t)
    value = F.when(call, spot * norm_cdf(d1) - discounted * norm_cdf(d2)).otherwise(discounted * norm_cdf(-d2) - spot * norm_cdf(-d1))
    return F.when(t <= 0, intrinsic(strike)).when(vol <= 0, intrinsic(discounted)).otherwise(value)


def with_delta(chain: DataFrame, spot: str = "underlying_price", strike: str = "strike", dte: str = "dte", iv: str = "iv", right: str = "opt_right", rate: float = RATE) -> DataFrame:
    """``chain`` with ``delta`` alone, for plans that need no other Greek: rows stay in their stage.  Null without a volatility, and at or past
    expiry."""
    t, vol = F.greatest(F.col(dte), F.lit(0)) / F.lit(365.0), F.col(iv)
    c = with_norm_cdf(chain.drop("delta"), "__n1", _d1(F.col(spot), F.col(strike), t, vol, rate))
    return c.withColumn("delta", F.when((t > 0) & (vol > 0), F.when(F.col(right) == "C", F.col("__n1")).otherwise(F.col("__n1") - 1))).drop("__n1")


#: What ``with_greeks`` adds.
GREEKS = ("price", "delta", "gamma", "theta", "vega", "rho", "prob_itm")


def _added(df: DataFrame, names: tuple[str, ...], work: Callable[[pa.RecordBatch], list[np.ndarray]], without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns of doubles that ``work`` gives for whole Arrow batches; NaN is null.  Columns of these names go, and behind the
    pass those of ``without``."""
    df = df.drop(*names)
    kept = [c for c in df.columns if c not in without]
    schema = StructType([StructField(c, df.schema[c].dataType) for c in kept] + [StructField(n, DoubleType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(all="ignore"):
                out = work(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(x, pa.float64(), from_pandas=True) for x in out]], [*kept, *names])

    return df.mapInArrow(run, schema)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]


def _is_call(batch: pa.RecordBatch, right: str) -> np.ndarray:
    return np.array(pc.equal(batch.column(right), "C").fill_null(False).to_pylist(), bool)


def with_greeks(chain: DataFrame, spot: str = "underlying_price", strike: str = "strike", dte: str = "dte", iv: str = "iv", right: str = "opt_right", rate: float = RATE) -> DataFrame:
    """Price, delta, gamma, theta (a calendar day), vega (a volatility point), rho (1 %), probability in the money, in one Arrow
    pass.  Rows without a volatility have nulls; at or past expiry only the price, the intrinsic value, is known."""

    def work(batch: pa.RecordBatch) -> list[np.ndarray]:
        return _greeks(*_numbers(batch, spot, strike, dte, iv), _is_call(batch, right), rate)

    return _added(chain, GREEKS, work)


def with_list_greeks(df: DataFrame, column: str, target: str, usable: tuple[float, float], spot: str = "underlying_price", strike: str = "strike", dte: str = "dte", iv: str = "iv", right: str = "opt_right", names: tuple[str, ...] = ("delta", "theta", "vega"), block: int = 1024, rate: float = RATE) -> DataFrame:
    """``df`` whose arrays of options ``column`` (structs) have ``names`` of GREEKS too; volatilities over ``usable[0]`` and up to ``usable[1]`` stay, others
    are those that give ``target``, if any.  Rows stay where they are; a null array becomes an empty one."""
    kept = [f for f in df.schema[column].dataType.elementType if f.name not in (iv, *names)]
    element = StructType([*[StructField(f.name, f.dataType) for f in kept], *[StructField(n, DoubleType()) for n in (iv, *names)]])
    schema = StructType([StructField(f.name, ArrayType(element) if f.name == column else f.dataType) for f in df.schema])

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(column)
        rows = pa.RecordBatch.from_struct_array(lists.flatten())
        s, k, days, v, p = _numbers(rows, spot, strike, dte, iv, target)
        call = _is_call(rows, right)
        with np.errstate(all="ignore"):
            quoted = (v > usable[0]) & (v <= usable[1])
            v = np.where(quoted, v, _implied(np.where(quoted, np.nan, p), s, k, days / 365, call, rate=rate))
            known = dict(zip(GREEKS, _greeks(s, k, days, v, call, rate), strict=True))
        new = [pa.array(x, pa.float64(), from_pandas=True) for x in (v, *[known[n] for n in names])]
        flat = pa.StructArray.from_arrays([*[rows.column(f.name) for f in kept], *new], [*[f.name for f in kept], iv, *names])
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)
        return pa.RecordBatch.from_arrays([out if n == column else batch.column(n) for n in batch.schema.names], batch.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), block):
                yield add(b.slice(lo, block))

    return df.mapInArrow(run, schema)


def with_values(df: DataFrame, name: str, spot: str, strike: str, years: str, vol: str, right: str, rate: float = RATE) -> DataFrame:
    """``df`` with the model value of each row's option as ``name``; the intrinsic value at or past expiry."""

    def work(batch: pa.RecordBatch) -> list[np.ndarray]:
        s, k, t, v = _numbers(batch, spot, strike, years, vol)
        call = _is_call(batch, right)
        value = _value(s, k, t, v, call, rate)
        return [np.where(t <= 0, np.where(call, np.maximum(s - k, 0), np.maximum(k - s, 0)) + 0 * v, value)]

    return _added(df, (name,), work)


def with_leg_values(df: DataFrame, spots: dict[str, str], strikes: str, vols: str, signs: str, calls: str, years: str, rate: float = RATE) -> DataFrame:
    """``df`` with a column for each of ``spots`` (name -> column of a price): the model values of the row's options times their signs, added up; the
    intrinsic value at or past expiry.  The options stand side by side in four arrays of doubles, which go; one without a value
    does not count, and a row without any has null.  Rows stay where they are."""
    lists, df = (strikes, vols, signs, calls), df.drop(*spots)

    def work(batch: pa.RecordBatch) -> list[np.ndarray]:
        n, (t,) = batch.num_rows, _numbers(batch, years)
        owner = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(batch.column(strikes)), 0).to_numpy(zero_copy_only=False))
        k, v, sign, call = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False).astype(float) for c in lists)
        call, t, out = call > 0, t[owner], []
        for (s,) in (_numbers(batch, c) for c in spots.values()):
            s = s[owner]
            worth = sign * np.where(t <= 0, np.where(call, np.maximum(s - k, 0), np.maximum(k - s, 0)) + 0 * v, _value(s, k, t, v, call, rate))
            some = ~np.isnan(worth)
            out.append(np.where(np.bincount(owner[some], minlength=n) > 0, np.bincount(owner[some], worth[some], n), np.nan))
        return out

    return _added(df, tuple(spots), work, lists)


def _normal(x: np.ndarray) -> np.ndarray:
    """Normal distribution function, with the same rational approximation as ``norm_cdf``."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    tail = 0.5 * t * np.exp(-z * z + np.polyval(ERFC, t))
    return np.where(x >= 0, 1 - tail, tail)


def _greeks(s: np.ndarray, k: np.ndarray, days: np.ndarray, v: np.ndarray, call: np.ndarray, rate: float) -> list[np.ndarray]:
    t = np.maximum(days, 0) / 365
    root = np.sqrt(t)
    d1 = (np.log(s / k) + (rate + v * v / 2) * t) / (v * root)
    d2, disc = d1 - v * root, np.exp(-rate * t)
    n1, n2, density = _normal(d1), _normal(d2), np.exp(-d1 * d1 / 2) / 2.5066282746310002
    flat = lambda strikes: np.where(call, np.maximum(s - strikes, 0), np.maximum(strikes - s, 0))
    value = np.where(call, s * n1 - k * disc * n2, k * disc * (1 - n2) - s * (1 - n1))
    value = np.where(t <= 0, flat(k), np.where(v <= 0, flat(k * disc), value))
    decay = -s * density * v / (2 * root)
    live = (t > 0) & (v > 0)
    greeks = [
        np.where(call, n1, n1 - 1), density / (s * v * root), np.where(call, decay - rate * k * disc * n2, decay + rate * k * disc * (1 - n2)) / 365,
        s * density * root / 100, np.where(call, k * t * disc * n2, -k * t * disc * (1 - n2)) / 100, np.where(call, n2, 1 - n2),
    ]
    return [value + 0 * v, *[np.where(live, x, np.nan) for x in greeks]]


def _implied(p: np.ndarray, s: np.ndarray, k: np.ndarray, t: np.ndarray, call: np.ndarray, steps: int = 100, tol: float = 1e-6, rate: float = RATE) -> np.ndarray:
    """See ``with_implied_vol``; NaN where there is none."""
    ok = (t > 0) & (s > 0) & (k > 0) & (p > 0) & (p >= np.maximum(0, np.where(call, s - k, k - s)) - tol)
    ok &= _value(s, k, t, np.full(len(p), 5.0), call, rate) >= p
    at = np.flatnonzero(ok)
    out, lo, hi = np.full(len(p), np.nan), np.full(len(p), 1e-4), np.full(len(p), 5.0)
    for _ in range(steps):
        if not len(at):
            break
        mid = (lo[at] + hi[at]) / 2
        value = _value(s[at], k[at], t[at], mid, call[at], rate)
        out[at] = mid
        high = value > p[at]
        hi[at], lo[at] = np.where(high, mid, hi[at]), np.where(high, lo[at], mid)
        at = at[np.abs(value - p[at]) >= tol]
    out[at] = (lo[at] + hi[at]) / 2
    return out


def _value(s: np.ndarray, k: np.ndarray, t: np.ndarray, v: np.ndarray, call: np.ndarray, rate: float) -> np.ndarray:
    root = v * np.sqrt(t)
    d1 = (np.log(s / k) + (rate + v * v / 2) * t) / root
    own, owed = s * _normal(d1), k * np.exp(-rate * t) * _normal(d1 - root)
    return np.where(call, own - owed, own - owed - s + k * np.exp(-rate * t))


def with_implied_vol(chain: DataFrame, target: str, spot: str = "underlying_price", strike: str = "strike", years: str = "t", right: str = "opt_right", name: str = "found", steps: int = 100, tol: float = 1e-6, rate: float = RATE) -> DataFrame:
    """``chain`` with the volatility in [1e-4, 5] at which the model gives ``target``: bisection until the value is within
    ``tol`` or ``steps`` are done, for a whole Arrow batch at once.  Null for prices of 0 or less, at or past expiry, under the
    intrinsic value, and over the value at the upper end."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chain.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, s, k, t = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (target, spot, strike, years))
            call = np.array(pc.equal(batch.column(right), "C").fill_null(False).to_pylist(), bool)
            with np.errstate(all="ignore"):
                out = _implied(p, s, k, t, call, steps, tol, rate)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64(), from_pandas=True)], [*batch.schema.names, name])

    return chain.mapInArrow(run, f"{kinds}, {name} double")
