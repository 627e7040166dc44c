"""Composite signals over a panel (ticker x date): each is a set of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import windows as W

#: Weights of the nine signals, and the confidence under which a signal does not count.
WEIGHTS = {"sentiment": 0.12, "technical": 0.13, "momentum": 0.18, "fundamental": 0.08, "event": 0.14, "volume": 0.08, "short_interest": 0.06, "options_iv": 0.14, "analyst": 0.07}
FLOOR = 0.15
#: The signals that a price panel can give.
PANEL = ("technical", "momentum", "volume")


def bands(x: Column, steps: list[tuple[float, float]], other: float, strict: bool = False) -> Column:
    """The value of the first limit that x reaches (exceeds); null stays null."""
    out = None
    for limit, value in steps:
        hit = x > limit if strict else x >= limit
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.when(x.isNotNull(), other)


#: Holding periods of the forward returns.
HORIZONS = (5, 10, 21, 63)


def panel(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Point-in-time features of every bar, and its forward returns: one exchange and one sort by ticker."""
    b = W.with_returns(W.dealt(bars))
    b = b.withColumns({"volume_ratio": W.volume_ratio(30), "slope": W.slope(), "accel": W.acceleration(), "vol": W.annual_vol(), **{f"fwd_{h}": W.forward(h) for h in horizons}})
    b = W.run_features(b.drop("open", "volume"), extremes=252, ready=True)
    rng = F.nullif(F.col("high_n") - F.col("low_n"), F.lit(0.0))
    b = b.withColumns({"position": (F.col("close") - F.col("low_n")) / rng, "from_high": F.col("close") / F.col("high_n") - 1, "signed_ratio": F.col("volume_ratio") * F.when(F.col("ret") < 0, -1).otherwise(1)})
    return b.drop("high", "low", "close", "high_n", "low_n")  # what follows moves all columns


#: What is ranked by date.
RANKED = ("position", "from_high", "signed_ratio", "slope", "accel")


def slim(features: DataFrame, wanted: Column | None) -> DataFrame:
    """``features`` as they are moved to their dates: ``volume_ratio`` follows from ``signed_ratio``, bands stand for what is only banded, and rows that
    are not ``wanted`` hold what is ranked alone."""
    d = banded(features).drop("volume_ratio", "rsi", "vol", "streak")
    if wanted is None:
        return d
    stay = ("ticker", "trade_date", "session_no", "n_returns", *RANKED)
    return d.withColumns({c: F.when(wanted, F.col(c)) for c in d.columns if c not in stay})


def ranked(features: DataFrame, names: list[str] = RANKED) -> DataFrame:
    """Rank of each feature among the date's tickers, in the wide form: one further exchange for any number."""
    return W.percentile_scores(features, {f"xs_{n}": (n, True) for n in names}, ["trade_date"])


def blended(df: DataFrame, values: dict[str, tuple[Column, str, float]]) -> DataFrame:
    """``scalars.blend`` of each value and rank (``name -> value, rank, weight``).  What a step uses twice is a column of the step
    before, as below: written into each other, the steps are more code than the JVM compiles, and run interpreted."""
    d = df.withColumns({f"{n}_abs": a for n, (a, _, _) in values.items()})
    d = d.withColumns({f"{n}_mix": w * F.col(x) + (1 - w) * F.col(f"{n}_abs") for n, (_, x, w) in values.items()})
    d = d.withColumns({f"{n}_mix": S.clamp(F.col(f"{n}_mix"), -1.0, 1.0) for n in values})
    d = d.withColumns({n: F.when(F.col(x).isNull(), F.col(f"{n}_abs")).otherwise(S.rounded(F.col(f"{n}_mix"), 4)) for n, (_, x, _) in values.items()})
    return d.drop(*[f"{n}_{k}" for n in values for k in ("abs", "mix")])


def mean_of(df: DataFrame, name: str, parts: dict[str, float]) -> DataFrame:
    """``name`` (``scalars.weighted_mean``) and ``__n`` (how many are there) of the columns ``parts`` (name -> weight), which go."""
    given = [(F.col(c), w) for c, w in parts.items()]
    top = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in given), F.lit(0.0))
    low = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for s, w in given), F.lit(0.0))
    d = df.withColumns({"__top": top, "__low": low, "__n": S.present([s for s, _ in given])}).drop(*parts)
    d = d.withColumn("__mean", F.when(F.col("__low") > 0, F.col("__top") / F.col("__low"))).withColumn("__mean", S.clamp(F.col("__mean"), -1.0, 1.0))
    return d.withColumn(name, F.round("__mean", 4)).drop("__top", "__low", "__mean")


#: The limits and values of the bands below are fixed values.
def technical(df: DataFrame) -> DataFrame:
    """With a ``rating`` (its value) where the rows have one."""
    rated = "rating" in df.columns
    d = blended(df, {
        "__a": (S.clamp((F.col("position") - 0.5) * 2, -1.0, 1.0), "xs_position", 0.65), **({"__c": (F.col("rating"), "xs_rating", 0.8)} if rated else {}),
        "__d": (S.clamp((F.col("from_high") + 0.10) / 0.20, -1.0, 1.0), "xs_from_high", 0.65),
    }).withColumn("__b", S.clamp(F.col("ret") / 5, -1.0, 1.0))
    d = mean_of(d, "technical", {"__a": 1.2, "__b": 0.6, **({"__c": 1.0} if rated else {}), "__d": 0.8})
    return d.withColumn("technical_conf", F.least(F.lit(1.0), F.col("__n") / 4)).drop("__n")


def banded(df: DataFrame) -> DataFrame:
    """The values of a few that ``momentum`` makes of ``rsi``, ``vol`` and ``streak``."""
    run = F.abs(F.col("streak"))
    return df.withColumns({
        "rsi_band": bands(F.col("rsi"), [(80, 0.1), (70, 0.5), (60, 0.4), (50, 0.15), (40, -0.15), (30, -0.4), (20, -0.5)], -0.1),
        "vol_band": F.when(F.col("vol") < 20, 0.3).when(F.col("vol") < 35, 0.1).when(F.col("vol") < 55, -0.1).when(F.col("vol").isNotNull(), -0.4),
        "run_band": F.signum(F.col("streak").cast("double")) * bands(run, [(5, 0.7), (4, 0.6), (3, 0.4), (2, 0.2)], 0.0),
    })


def momentum(df: DataFrame) -> DataFrame:
    """Of rows ``banded`` already, or not."""
    d = blended(df if "rsi_band" in df.columns else banded(df), {"__b": (S.clamp(F.col("slope") / 0.5, -1.0, 1.0), "xs_slope", 0.65), "__e": (S.clamp(F.col("accel") / 0.5, -1.0, 1.0), "xs_accel", 0.65)})
    some = F.col("n_returns") >= 5
    d = mean_of(d, "momentum", {"rsi_band": 1.5, "__b": 1.2, "vol_band": 0.8, "run_band": 0.9, "__e": 1.0}).drop("__n")
    return d.withColumn("momentum", F.when(some, F.col("momentum"))).withColumn("momentum_conf", F.when(some, F.least(F.lit(1.0), F.col("n_returns") / 60)).otherwise(0.0))


def volume(df: DataFrame) -> DataFrame:
    ratio = F.col("volume_ratio")
    s = bands(ratio, [(3, 1.0), (2, 0.7), (1.5, 0.4), (0.8, 0.0), (0.5, -0.2)], -0.4) * F.when(F.col("ret") < 0, -1).otherwise(1)
    return blended(df, {"volume_signal": (s, "xs_signed_ratio", 0.4)}).withColumn("volume_conf", F.when(ratio.isNotNull(), F.least(F.lit(1.0), F.abs(ratio - 1))))


def composite(df: DataFrame, signals: tuple[str, ...] = PANEL, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Confidence-weighted mean of the signals (columns ``<name>`` or ``<name>_signal``, and ``<name>_conf``) at or over the
    confidence floor.  ``coverage`` is the share of the full weight that stayed, ``possible`` that of all signals given.  Where
    no signal reaches the floor, ``score`` is null."""
    named = {k: F.col(f"{k}_signal") if f"{k}_signal" in df.columns else F.col(k) for k in signals}
    used = {k: c.isNotNull() & (F.col(f"{k}_conf") >= FLOOR) for k, c in named.items()}
    full = sum(weights.values())
    top = sum((F.when(used[k], c * weights[k] * F.col(f"{k}_conf")).otherwise(0.0) for k, c in named.items()), F.lit(0.0))
    low = sum((F.when(used[k], weights[k] * F.col(f"{k}_conf")).otherwise(0.0) for k in named), F.lit(0.0))
    cover = sum((F.when(used[k], F.lit(weights[k])).otherwise(0.0) for k in named), F.lit(0.0)) / full
    d = df.withColumns({"__mean": top / F.nullif(low, F.lit(0.0)), "coverage": F.round(cover, 3), "possible": F.lit(round(sum(weights[k] for k in signals) / full, 3))})
    d = d.withColumn("__mean", S.clamp(F.col("__mean"), -1.0, 1.0)).withColumn("score", F.round("__mean", 4)).drop("__mean")
    return d.withColumn("label", S.tradeability_label(F.col("score")))


def score_panel(bars: DataFrame, horizons: tuple[int, ...] = (), wanted: Column | None = None) -> DataFrame:
    """The composite of every bar (of those ``wanted``, ranked among all) with its signals and forward returns.  The signals lie behind
    a pass that parts them from the composite, as all in one are more code than the JVM compiles."""
    d = ranked(slim(panel(bars, horizons), wanted))
    d = d.withColumn("volume_ratio", F.col("signed_ratio") * F.when(F.col("ret") < 0, -1).otherwise(1))
    d = volume(momentum(technical(d if wanted is None else d.where(wanted))))
    signal = [c for k in PANEL for c in (f"{k}_signal" if k == "volume" else k, f"{k}_conf")]
    return composite(W.settled(d.select("ticker", "trade_date", "session_no", "n_returns", *signal, *[f"fwd_{h}" for h in horizons])))


def backtest(bars: DataFrame, first_session: int = 260, least_returns: int = 30) -> DataFrame:
    """The signal replayed on every bar with history enough, with its forward returns."""
    s = score_panel(bars, HORIZONS, (F.col("session_no") > first_session) & (F.col("n_returns") >= least_returns)).where("score IS NOT NULL")
    return s.select("ticker", "trade_date", "score", F.col("possible").alias("coverage"), F.replace("label", F.lit(" "), F.lit("_")).alias("label"), *[f"fwd_{h}" for h in HORIZONS])


def iv_rank(iv: DataFrame, days: int = 365, least: int = 20) -> DataFrame:
    """Rank and (strict) percentile of each day's IV within the days before it; a flat range ranks 50."""
    day = F.datediff("snapshot_date", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("ticker").orderBy("day").rangeBetween(-days, 0)
    lo, hi, n = F.min("iv").over(w), F.max("iv").over(w), F.count("iv").over(w)
    below = F.size(F.filter(F.collect_list("iv").over(w), lambda x: x < F.col("iv")))
    some = n >= least
    return iv.withColumn("day", day).select("ticker", "snapshot_date", "iv", lo.alias("low"), hi.alias("high"), F.when(some, F.when(hi - lo > 1e-9, (F.col("iv") - lo) / (hi - lo) * 100).otherwise(50.0)).alias("iv_rank"), F.when(some, below * 100.0 / n).alias("iv_percentile"), n.alias("days"))
