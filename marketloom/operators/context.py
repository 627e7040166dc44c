"""Market context: rates, volatility regime, macro calendar, and the signals that a snapshot of a ticker gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def _or(*values: Column) -> Column:
    """The first value that is there and not 0, else the last (0 counts as missing)."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values[:-1]], values[-1])


def rates_changes(rates: DataFrame) -> DataFrame:
    """Ten-year changes over 5 and 20 observations in basis points and the curve; rows without both yields are no
    observations.  The calendar is one ordered series, a row for each day."""
    w = Window.orderBy("trade_date")
    change = lambda n: (F.col("ten_year") - F.lag("ten_year", n).over(w)) * 100
    return rates.where("two_year IS NOT NULL AND ten_year IS NOT NULL").withColumns({"change_5": change(5), "change_20": change(20), "curve": F.col("ten_year") - F.col("two_year")})


def rates_score(rates: DataFrame) -> DataFrame:
    move = -S.clamp(_or(F.col("change_20"), F.col("change_5"), F.lit(0.0)) / 50, -1.0, 1.0)
    return rates_changes(rates).withColumn("score", S.clamp(0.75 * move + 0.25 * S.clamp(F.col("curve"), -1.0, 1.0), -1.0, 1.0))


#: Upper limits of a volatility level, the score and the name of its band.
VOLATILITY_BANDS = ((15, 0.55, "CALM"), (20, 0.25, "NORMAL"), (30, -0.35, "ELEVATED"), (float("inf"), -0.85, "STRESSED"))


def volatility_regime(level: Column, ret5: Column, pct20: Column, pct1y: Column) -> dict[str, Column]:
    """Score, confidence and state from a level, its 5-day return in percent, and its percentiles (null: not known)."""
    score, band = F.lit(VOLATILITY_BANDS[-1][1]), F.lit(VOLATILITY_BANDS[-1][2])
    for limit, value, name in reversed(VOLATILITY_BANDS[:-1]):
        score, band = F.when(level < limit, value).otherwise(score), F.when(level < limit, name).otherwise(band)
    move = F.coalesce(ret5, F.lit(0.0))
    rank = F.coalesce(pct1y, _or(pct20, F.lit(50.0)))
    mixed = 0.55 * score - 0.30 * S.clamp(move / 25, -1.0, 1.0) - 0.15 * S.clamp((rank - 50) / 50, -1.0, 1.0)
    return {
        "score": S.clamp(mixed, -1.0, 1.0),
        "confidence": F.lit(0.65) + F.when(pct1y.isNotNull(), 0.20).otherwise(0.0) + F.when(ret5.isNotNull(), 0.15).otherwise(0.0),
        "state": F.concat(band, F.when(move > 3, "_RISING").when(move < -3, "_FALLING").otherwise("_FLAT")),
    }


def next_event(events: DataFrame, days: DataFrame, look: int = 50) -> DataFrame:
    """For each ``as_of`` of ``days`` (a calendar): of the next ``look`` events at or after it, the first of high importance,
    else the first.  Events of a day are few; days are joined with the days ahead that hold ``look`` events."""
    w = Window.orderBy("event_at", "id")
    ranked = events.withColumn("place", F.row_number().over(w))  # the calendar is one ordered series
    later = Window.orderBy("event_at", "place").rowsBetween(Window.currentRow, look - 1)
    high = F.min(F.when(F.col("importance") == "High", F.struct("place", "event_at", "id"))).over(later)
    named = ranked.withColumn("pick", F.coalesce(high, F.struct("place", "event_at", "id")))
    first = named.groupBy("event_at").agg(F.min_by("pick", "place").alias("pick"))
    union = days.select(F.col("as_of").alias("at"), F.lit(1).alias("ask"), F.lit(None).cast(first.schema["pick"].dataType).alias("pick")).unionByName(first.select(F.col("event_at").alias("at"), F.lit(0).alias("ask"), "pick"))
    ahead = F.first("pick", ignorenulls=True).over(Window.orderBy("at", F.desc("ask")).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return union.withColumn("pick", ahead).where("ask = 1").select(F.col("at").alias("as_of"), F.col("pick.id").alias("id"), F.col("pick.event_at").alias("event_at"))


def macro_risk(hours: Column) -> Column:
    return F.when(hours <= 6, 1.0).when(hours <= 24, 0.8).when(hours <= 48, 0.5).when(hours <= 72, 0.25).otherwise(0.0)


def regime_label(score: Column, risk: Column, volatility: Column) -> Column:
    base = F.when(score >= 0.45, "STRONG_RISK_ON").when(score >= 0.15, "RISK_ON").when(score <= -0.45, "STRONG_RISK_OFF").when(score <= -0.15, "RISK_OFF").otherwise("NEUTRAL")
    return F.concat(base, F.when((risk >= 0.5) | volatility.startswith("STRESSED"), "_CAUTION").otherwise(""))


def short_interest(ranked: Column | None = None) -> dict[str, Column]:
    """Squeeze against distribution, from days to cover and the share of the float (a share under 1 is no percent yet)."""
    days, share, up = F.col("short_ratio"), F.col("short_pct_float"), F.coalesce(F.col("change_pct"), F.lit(0.0)) > 0
    pct = F.when(share < 1, share * 100).otherwise(share)
    side = lambda a, b: F.when(up, a).otherwise(b)
    own = F.when(days >= 10, side(0.6, -0.5)).when(days >= 5, side(0.3, -0.2)).when(days >= 2, 0.0).when(days.isNotNull(), 0.1)
    held = F.when(pct >= 20, side(0.5, -0.4)).when(pct >= 10, side(0.2, -0.2)).when(pct.isNotNull(), 0.0)
    parts = [(own if ranked is None else S.blend(own, ranked, 0.4), 1.2), (held, 0.8)]
    return {"short_interest": S.weighted_mean(parts), "short_interest_conf": S.present([p for p, _ in parts]) / 2}


def analyst_view(mean_rank: Column | None = None, upside_rank: Column | None = None) -> dict[str, Column]:
    """Consensus (1 is best, 5 worst) and the way to the price target."""
    mean = S.clamp((3 - F.col("analyst_mean_score")) / 2, -1.0, 1.0)
    target, price = F.nullif(F.col("target_price"), F.lit(0.0)), F.when(F.col("price") > 0, F.col("price"))
    upside = S.clamp((target - price) / price * 100 / 20, -1.0, 1.0)
    parts = [(mean if mean_rank is None else S.blend(mean, mean_rank, 0.8), 1.5), (upside if upside_rank is None else S.blend(upside, upside_rank), 1.2)]
    return {"analyst": S.weighted_mean(parts), "analyst_conf": S.present([p for p, _ in parts]) / 2}


def options_iv(rank_confidence: Column) -> dict[str, Column]:
    """Volatility regime by rank, else by level (a level of 3 or less is no percent yet), less what a high beta explains."""
    rank, level, beta, change = F.col("iv_rank"), F.col("iv"), F.col("beta"), F.coalesce(F.col("change_pct"), F.lit(0.0))
    pct = F.when(level <= 3, level * 100).otherwise(level)
    by_rank = F.when(rank >= 80, -0.5).when(rank >= 60, -0.2).when(rank >= 40, 0.0).when(rank >= 20, 0.2).when(rank.isNotNull(), 0.4)
    by_level = F.when(pct < 20, 0.3).when(pct < 30, 0.1).when(pct < 45, -0.1).when(pct < 65, -0.3).when(pct.isNotNull(), -0.5)
    regime = F.coalesce(by_rank, by_level)
    adjusted = F.when(beta > 0, S.clamp(regime + S.clamp((beta - 1) * -0.1, -0.2, 0.2), -1.0, 1.0)).otherwise(regime)
    direction = F.when((pct < 30) & (change > 0), 0.2).when((pct > 50) & (change < -2), -0.3).otherwise(0.0)
    return {"options_iv": F.round(S.clamp(adjusted + direction, -1.0, 1.0), 4), "options_iv_conf": F.when(rank.isNotNull(), rank_confidence).when(level.isNotNull(), 0.25).otherwise(0.0)}


def sentiment_signal(raw_rank: Column | None = None, recency_rank: Column | None = None) -> dict[str, Column]:
    """From ``sentiment``, ``n_articles``, ``momentum``, ``outlets`` (null without fresh articles) and ``recency``."""
    raw, n = F.col("sentiment"), F.coalesce(F.col("n_articles"), F.lit(0))
    conf = F.when(raw.isNotNull(), F.least(F.lit(1.0), n / 15.0)).otherwise(0.0)
    held = raw * (0.4 + 0.6 * conf)
    diversity = F.least(F.lit(1.0), (F.col("outlets") - 1) / 3.0) * 0.5 * F.when(F.coalesce(raw, F.lit(0.0)) >= 0, 1).otherwise(-1)
    parts = [(held if raw_rank is None else S.blend(held, raw_rank), 1.5), (S.clamp(F.col("momentum") * 2.5, -1.0, 1.0), 1.0), (diversity, 0.4), (F.col("recency") if recency_rank is None else S.blend(F.col("recency"), recency_rank), 1.2)]
    k = S.present([p for p, _ in parts])
    return {"sentiment_signal": S.weighted_mean(parts), "sentiment_conf": F.when(k > 0, F.round(F.least(F.lit(1.0), (conf + F.least(F.lit(1.0), k / 4)) / 2), 3)).otherwise(0.0)}


def feedback(score: Column, n: Column, confidence: Column, multiplier: Column, significant: Column, enabled: bool = False, weight: float = 0.15, least: int = 30) -> dict[str, Column]:
    """The score scaled by measured accuracy, which is reported, and taken only where that is enabled and significant."""
    would = F.when(n >= least, F.round(S.clamp(score * S.clamp(1 + weight * confidence * multiplier, 0.5, 1.5), -1.0, 1.0), 4))
    return {"would_be": would, "adjusted": F.coalesce(F.when(significant, would), F.round(score, 4)) if enabled else F.round(score, 4)}
