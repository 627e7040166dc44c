"""The basket pipeline: the sides of a ticker in one row, features ranked across the basket, nine signals, their composite.

Each side is one row for each ticker, made by an aggregation or a window on ``ticker``, so the joins of the sides ask for no
exchange of their own beyond what the sides need; the ranks take one further exchange, by ``as_of``, and are the barrier
behind which the signals are worked out.  Tickers without a side have nulls there, and a signal without data has confidence 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import context as C
from . import joins as J
from . import signals as M
from . import structures as O
from . import windows as W

#: Features that are ranked across the basket, and whether more is better.
RANKED = {
    "position": True, "from_high": True, "rating": True, "mean_inverted": True, "upside": True, "pe": False,
    "slope": True, "accel": True, "sentiment": True, "recency": True, "signed_ratio": True, "squeeze": True,
}
#: Articles and reports that are looked at, and the days in which an article is fresh and a score is history.
ARTICLES, REPORTS, SURPRISES, FRESH_DAYS, HISTORY_DAYS = 50, 8, 4, 7, 14


# --- sides ---------------------------------------------------------------------------------------------------------------


def market_side(bars: DataFrame, sessions: int = 253) -> DataFrame:
    """Price and price features at each ticker's last session, from the last ``sessions``: more than any of them looks back.  One sort from
    the end and one aggregation by the distance from it, so a task holds a row of each ticker and no window's frames."""
    w = Window.partitionBy("ticker").orderBy(F.desc("session_no"))
    b = bars.select("ticker", "session_no", "high", "low", "close", "volume", (F.row_number().over(w) - 1).alias("back"), F.lead("close").over(w).alias("before")).where(F.col("back") < sessions)
    b = b.withColumn("ret", F.round(F.when(F.col("before") != 0, F.col("close") / F.col("before") - 1) * 100, 4))
    at = lambda c: F.max(F.when(F.col("back") == 0, F.col(c)))
    last = lambda n, c="ret": F.when(F.col("back") < n, F.col(c))
    some = lambda n, least, value: F.when(F.count(last(n)) >= least, value)
    known = F.transform(F.sort_array(F.collect_list(F.when(last(120).isNotNull(), F.struct(-F.col("back"), "ret")))), lambda x: x["ret"])
    g = b.groupBy("ticker").agg(
        at("close").alias("price"), F.max(last(252, "high")).alias("week_52_high"), F.min(last(252, "low")).alias("week_52_low"), at("ret").alias("change_pct"),
        (at("volume") / F.avg(last(30, "volume"))).alias("volume_ratio"), some(14, 5, F.regr_slope(last(14), F.col("session_no").cast("double"))).alias("slope"),
        some(14, 5, F.avg(last(5)) - F.avg(last(14))).alias("accel"), some(30, 10, F.stddev_samp(last(30)) * math.sqrt(252)).alias("vol"), known.alias("__known"), F.count(last(14)).alias("__have"),
    )
    return W.run_ends(g, "__known", "__have")


def article_side(articles: DataFrame, as_of: str, tau_hours: float = 48.0) -> DataFrame:
    """``outlets`` and ``recency`` (decayed mean sentiment) of the fresh ones among each ticker's newest articles; articles without
    a time are not fresh, and one of the future has no age.  Means have six digits, so that equal ones are ties."""
    now = F.lit(as_of).cast("timestamp")
    a = J.latest_n(articles.where("published_at IS NOT NULL"), ["ticker"], [F.desc("published_at"), F.desc("id")], ARTICLES)
    a = a.where(F.col("published_at") >= now - F.expr(f"INTERVAL {FRESH_DAYS} DAYS"))
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp("published_at")) / 3600.0)
    w = F.when(F.col("sentiment").isNotNull(), F.exp(-age / tau_hours))
    mean = S.clamp(F.try_divide(F.sum(F.col("sentiment") * w), F.sum(w)), -1.0, 1.0)
    return a.groupBy("ticker").agg(F.size(F.collect_set(F.coalesce("source", F.lit("unknown")))).alias("outlets"), F.round(mean, 6).alias("recency"))


def score_side(scores: DataFrame, day: str = "prediction_date") -> DataFrame:
    """``momentum``: the last score less the third-last (or the first there is) of the days before each ticker's last score; a lone
    score has none."""
    s = J.latest_n(scores.select("ticker", day, "score"), ["ticker"], [F.desc(day)], 3)
    seen = F.sort_array(F.collect_list(F.struct(F.col(day).alias("day"), "score")))
    recent = F.filter(F.col("seen"), lambda x: F.datediff(F.element_at("seen", -1)["day"], x["day"]) <= HISTORY_DAYS)
    r = s.groupBy("ticker").agg(seen.alias("seen")).select("ticker", recent.alias("recent"))
    return r.select("ticker", F.when(F.size("recent") >= 2, F.element_at("recent", -1)["score"] - F.element_at("recent", 1)["score"]).alias("momentum"))


def earnings_side(reports: DataFrame, as_of: str, tie: str = "seq") -> DataFrame:
    """Of each ticker's newest reports: ``next_report``, ``last_surprise`` (of the newest with a result, null if it has no
    surprise), and over the last few surprises ``n_surprises``, ``mean_surprise`` and ``beat_share``."""
    e = J.latest_n(reports.where("report_date IS NOT NULL"), ["ticker"], [F.desc("report_date"), F.desc(tie)], REPORTS)
    e = e.withColumn("surprise", S.surprise_pct(F.col("eps_actual"), F.col("eps_estimate")))
    known = F.when(F.col("surprise").isNotNull(), F.struct("report_date", tie, "surprise"))
    g = e.groupBy("ticker").agg(
        F.min(F.when(F.col("report_date") >= F.lit(as_of).cast("date"), F.col("report_date"))).alias("next_report"),
        F.max_by("surprise", F.when(F.col("eps_actual").isNotNull(), F.struct("report_date", tie))).alias("last_surprise"),
        F.slice(F.sort_array(F.collect_list(known), asc=False), 1, SURPRISES).alias("known"),
    )
    n, over = F.size("known"), lambda f: F.aggregate("known", F.lit(0.0), lambda s, x: s + f(x["surprise"]))
    some = lambda x: F.when(n > 0, F.try_divide(x, n))
    return g.select("ticker", "next_report", "last_surprise", n.alias("n_surprises"), some(over(lambda x: x)).alias("mean_surprise"), some(over(lambda x: F.when(x > 0, 1.0).otherwise(0.0))).alias("beat_share"))


def gather(basket: DataFrame, as_of: str, *sides: DataFrame) -> DataFrame:
    """One row for each ticker of ``basket`` with the columns of all ``sides`` (unique by ticker); what a side does not hold is null."""
    out = basket.select("ticker").distinct().withColumn("as_of", F.lit(as_of).cast("date"))
    for side in sides:
        out = out.join(side, "ticker", "left")
    return out


# --- features and ranks --------------------------------------------------------------------------------------------------


def features(df: DataFrame) -> DataFrame:
    """Raw values to be ranked.  A price, limit, target, ratio or mean of 0 counts as missing, as does a P/E that is not over
    0.  An unchanged price counts as up for the volume and as down for the squeeze."""
    there = lambda c: F.nullif(F.col(c), F.lit(0.0))
    price, high, low, change = there("price"), there("week_52_high"), there("week_52_low"), F.coalesce("change_pct", F.lit(0.0))
    return df.withColumns({
        "position": F.when(high > low, (price - low) / (high - low)), "from_high": F.when(high > 0, (price - high) / high),
        "rating": S.rating_value(F.col("analyst_rating")), "mean_inverted": 3.0 - there("analyst_mean_score"),
        "upside": F.when(price > 0, (there("target_price") - price) / price * 100), "pe": F.when(F.col("pe_ratio") > 0, F.col("pe_ratio").cast("double")),
        "signed_ratio": there("volume_ratio") * F.when(change >= 0, 1).otherwise(-1), "squeeze": there("short_ratio") * F.when(change > 0, 1).otherwise(-1),
    })


def ranked(df: DataFrame) -> DataFrame:
    """``xs_<feature>`` within the ``as_of``; null in baskets (or features) of fewer than six values."""
    return W.percentile_scores(df, {f"xs_{n}": (n, more) for n, more in RANKED.items()}, ["as_of"])


def unranked(df: DataFrame) -> DataFrame:
    """No ranks: for tickers outside a basket, which absolute limits alone judge."""
    return df.withColumns({f"xs_{n}": F.lit(None).cast("double") for n in RANKED})


# --- signals -------------------------------------------------------------------------------------------------------------


#: The limits and values of the two below are fixed values.
def fundamental() -> dict[str, Column]:
    """Valuation, and the size and share of the last surprises that beat."""
    pe = F.col("pe")
    band = F.when(pe < 15, 0.6).when(pe < 25, 0.2).when(pe < 35, 0.0).when(pe < 50, -0.3).when(pe < 70, -0.6).when(pe.isNotNull(), -0.9)
    parts = [(S.blend(band, F.col("xs_pe")), 1.0), (S.clamp(F.col("mean_surprise") / 10, -1.0, 1.0), 1.2), (F.when(F.col("n_surprises") >= 2, (F.col("beat_share") - 0.5) * 2), 0.8)]
    return {"fundamental": S.weighted_mean(parts), "fundamental_conf": S.present([p for p, _ in parts]) / 3}


def event() -> dict[str, Column]:
    """The next report (a near one lowers the score), the last result, and the distance from the high."""
    days = F.datediff("next_report", "as_of")
    soon = F.when(days == 0, -0.6).when(days == 1, -0.5).when(days == 2, -0.4).when(days == 3, -0.3).when(days <= 7, -0.15).when(days <= 21, 0.05).when(days.isNotNull(), 0.0)
    parts = [(soon, 1.2), (S.clamp(F.col("last_surprise") / 15, -1.0, 1.0), 1.0), (M.bands(F.col("from_high"), [(-0.02, 0.7), (-0.10, 0.3)], 0.0), 0.6)]
    return {"event": S.weighted_mean(parts), "event_conf": S.present([p for p, _ in parts]) / 3, "days_to_earnings": days}


def signals(df: DataFrame) -> DataFrame:
    """The nine signals and their confidences, from gathered rows with features and ranks, a few at a time: all in one stage are more
    code than the compiler takes."""
    x = lambda n: F.col(f"xs_{n}")
    df = W.settled(df.withColumns({**C.sentiment_signal(x("sentiment"), x("recency")), **fundamental()}))  # before the signal of that name takes the place of the scores' momentum
    df = W.settled(M.volume(M.technical(df.withColumn("ret", F.col("change_pct")))))
    df = W.settled(M.momentum(df))
    df = W.settled(df.withColumns({**event(), **C.short_interest(x("squeeze"))}))
    df = df.withColumns({**C.options_iv(F.coalesce("iv_rank_confidence", F.lit(0.0))), **C.analyst_view(x("mean_inverted"), x("upside"))})
    return df.withColumns({f"{k}_conf": F.coalesce(F.round(f"{k}_conf", 3), F.lit(0.0)) for k in M.WEIGHTS})


def normalised(weights: dict[str, float]) -> dict[str, float]:
    """A weight for each of the nine, adding up to 1; all alike where none is over 0."""
    total = sum(weights.get(k, 0.0) for k in M.WEIGHTS)
    return {k: round(weights.get(k, 0.0) / total if total > 0 else 1 / len(M.WEIGHTS), 4) for k in M.WEIGHTS}


def tradeability(rows: DataFrame, weights: dict[str, float] = M.WEIGHTS, feedback: bool = False) -> DataFrame:
    """Gathered and ranked (or unranked) rows with the signals, ``score`` (0 where no signal counts), ``coverage``, ``skipped``, ``label``, the
    structure to look for, and, where the rows tell the accuracy of past scores (``n``, ``accuracy``, ``significant``), what feedback
    would make of the score (``would_be``), which ``feedback`` lets count."""
    d = W.settled(signals(rows))
    d = M.composite(d, tuple(M.WEIGHTS), normalised(weights)).withColumn("score", F.coalesce("score", F.lit(0.0)))
    low = F.array(*[F.when(F.col(f"{k}_conf") < M.FLOOR, F.lit(k)) for k in M.WEIGHTS])
    d = d.withColumn("skipped", F.array_compact(low))
    d = O.choose(W.settled(d))
    if "accuracy" in d.columns:
        some = F.least(F.lit(1.0), F.col("n") / 60.0)
        d = d.withColumn("score_raw", F.col("score")).withColumns(C.feedback(F.col("score"), F.col("n"), some, (F.col("accuracy") - 0.5) * 2, F.col("significant"), feedback))
        d = d.withColumn("score", F.col("adjusted")).drop("adjusted")
    return d.withColumn("label", S.tradeability_label(F.col("score")))


def basket_tradeability(gathered: DataFrame, weights: dict[str, float] = M.WEIGHTS, feedback: bool = False) -> DataFrame:
    """Every ticker of the basket: features, their ranks, the nine signals and the composite."""
    return tradeability(ranked(features(gathered)), weights, feedback)


def review(gathered: DataFrame, weights: dict[str, float] = M.WEIGHTS) -> DataFrame:
    """Tickers outside the basket, by absolute limits alone."""
    return tradeability(unranked(features(gathered)), weights)
