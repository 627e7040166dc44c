"""Back-tests on the contracts themselves: a chain of set-based lookups (entry legs, exit date, the same contracts there), and
model-priced verticals where there are no quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import options as O
from ..functions import scalars as S

# Limits of old quotes, target deltas, days, and the cost of a round trip.
MIN_OPEN_INTEREST, MAX_SPREAD = 25, 0.25
LONG_DELTA, SHORT_DELTA, THRESHOLD, LEAST_DEBIT = 0.45, 0.25, 0.20, 0.01
TARGET_DTE, MIN_DTE, MAX_DTE, WALK, NEAR_DAYS = 35, 21, 60, 5, 2
COST = 0.04


def liquid() -> Column:
    """Both sides quoted, open interest and spread inside their limits or unknown, delta known."""
    mid = (F.col("bid") + F.col("ask")) / 2
    spread = F.greatest(F.lit(0.0), F.col("ask") - F.col("bid")) / mid
    return (F.col("bid") > 0) & (F.col("ask") > 0) & F.coalesce(F.col("open_interest") >= MIN_OPEN_INTEREST, F.lit(True)) & F.coalesce(spread <= MAX_SPREAD, F.lit(True)) & F.col("delta").isNotNull()


def entry_legs(observations: DataFrame, chain: DataFrame, target_dte: int = TARGET_DTE) -> DataFrame:
    """``ticker``, ``obs_date``, ``score``, ``expiration``, ``long`` and ``short`` (strike, bid, ask, delta) of each directional observation
    (``ticker``, ``obs_date``, ``score``) that finds both.  The short leg stands beyond the long one: where the nearest
    delta does not, the nearest of those that do."""
    wanted = observations.where(F.abs("score") >= THRESHOLD).select("ticker", "obs_date", "score", F.when(F.col("score") > 0, "C").otherwise("P").alias("right"))
    c = chain.where(F.col("dte").between(MIN_DTE, MAX_DTE)).select("ticker", F.col("trade_date").alias("obs_date"), "expiration", "dte", "opt_right", liquid().alias("liquid"), F.struct("strike", "bid", "ask", F.abs("delta").alias("size")).alias("q"))
    # one pass over the chain: it goes by the observations of its date, and all expiries of a date, liquid or not, are looked at where they lie
    seen = c.join(wanted.hint("shuffle_hash"), ["ticker", "obs_date"])
    # the offers of one expiry and right of one chain, by strike, so that ties go to the lowest
    offers = F.sort_array(F.collect_list(F.when((F.col("opt_right") == F.col("right")) & F.col("liquid"), F.col("q"))))
    each = seen.groupBy("ticker", "obs_date", "score", "right", "expiration", "dte").agg(offers.alias("offers"))
    g = each.groupBy("ticker", "obs_date", "score", "right").agg(F.min_by(F.struct("expiration", "offers"), F.struct(F.abs(F.col("dte") - target_dte), "expiration")).alias("__chosen")).select("ticker", "obs_date", "score", "right", "__chosen.*")

    def nearest(offers: Column, delta: float) -> Column:
        away = F.transform(offers, lambda q: F.struct(F.abs(q["size"] - delta).alias("away"), q.alias("q")))
        return F.array_min(F.when(F.size(away) > 0, away))["q"]

    g = g.withColumn("long", nearest(F.col("offers"), LONG_DELTA)).where("long IS NOT NULL")
    others = F.filter("offers", lambda q: q["strike"] != F.col("long.strike"))
    beyond = F.filter("offers", lambda q: F.when(F.col("right") == "C", q["strike"] > F.col("long.strike")).otherwise(q["strike"] < F.col("long.strike")))
    first = nearest(others, SHORT_DELTA)
    placed = F.when(F.col("right") == "C", first["strike"] > F.col("long.strike")).otherwise(first["strike"] < F.col("long.strike"))
    g = g.withColumn("short", F.when(placed, first).when(first.isNotNull(), nearest(beyond, SHORT_DELTA)))
    return g.where("short IS NOT NULL").drop("offers")


def debit_spreads(observations: DataFrame, chain: DataFrame, holding_days: int = 21) -> DataFrame:
    """The vertical of each observation, from its quotes at entry and those of the same contracts at the first date with a chain, of
    the ``holding_days``-th weekday and the WALK after it."""
    e = entry_legs(observations, chain)
    e = e.select("ticker", "obs_date", "score", "right", "expiration", F.col("long.strike").alias("long_strike"), F.col("short.strike").alias("short_strike"), (F.col("long.ask") - F.col("short.bid")).alias("debit")).where(F.col("debit") > LEAST_DEBIT)
    target = S.add_business_days(F.col("obs_date"), F.lit(holding_days))
    tries = e.select("*", F.posexplode(F.array(*[S.add_business_days(target, F.lit(k)) for k in range(WALK + 1)])).alias("k", "exit_date")).where("exit_date < expiration")
    # a date counts once any expiry within two days of the position's is quoted; expiries past are not
    quotes = chain.select("ticker", F.col("trade_date").alias("exit_date"), F.col("expiration").alias("listed"), F.col("opt_right").alias("quoted"), "strike", "bid", "ask")
    near = quotes.join(tries.hint("shuffle_hash"), ["ticker", "exit_date"]).where((F.abs(F.datediff("listed", "expiration")) <= NEAR_DAYS) & (F.col("listed") >= F.col("exit_date")))
    held = ["ticker", "obs_date", "score", "right", "expiration", "long_strike", "short_strike", "debit"]
    own = lambda leg, side: F.max(F.when((F.col("listed") == F.col("expiration")) & (F.col("quoted") == F.col("right")) & (F.col("strike") == F.col(leg)), F.col(side)))
    # the same contracts at each of the dates, and of the dates the first
    each = near.groupBy(*held, "k", "exit_date").agg(own("long_strike", "bid").alias("long_close"), own("short_strike", "ask").alias("short_close"))
    first = each.groupBy(*held).agg(F.min_by(F.struct("exit_date", "long_close", "short_close"), "k").alias("__first")).select(*held, "__first.*")
    held = first.withColumn("exit_value", F.col("long_close") - F.col("short_close")).where("exit_value IS NOT NULL")
    pnl = F.col("exit_value") - F.col("debit")
    return held.select("ticker", "obs_date", "score", F.when(F.col("score") > 0, "bull_call_spread").otherwise("bear_put_spread").alias("strategy"), "expiration", "exit_date", "long_strike", "short_strike", "debit", "exit_value", (pnl / F.col("debit") * 100).alias("pnl_pct"), (pnl > 0).alias("win"))


def enrich(observations: DataFrame, chain: DataFrame, holding_days: int = 21) -> DataFrame:
    """``observations`` with the spread's columns where it can be priced (``source`` says so) and nulls elsewhere; those that have a
    ``source`` already are left as they are."""
    done = observations.where("source IS NOT NULL")
    todo = observations.where("source IS NULL")
    priced = debit_spreads(todo, chain, holding_days).select("ticker", "obs_date", F.lit("CHAIN").alias("__source"), *[F.col(c).alias(f"__{c}") for c in ("strategy", "debit", "exit_value", "pnl_pct", "win")])
    found = todo.join(priced, ["ticker", "obs_date"], "left")
    out = found.select(*[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in found.columns else F.col(c) for c in observations.columns])
    return done.unionByName(out)


def synthetic_verticals(df: DataFrame, holding_days: int = 21, dte: int = 35) -> DataFrame:
    """``df`` (``score``, ``spot``, ``spot_later``, ``vol``: realised) with ``strategy``, ``debit``, ``pnl_pct`` and ``win`` of the vertical that the
    model would have opened, strikes a tenth and nine tenths of a deviation away, less the cost of the round trip; nulls
    where there is none."""
    bull = F.col("score") > 0
    live = (F.col("vol") > 0) & (F.col("spot") > 0) & (F.abs("score") >= THRESHOLD)
    step = F.col("vol") * F.sqrt(F.lit(dte / 365)) * F.col("spot") * F.when(bull, 1.0).otherwise(-1.0)
    d = df.withColumns({"__long": F.when(live, F.col("spot") + 0.1 * step), "__short": F.when(live, F.col("spot") + 0.9 * step), "__r": F.when(bull, "C").otherwise("P"), "__open": F.lit(dte / 365), "__close": F.lit(max(1, dte - holding_days) / 365)})
    for name, spot, strike, t in (("__a", "spot", "__long", "__open"), ("__b", "spot", "__short", "__open"), ("__c", "spot_later", "__long", "__close"), ("__d", "spot_later", "__short", "__close")):
        d = O.with_values(d, name, spot, strike, t, "vol", "__r")
    debit = F.col("__a") - F.col("__b")
    d = d.withColumn("__debit", F.when(debit > LEAST_DEBIT, debit))
    pnl = F.col("__c") - F.col("__d") - F.col("__debit") - F.col("__debit") * COST
    d = d.withColumns({"strategy": F.when(F.col("__debit").isNotNull(), F.when(bull, "bull_call_spread").otherwise("bear_put_spread")), "debit": F.col("__debit"), "pnl_pct": pnl / F.col("__debit") * 100, "win": pnl > 0})
    return d.drop("__long", "__short", "__r", "__open", "__close", "__a", "__b", "__c", "__d", "__debit")
