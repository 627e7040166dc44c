"""Option structures: which one, its legs from a chain, its pay-off, and what it is worth later.

A pay-off at expiry is a piecewise linear function of the price: its knots are the strikes and 0, its slope past the last
strike is that of the calls.  Greatest profit, greatest loss and breakevens of any list of legs follow from the values at the
knots and that slope; a list is one array of a row, so nothing is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import options as O
from ..functions import scalars as S
from . import joins as J

# The grid of structures by direction and volatility bucket, with their legs (action, right, target delta), and
# the limits of days, sizes and quotes.
GRID = {
    "bullish|low": ("Bull Call Spread", "bull_call_spread"),
    "bullish|mid": ("Bull Call Spread", "bull_call_spread"),
    "bullish|high": ("Bull Put Spread", "bull_put_spread"),
    "bullish|unknown": ("Bull Call Spread", "bull_call_spread"),
    "bearish|low": ("Bear Put Spread", "bear_put_spread"),
    "bearish|mid": ("Bear Put Spread", "bear_put_spread"),
    "bearish|high": ("Bear Call Spread", "bear_call_spread"),
    "bearish|unknown": ("Bear Put Spread", "bear_put_spread"),
    "neutral|high": ("Iron Condor", "iron_condor"),
}
LEGS = {
    "bull_call_spread": [("BUY", "C", 0.45), ("SELL", "C", 0.25)],
    "bull_put_spread": [("SELL", "P", 0.30), ("BUY", "P", 0.15)],
    "bear_put_spread": [("BUY", "P", 0.45), ("SELL", "P", 0.25)],
    "bear_call_spread": [("SELL", "C", 0.30), ("BUY", "C", 0.15)],
    "iron_condor": [("SELL", "P", 0.20), ("BUY", "P", 0.10), ("SELL", "C", 0.20), ("BUY", "C", 0.10)],
}
TARGET_DTE, MIN_DTE, MAX_DTE, LEAST_DTE = 35, 21, 60, 7
BLACKOUT_DAYS, CAUTION_DAYS, STRONG = 3, 10, 0.5
MIN_BID, MIN_OPEN_INTEREST, MIN_VOLUME, MAX_SPREAD, MAX_SPREAD_SOFT = 0.05, 100, 10, 0.10, 0.20
MULTIPLIER = 100
SOFT_PENALTY, LEAST_IV, MOST_IV, DEFAULT_IV = 0.15, 0.01, 3.0, 0.30


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])[key]


def iv_class(rank: Column, basis: Column) -> Column:
    """Only a rank from chains counts; 70 and 30 are inside."""
    return F.when(rank.isNull() | (F.coalesce(basis, F.lit("")) != "chain"), "unknown").when(rank >= 70, "high").when(rank <= 30, "low").otherwise("mid")


def choose(df: DataFrame) -> DataFrame:
    """``df`` (``score``, ``iv_rank``, ``iv_basis``, ``days_to_earnings``, ``coverage``; nulls allowed) with the structure to look for:
    ``direction``, ``iv_class``, ``strategy``, ``structure``, ``legs_wanted``, ``sizing``, ``target_dte``, ``min_dte``, ``max_dte``, and ``reason``
    where there is to be no trade."""
    score, days = F.coalesce("score", F.lit(0.0)), F.col("days_to_earnings")
    d = df.withColumn("direction", S.direction(score)).withColumn("iv_class", iv_class(F.col("iv_rank"), F.col("iv_basis")))
    key = F.concat_ws("|", "direction", "iv_class")
    leg = lambda x: F.struct(F.lit(x[0]).alias("action"), F.lit(x[1]).alias("right"), F.lit(x[2]).alias("target"))
    structure = _lookup({k: F.lit(v[1]) for k, v in GRID.items()}, key)
    near = days.between(0, BLACKOUT_DAYS)
    d = d.withColumn("reason", F.when(near, "earnings_too_close").when(structure.isNull(), "no_edge"))
    d = d.withColumn("structure", F.when(F.col("reason").isNull(), structure).otherwise("none"))
    d = d.withColumn("strategy", F.when(near, "Avoid").otherwise(F.coalesce(_lookup({k: F.lit(v[0]) for k, v in GRID.items()}, key), F.lit("No Trade"))))
    # sizes in steps of halves; each reason takes one off, as far as it reaches
    unknown, caution = F.col("iv_class") == "unknown", F.coalesce(days <= CAUTION_DAYS, F.lit(False))
    moderate = (F.col("direction") != "neutral") & (F.abs(score) < STRONG)
    steps = unknown.cast("int") + caution.cast("int")
    steps = F.when(F.coalesce("coverage", F.lit(1.0)) < 0.4, 2).when(moderate, F.greatest(steps, F.lit(1))).otherwise(steps)
    sizing = F.element_at(F.array(F.lit("full"), F.lit("half"), F.lit("quarter")), steps + 1)
    past = days.between(BLACKOUT_DAYS + 1, 45) & F.col("reason").isNull()
    later = lambda least, more: F.when(past, F.greatest(F.lit(least), days + more)).otherwise(least).cast("int")
    return d.withColumns({
        "sizing": F.when(F.col("reason").isNull(), sizing).otherwise("avoid"), "target_dte": later(TARGET_DTE, 10), "min_dte": later(MIN_DTE, 5), "max_dte": later(MAX_DTE, 30),
        "legs_wanted": _lookup({k: F.array(*[leg(x) for x in v]) for k, v in LEGS.items()}, F.col("structure")),
    })


def quality(chain: DataFrame) -> DataFrame:
    """``chain`` with ``mid``, ``spread_pct`` and ``penalty`` (null where not even the soft limits hold)."""
    bid, ask = (F.coalesce(c, F.lit(0.0)) for c in ("bid", "ask"))
    mid = F.when((bid > 0) & (ask > 0), (bid + ask) / 2).otherwise(F.when(ask != 0, ask).otherwise(bid))
    c = chain.withColumns({"mid": mid, "spread_pct": F.when((bid > 0) & (ask > 0), (ask - bid) / mid)})
    enough = (bid >= MIN_BID) & (F.coalesce("open_interest", F.lit(0)) >= MIN_OPEN_INTEREST)
    strict = enough & (F.coalesce("volume", F.lit(0)) >= MIN_VOLUME) & F.coalesce(F.col("spread_pct") <= MAX_SPREAD, F.lit(False))
    soft = enough & F.coalesce(F.col("spread_pct") <= MAX_SPREAD_SOFT, F.lit(True))
    return c.withColumn("penalty", F.when(strict, 0.0).when(soft, SOFT_PENALTY))


def listed(chain: DataFrame) -> DataFrame:
    """``ticker``, ``trade_date`` and ``listed``, the expiries (``dte``, ``expiration``) of each chain; they are few."""
    return chain.groupBy("ticker", "trade_date").agg(F.collect_set(F.struct("dte", "expiration")).alias("listed"))


def expiries(wanted: DataFrame, chain: DataFrame) -> DataFrame:
    """``wanted`` with ``expiration`` and ``dte``: the one nearest its target inside its window, else the nearest of a week or more.  Where
    ``wanted`` has the columns of ``listed``, the chain is not read for them."""
    w = wanted if "listed" in wanted.columns else wanted.join(listed(chain), ["ticker", "trade_date"], "left")
    inside = lambda d: d["dte"].between(F.col("min_dte"), F.col("max_dte"))
    some = F.filter("listed", lambda d: inside(d) | (d["dte"] >= LEAST_DTE))
    best = F.array_min(F.transform(some, lambda d: F.struct((~inside(d)).alias("out"), F.abs(d["dte"] - F.col("target_dte")).alias("away"), d["dte"].alias("dte"), d["expiration"].alias("expiration"))))
    w = w.withColumn("__m", best).drop("listed")
    return w.select("*", "__m.expiration", "__m.dte").drop("__m")


def with_legs(wanted: DataFrame, chain: DataFrame) -> DataFrame:
    """``wanted`` (one row for each ticker and date, with ``expiration`` and ``legs_wanted``) with ``legs``: for each leg in its order the
    liquid contract whose delta is nearest its target, among strikes that no earlier leg took; ``legs`` is shorter
    where one has no contract."""
    by = ["ticker", "trade_date", "expiration"]
    c = quality(J.join_beside(chain, wanted.select(*by, "legs_wanted"), "ticker", by[1:]))  # contracts are not moved, only the legs that are found
    liquid = F.col("penalty").isNotNull() & (F.col("strike") > 0)  # no filter: it would be worked out below the join, from the chain's own expressions
    quote = ["bid", "ask", "mid", F.col("open_interest").cast("long").alias("open_interest"), F.col("volume").cast("long").alias("volume"), "iv", "spread_pct", "penalty", "underlying_price", "dte"]
    offered = c.groupBy(*by).agg(F.collect_list(F.when(liquid, F.struct("strike", "opt_right", *quote))).alias("__offered"), F.first("legs_wanted").alias("legs_wanted"))
    offered = O.with_list_greeks(offered, "__offered", "mid", (LEAST_IV, MOST_IV))  # a volatility is looked for where none is quoted
    fields = ("strike", ("opt_right", "right"), "bid", "ask", "mid", "open_interest", "volume", "iv", "delta", "theta", "vega", "spread_pct", "penalty")
    one = lambda o: F.struct(*[o[f].alias(f) if isinstance(f, str) else o[f[0]].alias(f[1]) for f in fields])
    offered = offered.withColumn("__offered", F.transform(F.filter("__offered", lambda o: o["iv"] > 0), one))
    # ties go to the lowest strike; contracts without a delta come last
    pick = """
      aggregate(legs_wanted, CAST(array() AS ARRAY<STRUCT<away: DOUBLE, leg: STRUCT<strike: DOUBLE, right: STRING, bid: DOUBLE, ask: DOUBLE, mid: DOUBLE, open_interest: BIGINT, volume: BIGINT, iv: DOUBLE, delta: DOUBLE, theta: DOUBLE, vega: DOUBLE, spread_pct: DOUBLE, penalty: DOUBLE>, action: STRING>>),
        (taken, want) -> concat(taken, transform(filter(array(array_min(transform(
          filter(__offered, o -> o.right = want.right AND NOT exists(taken, t -> t.leg.strike = o.strike)),
          o -> named_struct('unknown', o.delta IS NULL, 'away', abs(abs(o.delta) - want.target) + o.penalty, 'leg', o, 'action', want.action)))),
          m -> m IS NOT NULL), m -> named_struct('away', m.away, 'leg', m.leg, 'action', m.action))))"""
    w = wanted.join(offered.select(*by, F.expr(pick).alias("legs")), by, "left")
    found = F.when(F.col("legs_wanted").isNotNull(), F.coalesce("legs", F.array().cast(w.schema["legs"].dataType)))
    return w.select(*wanted.columns, found.alias("legs"))


def _sum(legs: Column, f) -> Column:
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + f(x))


def _sign(leg: Column) -> Column:
    return F.when(leg["action"] == "BUY", 1.0).otherwise(-1.0)


def net_debit(legs: Column, at_mid: bool = False) -> Column:
    """What opening costs for each share: the ask is paid and the bid received (or mids)."""
    price = (lambda x: x["leg"]["mid"]) if at_mid else (lambda x: F.when(x["action"] == "BUY", x["leg"]["ask"]).otherwise(x["leg"]["bid"]))
    return _sum(legs, lambda x: _sign(x) * price(x))


def payoff(legs: Column, spot: Column) -> Column:
    """Value at expiry."""
    return _sum(legs, lambda x: _sign(x) * F.greatest(F.lit(0.0), F.when(x["leg"]["right"] == "C", spot - x["leg"]["strike"]).otherwise(x["leg"]["strike"] - spot)))


def with_economics(df: DataFrame) -> DataFrame:
    """``df`` (with ``legs`` and ``structure``) with ``net_debit``, ``max_profit`` and ``max_loss`` (null: unbounded), ``breakevens`` (roots of
    the sloped pieces, in their order), ``width`` and ``is_credit``.  A lone leg's profit is not stated."""
    legs = F.col("legs")
    d = df.withColumn("net_debit", net_debit(legs)).withColumn("net_debit_mid", net_debit(legs, at_mid=True))
    d = d.withColumn("__knots", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.transform(legs, lambda x: x["leg"]["strike"])))))
    d = d.withColumn("__values", F.transform("__knots", lambda k: payoff(legs, k) - F.col("net_debit")))
    d = d.withColumn("__tail", _sum(legs, lambda x: F.when(x["leg"]["right"] == "C", _sign(x)).otherwise(0.0)))
    piece = lambda i: F.struct(F.col("__knots")[i].alias("k"), F.col("__values")[i].alias("v"), ((F.col("__values")[i + 1] - F.col("__values")[i]) / (F.col("__knots")[i + 1] - F.col("__knots")[i])).alias("slope"))
    inner = F.transform(F.sequence(F.lit(0), F.size("__knots") - 2), piece)
    last = F.array(F.struct(F.element_at("__knots", -1).alias("k"), F.element_at("__values", -1).alias("v"), F.col("__tail").alias("slope")))
    sloped = F.filter(F.concat(inner, last), lambda p: F.abs(p["slope"]) > 1e-9)
    some = F.size("legs") > 0
    strikes = lambda right: F.transform(F.filter(legs, lambda x: x["leg"]["right"] == right), lambda x: x["leg"]["strike"])
    put, call = strikes("P"), strikes("C")
    wide = F.greatest(*[F.coalesce(F.array_max(x) - F.array_min(x), F.lit(0.0)) for x in (put, call)])
    d = d.withColumns({
        "max_profit": F.when(some & (F.col("__tail") <= 0) & (F.size("legs") > 1), F.array_max("__values")),
        "max_loss": F.when(some & (F.col("__tail") >= 0), -F.array_min("__values")),
        "breakevens": F.when(some, F.transform(sloped, lambda p: p["k"] - p["v"] / p["slope"])),
        "width": F.when(F.size("legs") > 1, wide), "is_credit": F.col("net_debit") < 0,
    })
    return d.drop("__knots", "__values", "__tail")


def reprice(df: DataFrame, spots: dict[str, str], days: str, dte: str = "dte", iv_shift: float = 0.0) -> DataFrame:
    """``df`` with a column for each of ``spots`` (name -> column of a price): the worth of ``legs`` there after ``days``.  Legs without a
    volatility count with DEFAULT_IV."""
    vol = lambda x: F.greatest(F.lit(0.01), F.coalesce(x["leg"]["iv"], F.lit(DEFAULT_IV)) + iv_shift)
    each = {"__k": lambda x: x["leg"]["strike"], "__v": vol, "__sign": _sign, "__call": lambda x: F.when(x["leg"]["right"] == "C", 1.0).otherwise(0.0)}
    of_legs = lambda f: F.transform("legs", lambda x: f(x).cast("double"))
    arrays = {n: of_legs(f) for n, f in each.items()}
    d = df.withColumns({"__t": F.greatest(F.lit(0), F.col(dte) - F.col(days)) / F.lit(365.0), **arrays, **{f"__s_{n}": F.col(c) for n, c in spots.items()}})
    return O.with_leg_values(d, {n: f"__s_{n}" for n in spots}, "__k", "__v", "__sign", "__call", "__t").drop("__t", *[f"__s_{n}" for n in spots])


def setups(opportunities: DataFrame, chain: DataFrame) -> DataFrame:
    """A full set-up for each opportunity (``ticker``, ``trade_date``, ``spot``, ``score``, ``coverage``, ``iv_rank``, ``iv_basis``,
    ``days_to_earnings``, ``atr``, ``support``, ``resistance``, and ``listed`` if it is known); those that can't be traded keep a row with a ``reason``."""
    w = expiries(choose(opportunities), chain)
    # an opportunity that is out already asks for no chain
    asked = F.when(F.col("reason").isNull() & (F.col("spot") > 0), F.col("expiration"))
    w = with_legs(w.withColumn("expiration", asked), chain)
    short = F.coalesce(F.size("legs"), F.lit(0)) < F.coalesce(F.size("legs_wanted"), F.lit(0))
    reason = F.coalesce("reason", F.when(F.coalesce(F.col("spot"), F.lit(0.0)) <= 0, "no_price").when(F.col("expiration").isNull(), "no_chain").when(short, "illiquid"))
    w = w.withColumn("reason", reason).withColumn("legs", F.when(F.col("reason").isNull(), F.col("legs")))
    w = with_economics(w)
    spot, atr = F.col("spot"), F.coalesce("atr", F.col("spot") * 0.02)
    up, down = spot + atr * 2, spot - atr * 2
    target = F.when(F.col("direction") == "bullish", F.when(F.col("resistance") < up, F.col("resistance") * 0.99).otherwise(up)).when(F.col("direction") == "bearish", F.when(F.col("support") > down, F.col("support") * 1.01).otherwise(down)).otherwise(spot)
    stop = F.when(F.col("direction") == "bullish", spot - atr * 1.5).when(F.col("direction") == "bearish", spot + atr * 1.5).otherwise(spot)
    w = w.withColumns({"price_target": target, "price_stop": stop, "hold_days": F.greatest(F.lit(1), F.floor(F.col("dte") / 2).cast("int"))})
    w = reprice(w, {"__target": "price_target", "__stop": "price_stop"}, "hold_days")
    gain, loss = F.col("__target") - F.col("net_debit"), F.col("__stop") - F.col("net_debit")
    gain = F.when(F.col("max_profit").isNotNull(), F.least(gain, F.col("max_profit"))).otherwise(gain)
    loss = F.when(F.col("max_loss").isNotNull(), F.greatest(loss, -F.abs("max_loss"))).otherwise(loss)
    legs, breakeven = F.col("legs"), F.when(F.size("breakevens") == 1, F.col("breakevens")[0])
    ivs = F.transform(legs, lambda x: x["leg"]["iv"])
    iv = F.when(F.size(legs) > 0, F.aggregate(ivs, F.lit(0.0), lambda s, x: s + x) / F.size(legs))
    clean = ~F.exists(legs, lambda x: F.coalesce(x["leg"]["spread_pct"] > MAX_SPREAD, F.lit(False)) | (x["leg"]["open_interest"] < 3 * MIN_OPEN_INTEREST))
    cover, size = F.coalesce("coverage", F.lit(0.0)), F.abs(F.coalesce("score", F.lit(0.0)))
    t = F.col("dte") / F.lit(365.0)
    d2 = (F.log(spot / breakeven) + (O.RATE - iv * iv / 2) * t) / (iv * F.sqrt(t))
    live = F.col("reason").isNull()
    w = S.with_norm_cdf(w, "prob_profit", F.when(F.col("direction") == "bullish", d2).otherwise(-d2))
    w = w.withColumns({
        "tradeable": live, "pnl_at_target": gain, "pnl_at_stop": loss, "reward_risk": F.round(F.greatest(F.lit(0.0), gain) / F.greatest(F.lit(1e-9), F.abs(loss)), 2),
        "breakeven": breakeven, "breakeven_lower": F.when(F.size("breakevens") == 2, F.col("breakevens")[0]), "breakeven_upper": F.when(F.size("breakevens") == 2, F.col("breakevens")[1]),
        "slippage": F.abs(F.col("net_debit") - F.col("net_debit_mid")), "avg_iv": iv,
        **{f"net_{g}": _sum(legs, lambda x, g=g: _sign(x) * x["leg"][g]) for g in ("delta", "theta", "vega")},
        "tier": F.when(live, F.when((cover >= 0.7) & (size >= 0.4) & clean, "HIGH").when((cover >= 0.45) & (size >= 0.2), "MEDIUM").otherwise("LOW")),
        "poor_payoff": F.col("max_profit") < F.abs("max_loss") * 0.5,
    })
    return w.drop("__target", "__stop")
