"""Queries over option structures and contract-level back-tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as B
from ..operators import joins as J
from ..operators import structures as X
from ..operators import windows as W
from ..functions import options as O
from .registry import OVER, _cdf, query, r

#: Reports are moved into the bars' years.
SHIFT = 10227
_OPPORTUNITIES = f"""(SELECT p.ticker, p.prediction_date AS trade_date, p.session_no, p.score, s.iv_rank, CASE WHEN s.ticker % 4 = 3 THEN 'proxy' ELSE 'chain' END AS iv_basis, CASE WHEN s.beta IS NULL THEN 0.35 ELSE 0.75 END AS coverage, CAST(e.day - p.prediction_date AS INT) AS days_to_earnings
  FROM {{predictions}} p JOIN {{snapshots}} s ON s.ticker = p.ticker ASOF LEFT JOIN (SELECT DISTINCT ticker, report_date + {SHIFT} AS day FROM {{earnings_events}}) e ON e.ticker = p.ticker AND e.day >= p.prediction_date)"""


def opportunities(get, listed=None):
    """Every prediction (with ``listed``, those at its dates, and its column) with its ticker's volatility rank and the days to its next report."""
    day = lambda c: -F.datediff(c, F.lit("1970-01-01").cast("date"))  # noqa: E731  backwards, so that the next report is the last at or before
    p = get("predictions")
    if listed is not None:
        p = p.join(listed.withColumnRenamed("trade_date", "prediction_date"), ["ticker", "prediction_date"])
    p = p.withColumn("at", day("prediction_date"))
    # reports of no ticker meet none
    e = get("earnings_events").where("ticker IS NOT NULL").select("ticker", day(F.date_add("report_date", SHIFT)).alias("day")).distinct()
    s = get("snapshots").select("ticker", "iv_rank", F.when(F.col("ticker") % 4 == 3, "proxy").otherwise("chain").alias("iv_basis"), F.when(F.col("beta").isNull(), 0.35).otherwise(0.75).alias("coverage"))
    o = J.asof_join(p, e, ["ticker"], "at", "day").join(s, "ticker")
    return o.select("ticker", F.col("prediction_date").alias("trade_date"), "session_no", "score", "iv_rank", "iv_basis", "coverage", (F.col("at") - F.col("day")).alias("days_to_earnings"), *(["listed"] if listed is not None else []))


_DIRECTION = "CASE WHEN score >= 0.2 THEN 'bullish' WHEN score <= -0.2 THEN 'bearish' ELSE 'neutral' END"
_CLASS = "CASE WHEN iv_rank IS NULL OR iv_basis <> 'chain' THEN 'unknown' WHEN iv_rank >= 70 THEN 'high' WHEN iv_rank <= 30 THEN 'low' ELSE 'mid' END"


@query(
    "o05_strategy",
    f"""WITH a AS (SELECT *, {_DIRECTION} AS direction, {_CLASS} AS iv_class FROM {_OPPORTUNITIES}),
    b AS (SELECT *, CASE WHEN days_to_earnings BETWEEN 0 AND 3 THEN 'none' WHEN direction = 'neutral' THEN CASE WHEN iv_class = 'high' THEN 'iron_condor' ELSE 'none' END WHEN iv_class = 'high' THEN CASE direction WHEN 'bullish' THEN 'bull_put_spread' ELSE 'bear_call_spread' END WHEN direction = 'bullish' THEN 'bull_call_spread' ELSE 'bear_put_spread' END AS structure FROM a),
    c AS (SELECT *, CASE WHEN coverage < 0.4 THEN 2 ELSE GREATEST(CASE WHEN iv_class = 'unknown' THEN 1 ELSE 0 END + CASE WHEN days_to_earnings <= 10 THEN 1 ELSE 0 END, CASE WHEN direction <> 'neutral' AND ABS(score) < 0.5 THEN 1 ELSE 0 END) END AS steps, structure <> 'none' AND days_to_earnings BETWEEN 4 AND 45 AS past FROM b)
    SELECT ticker, trade_date, direction, iv_class, structure, CASE WHEN structure = 'none' THEN 'avoid' ELSE CASE steps WHEN 0 THEN 'full' WHEN 1 THEN 'half' ELSE 'quarter' END END AS sizing, CASE WHEN days_to_earnings BETWEEN 0 AND 3 THEN 'earnings_too_close' WHEN structure = 'none' THEN 'no_edge' END AS reason,
      CAST(CASE WHEN past THEN GREATEST(35, days_to_earnings + 10) ELSE 35 END AS INT) AS target_dte, CAST(CASE WHEN past THEN GREATEST(21, days_to_earnings + 5) ELSE 21 END AS INT) AS min_dte, CAST(CASE WHEN past THEN GREATEST(60, days_to_earnings + 30) ELSE 60 END AS INT) AS max_dte FROM c""",
)
def _(get):
    return X.choose(opportunities(get)).select("ticker", "trade_date", "direction", "iv_class", "structure", "sizing", "reason", "target_dte", "min_dte", "max_dte")


#: Structures from strikes by their place in a chain: (action, right, place).
PLACED = {
    "bull_call_spread": [("BUY", "C", 7), ("SELL", "C", 9)], "bear_put_spread": [("BUY", "P", 7), ("SELL", "P", 5)], "bull_put_spread": [("SELL", "P", 6), ("BUY", "P", 4)],
    "bear_call_spread": [("SELL", "C", 8), ("BUY", "C", 10)], "iron_condor": [("SELL", "P", 5), ("BUY", "P", 3), ("SELL", "C", 9), ("BUY", "C", 12)], "long_call": [("BUY", "C", 7)], "long_put": [("BUY", "P", 7)],
}
_AT = lambda r_, k, c: f"MAX(CASE WHEN opt_right = '{r_}' AND k = {k} THEN {c} END)"
_FILL = lambda leg: ("" if leg[0] == "BUY" else "-") + _AT(leg[1], leg[2], "ask" if leg[0] == "BUY" else "bid")


def _economics(name: str) -> str:
    legs = PLACED[name]
    k = [_AT(leg[1], leg[2], "strike") for leg in legs]
    debit = " + ".join(_FILL(leg) for leg in legs)
    debit = f"({debit})"
    wide = f"ABS({k[0]} - {k[1]})" if len(k) == 2 else f"GREATEST(ABS({k[0]} - {k[1]}), ABS({k[2]} - {k[3]}))" if len(k) == 4 else "NULL"
    credit = legs[0][0] == "SELL"
    profit, loss = (f"-{debit}", f"{wide} + {debit}") if credit else (f"{wide} - {debit}", debit)
    if name == "iron_condor":
        low, high = f"{k[0]} + {debit}", f"{k[2]} - {debit}"
    else:
        low, high = f"{k[0]} {'+' if ('call' in name) != credit else '-' if not credit else '+' if 'put' in name else '-'} {debit}", "NULL"
    return f"SELECT ticker, trade_date, dte, '{name}' AS structure, {debit} AS net_debit, {'NULL' if len(k) == 1 else profit} AS max_profit, {loss} AS max_loss, {low} AS breakeven, {high} AS breakeven_upper, {wide} AS width, {debit} < 0 AS is_credit FROM q GROUP BY ticker, trade_date, dte"


_RANKED = "q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, trade_date, dte, opt_right ORDER BY strike) AS k FROM {option_chain})"


def placed_legs(get, quotes: bool = True):
    """The seven structures of every chain and expiry, one row each; without ``quotes`` legs have strike, right and volatility alone."""
    priced = ["bid", "ask", ((F.col("bid") + F.col("ask")) / 2).alias("mid")] if quotes else []
    one = F.struct("strike", F.col("opt_right").alias("right"), *priced, "iv")
    # thirteen strikes of each right at most
    g = get("option_chain").groupBy("ticker", "trade_date", "dte", F.col("underlying_price").alias("spot")).agg(*[F.sort_array(F.collect_list(F.when(F.col("opt_right") == x, one))).alias(x) for x in "CP"])
    leg = lambda a, x, k: F.struct(F.lit(a).alias("action"), F.get(F.col(x), F.lit(k - 1)).alias("leg"))
    return g.select("ticker", "trade_date", "dte", "spot", F.explode(F.array(*[F.struct(F.lit(n).alias("structure"), F.array(*[leg(*x) for x in legs]).alias("legs")) for n, legs in PLACED.items()])).alias("s")).select("ticker", "trade_date", "dte", "spot", "s.*")


@query("o07_structure_economics", f"WITH {_RANKED}, e AS ({' UNION ALL '.join(_economics(n) for n in PLACED)}) SELECT ticker, trade_date, dte, structure, {r(net_debit='net_debit', max_profit='max_profit', max_loss='max_loss', breakeven='breakeven', breakeven_upper='breakeven_upper', width='width')}, is_credit FROM e", 5)
def _(get):
    e = X.with_economics(placed_legs(get))
    at = lambda k: F.get("breakevens", F.lit(k))
    return e.select("ticker", "trade_date", "dte", "structure", "net_debit", "max_profit", "max_loss", at(0).alias("breakeven"), at(1).alias("breakeven_upper"), "width", "is_credit")


def _bs(s: str, k: str, t: str, v: str, right: str) -> str:
    """SQL of a model value."""
    d1 = f"((LN(({s}) / ({k})) + (0.042 + ({v}) * ({v}) / 2) * ({t})) / (({v}) * SQRT({t})))"
    d2 = f"({d1} - ({v}) * SQRT({t}))"
    call = f"(({s}) * ({_cdf(d1)}) - ({k}) * EXP(-0.042 * ({t})) * ({_cdf(d2)}))"
    return f"CASE WHEN {t} <= 0 THEN CASE WHEN {right} = 'C' THEN GREATEST(({s}) - ({k}), 0) ELSE GREATEST(({k}) - ({s}), 0) END WHEN {right} = 'C' THEN {call} ELSE {call} - ({s}) + ({k}) * EXP(-0.042 * ({t})) END"


_LEG_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS structure, '{a}' AS action, '{x}' AS rt, {k} AS place" for n, legs in PLACED.items() for a, x, k in legs)


@query(
    "o08_reprice",
    f"""WITH {_RANKED}, l AS ({_LEG_ROWS}), p AS (SELECT q.ticker, q.trade_date, q.dte, l.structure, CASE l.action WHEN 'BUY' THEN 1 ELSE -1 END AS sign, q.opt_right AS rt, q.strike AS k, COALESCE(q.iv, 0.3) AS v, GREATEST(q.dte - 20, 0) / CAST(365 AS DOUBLE) AS t, q.underlying_price * 1.05 AS up, q.underlying_price * 0.95 AS down FROM q JOIN l ON l.rt = q.opt_right AND l.place = q.k)
    SELECT ticker, trade_date, dte, structure, ROUND(SUM(sign * ({_bs('up', 'k', 't', 'v', 'rt')})), 4) AS up, ROUND(SUM(sign * ({_bs('down', 'k', 't', 'v', 'rt')})), 4) AS down FROM p GROUP BY ticker, trade_date, dte, structure""",
    4,
)
def _(get):
    """The worth of each structure after 20 days, 5 % up and down."""
    df = placed_legs(get, quotes=False).withColumns({"s_up": F.col("spot") * 1.05, "s_down": F.col("spot") * 0.95, "days": F.lit(20)})
    return X.reprice(df, {"up": "s_up", "down": "s_down"}, "days").select("ticker", "trade_date", "dte", "structure", "up", "down")


def basket_setups(get):
    """Set-ups of every opportunity at a date with a chain."""
    b = W.support_resistance(W.atr(get("bars"))).select("ticker", F.col("trade_date"), F.col("close").alias("spot"), "atr", "support", "resistance")
    o = J.join_beside(b, opportunities(get, X.listed(get("option_chain"))), "ticker", ["trade_date"])  # bars lie by ticker
    return X.setups(o, get("option_chain"))


@query("o09_o10_setups")
def _(get):
    s = basket_setups(get)
    return s.select("ticker", "trade_date", "structure", "reason", "expiration", "dte", F.transform("legs", lambda x: x["leg"]["strike"]).alias("strikes"), "net_debit", "max_profit", "max_loss", "breakeven", "breakeven_lower", "breakeven_upper", "pnl_at_target", "pnl_at_stop", "reward_risk", "prob_profit", "net_delta", "net_theta", "net_vega", "tier", "sizing")


# --- contracts -----------------------------------------------------------------------------------------------------------

_D1 = "((LN(underlying_price / strike) + (0.042 + iv * iv / 2) * (dte / CAST(365 AS DOUBLE))) / (iv * SQRT(dte / CAST(365 AS DOUBLE))))"
_ENTRY = f"""c AS (SELECT *, {_cdf(_D1)} - CASE opt_right WHEN 'P' THEN 1 ELSE 0 END AS delta FROM {{contract_quotes}}), o AS (SELECT ticker, prediction_date AS obs_date, score, CASE WHEN score > 0 THEN 'C' ELSE 'P' END AS rt FROM {{predictions}} WHERE ABS(score) >= 0.2),
    x AS (SELECT ticker, trade_date, ARG_MIN(expiration, ABS(dte - 35) * 100000 + dte) AS expiration FROM c WHERE dte BETWEEN 21 AND 60 GROUP BY ticker, trade_date),
    l AS (SELECT o.*, c.expiration, c.strike, c.bid, c.ask, ABS(c.delta) AS size FROM o JOIN x ON x.ticker = o.ticker AND x.trade_date = o.obs_date JOIN c ON c.ticker = o.ticker AND c.trade_date = o.obs_date AND c.expiration = x.expiration AND c.opt_right = o.rt WHERE bid > 0 AND ask > 0 AND open_interest >= 25 AND (ask - bid) / ((ask + bid) / 2) <= 0.25),
    a AS (SELECT * FROM l QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, obs_date ORDER BY ABS(size - 0.45), strike) = 1),
    n AS (SELECT l.*, a.strike AS long_strike, a.ask AS long_ask, ROW_NUMBER() OVER (PARTITION BY l.ticker, l.obs_date ORDER BY ABS(l.size - 0.25), l.strike) AS k, CASE l.rt WHEN 'C' THEN l.strike > a.strike ELSE l.strike < a.strike END AS beyond FROM l JOIN a ON a.ticker = l.ticker AND a.obs_date = l.obs_date AND l.strike <> a.strike),
    e AS (SELECT * FROM n WHERE beyond QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, obs_date ORDER BY k) = 1)"""


def contract_chain(get):
    return O.with_delta(get("contract_quotes")).select("ticker", "trade_date", "expiration", "dte", "opt_right", "strike", "bid", "ask", "open_interest", "delta")


def observations(get):
    return get("predictions").select("ticker", F.col("prediction_date").alias("obs_date"), "score")


@query("t04_entry_legs", f"WITH {_ENTRY} SELECT ticker, obs_date, expiration, long_strike, strike AS short_strike, ROUND(long_ask - bid, 6) AS debit FROM e")
def _(get):
    e = B.entry_legs(observations(get), contract_chain(get))
    return e.select("ticker", "obs_date", "expiration", F.col("long.strike").alias("long_strike"), F.col("short.strike").alias("short_strike"), (F.col("long.ask") - F.col("short.bid")).alias("debit"))


_DOW = "(ISODOW(obs_date) - 1 + 15 + u.k)"  # weekdays by arithmetic; entry dates are weekdays
_EXIT = f"CAST(obs_date + CAST(15 + u.k + 2 * ({_DOW} - {_DOW} % 5) / 5 AS INT) AS DATE)"
_SPREADS = f"""{_ENTRY}, w AS (SELECT *, long_ask - bid AS debit FROM e WHERE long_ask - bid > 0.01), t AS (SELECT w.*, u.k AS try, {_EXIT} AS exit_date FROM w CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS u(k)),
    s AS (SELECT t.ticker, t.obs_date, MIN(t.exit_date) AS exit_date FROM t JOIN (SELECT DISTINCT ticker, trade_date, expiration AS listed FROM c) h ON h.ticker = t.ticker AND h.trade_date = t.exit_date WHERE t.exit_date < t.expiration AND ABS(listed - t.expiration) <= 2 AND listed >= t.exit_date GROUP BY t.ticker, t.obs_date),
    p AS (SELECT w.ticker, w.obs_date, w.score, w.expiration, s.exit_date, w.long_strike, w.strike AS short_strike, w.debit, g.bid - h.ask AS exit_value FROM w JOIN s ON s.ticker = w.ticker AND s.obs_date = w.obs_date
      JOIN c g ON g.ticker = w.ticker AND g.trade_date = s.exit_date AND g.expiration = w.expiration AND g.opt_right = w.rt AND g.strike = w.long_strike JOIN c h ON h.ticker = w.ticker AND h.trade_date = s.exit_date AND h.expiration = w.expiration AND h.opt_right = w.rt AND h.strike = w.strike)"""


@query("o15_debit_spreads", f"WITH {_SPREADS} SELECT ticker, obs_date, CASE WHEN score > 0 THEN 'bull_call_spread' ELSE 'bear_put_spread' END AS strategy, expiration, exit_date, long_strike, short_strike, {r(debit='debit', exit_value='exit_value')}, ROUND((exit_value - debit) / debit * 100, 4) AS pnl_pct, exit_value - debit > 0 AS win FROM p", 4)
def _(get):
    return B.debit_spreads(observations(get), contract_chain(get), 15).drop("score")


@query("o16_enriched", f"WITH {_SPREADS} SELECT q.ticker, q.prediction_date AS obs_date, CASE WHEN q.session_no % 5 = 0 THEN 'OLD' WHEN p.ticker IS NOT NULL THEN 'CHAIN' END AS source, CASE WHEN q.session_no % 5 = 0 THEN 1.5 ELSE ROUND((exit_value - debit) / debit * 100, 4) END AS pnl_pct FROM {{predictions}} q LEFT JOIN p ON p.ticker = q.ticker AND p.obs_date = q.prediction_date", 4)
def _(get):
    """Every observation; a fifth was priced before and stays as it is."""
    old = F.col("session_no") % 5 == 0
    none = {c: F.lit(None).cast("double") for c in ("debit", "exit_value")}
    o = get("predictions").select("ticker", F.col("prediction_date").alias("obs_date"), "score", F.when(old, "OLD").alias("source"), F.when(old, 1.5).alias("pnl_pct"), F.lit(None).cast("string").alias("strategy"), F.lit(None).cast("boolean").alias("win"), *[c.alias(n) for n, c in none.items()])
    return B.enrich(o, contract_chain(get), 15).select("ticker", "obs_date", "source", "pnl_pct")


_VOL = f"CASE WHEN COUNT(lr) {OVER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) >= 9 THEN STDDEV_SAMP(lr) {OVER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) * SQRT(252) END"
_T0, _T1 = "(35 / CAST(365 AS DOUBLE))", "(14 / CAST(365 AS DOUBLE))"


@query(
    "o14_synthetic_verticals",
    f"""WITH b AS (SELECT *, LN(close / LAG(close) {OVER})) AS lr FROM {{bars}}), v AS (SELECT ticker, session_no, close AS spot, LEAD(close, 21) {OVER}) AS later, {_VOL} AS vol FROM b),
    s AS (SELECT p.ticker, p.session_no, p.score, v.spot, v.later, v.vol, CASE WHEN p.score > 0 THEN 'C' ELSE 'P' END AS rt, vol * SQRT({_T0}) * spot * CASE WHEN p.score > 0 THEN 1 ELSE -1 END AS step FROM {{predictions}} p JOIN v USING (ticker, session_no) WHERE ABS(p.score) >= 0.2 AND vol > 0 AND later IS NOT NULL),
    k AS (SELECT *, spot + 0.1 * step AS lo, spot + 0.9 * step AS hi FROM s),
    d AS (SELECT *, ({_bs('spot', 'lo', _T0, 'vol', 'rt')}) - ({_bs('spot', 'hi', _T0, 'vol', 'rt')}) AS debit, ({_bs('later', 'lo', _T1, 'vol', 'rt')}) - ({_bs('later', 'hi', _T1, 'vol', 'rt')}) AS worth FROM k)
    SELECT ticker, session_no, CASE WHEN score > 0 THEN 'bull_call_spread' ELSE 'bear_put_spread' END AS strategy, ROUND(debit, 4) AS debit, ROUND((worth - debit - debit * 0.04) / debit * 100, 2) AS pnl_pct FROM d WHERE debit > 0.01""",
    4,
)
def _(get):
    b = W.realized_vol(get("bars"), name="vol").select("ticker", "session_no", F.col("close").alias("spot"), F.lead("close", 21).over(W.order()).alias("spot_later"), "vol").where("spot_later IS NOT NULL")
    s = B.synthetic_verticals(get("predictions").select("ticker", "session_no", "score").join(b, ["ticker", "session_no"]))
    return s.where("debit IS NOT NULL").select("ticker", "session_no", "strategy", "debit", F.round("pnl_pct", 2).alias("pnl_pct"))
