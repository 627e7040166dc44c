"""Queries over the regime, conviction and decision models, and over streams with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import context as C
from ..operators import technical as T
from ..operators import terminal as D
from ..operators import windows as W
from ..streaming import pending as X
from . import states
from .registry import _SQL, OVER, query, r, rows

# --- regime --------------------------------------------------------------------------------------------------------------

#: Two indices and the ticker whose closes stand for a volatility level (10 + close / 10).
SPY, QQQ, VIX = 1, 2, 3


def breadth_row(bars):
    """Breadth at the last session: of the tickers whose last row it is."""
    wide = A.breadth(W.ends(bars.select("ticker", "session_no", "trade_date", "close"), returns=(5, 20), averages=(20, 50, 200)))
    return wide.agg(F.max_by(F.struct("score", "confidence", "above_50"), "trade_date").alias("b")).select(F.col("b.score").alias("breadth_score"), F.col("b.confidence").alias("breadth_confidence"), "b.above_50")


def regime_row(get):
    """The regime at the last session, as one row."""
    bars = get("bars")
    trend = T.index_trend(bars)
    index = lambda k, n: trend.where(F.col("ticker") == k).agg(F.max("score").alias(f"{n}_score"), F.max("confidence").alias(f"{n}_confidence"))
    level = bars.where(F.col("ticker") == VIX).withColumn("close", 10 + F.col("close") / 10)
    v = level.select("session_no", "close", (W.ret(5) * 100).alias("r5"), W.percentile_last("close", 20).alias("p20"), W.percentile_last("close", 252).alias("p252"))
    ends = v.agg(F.max_by(F.struct("close", "r5", "p20", "p252"), "session_no").alias("v")).select("v.*")
    own = C.volatility_regime(F.col("close"), F.col("r5"), F.col("p20"), F.col("p252"))
    volatility = ends.select(own["score"].alias("volatility_score"), own["confidence"].alias("volatility_confidence"), own["state"].alias("volatility_state"), F.col("close").alias("vix"))
    breadth = breadth_row(bars)
    rates = C.rates_score(get("rates")).agg(F.max_by(F.struct("score", "change_20"), "trade_date").alias("r")).select(F.col("r.score").alias("rates_score"), F.when(F.col("r.change_20").isNotNull(), 1.0).otherwise(0.6).alias("rates_confidence"))
    # one row each: put together by an aggregate, not by a product
    parts = index(SPY, "spy")
    for other in (index(QQQ, "qqq"), volatility, breadth, rates):
        parts = parts.unionByName(other, allowMissingColumns=True)
    return D.regime(parts.agg(*[F.max(c).alias(c) for c in parts.columns]).withColumn("risk", F.lit(0.25)))


_V = f"""(WITH b AS (SELECT session_no, close, (close / LAG(close, 5) OVER (ORDER BY session_no) - 1) * 100 AS r5, LIST(close) OVER (ORDER BY session_no ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l20, LIST(close) OVER (ORDER BY session_no ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS l252 FROM (SELECT session_no, 10 + close / 10 AS close FROM {{bars}} WHERE ticker = {VIX})),
  p AS (SELECT *, LEN(LIST_FILTER(l252, lambda x: x <= close)) * 100.0 / LEN(l252) AS p252 FROM b ORDER BY session_no DESC LIMIT 1)
  SELECT close AS vix, LEAST(GREATEST(0.55 * CASE WHEN close < 15 THEN 0.55 WHEN close < 20 THEN 0.25 WHEN close < 30 THEN -0.35 ELSE -0.85 END - 0.30 * LEAST(GREATEST(r5 / 25, -1), 1) - 0.15 * LEAST(GREATEST((p252 - 50) / 50, -1), 1), -1), 1) AS score, CASE WHEN close >= 30 THEN 'STRESSED' ELSE '' END AS state FROM p)"""
_ALL = f"""(WITH m AS MATERIALIZED ({_SQL['m12_index_trend']}) SELECT a.score AS s1, a.confidence AS c1, b.score AS s2, b.confidence AS c2, v.score AS s3, v.vix, v.state, d.score AS s4, d.confidence AS c4, d.above_50, e.score AS s5 FROM (SELECT * FROM m WHERE ticker = {SPY}) a, (SELECT * FROM m WHERE ticker = {QQQ}) b, {_V} v,
  (SELECT * FROM ({_SQL['a06_breadth']}) ORDER BY trade_date DESC LIMIT 1) d, (SELECT * FROM ({_SQL['m14_rates_score']}) ORDER BY trade_date DESC LIMIT 1) e)"""
_REGIME = f"""(SELECT *, (0.45 * tc * ts + 0.20 * s3 + 0.25 * c4 * s4 + 0.10 * s5) / (0.45 * tc + 0.20 + 0.25 * c4 + 0.10) AS score, LEAST(1, 0.45 * tc + 0.20 + 0.25 * c4 + 0.10) AS confidence FROM (SELECT *, (s1 + s2) / 2 AS ts, (c1 + c2) / 2 AS tc FROM {_ALL}))"""
_RLABEL = "CONCAT(CASE WHEN score >= 0.45 THEN 'STRONG_RISK_ON' WHEN score >= 0.15 THEN 'RISK_ON' WHEN score <= -0.45 THEN 'STRONG_RISK_OFF' WHEN score <= -0.15 THEN 'RISK_OFF' ELSE 'NEUTRAL' END, CASE WHEN state = 'STRESSED' THEN '_CAUTION' ELSE '' END)"


@query("m16_regime", f"SELECT ROUND(score, 4) AS score, ROUND(confidence, 4) AS confidence, ROUND(ts, 4) AS trend_score, {_RLABEL} AS label FROM {_REGIME}", 4)
def _(get):
    return regime_row(get).select("score", "confidence", "trend_score", "label")


_R20 = lambda k: f"(SELECT (close / LAG(close, 20) {OVER}) - 1) * 100 AS m FROM {{bars}} WHERE ticker = {k} ORDER BY session_no DESC LIMIT 1)"


@query(
    "f19_equity_state",
    f"""SELECT CASE WHEN ts >= 0.2 THEN 'BULLISH' WHEN ts <= -0.2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend, CASE WHEN above_50 >= 60 THEN 'HEALTHY' WHEN above_50 < 40 THEN 'WEAK' ELSE 'MIXED' END AS breadth, CASE WHEN vix >= 30 THEN 'STRESS' WHEN vix >= 22 THEN 'ELEVATED' ELSE 'NORMAL' END AS vix_structure,
    CASE WHEN (x.m + y.m) / 2 >= 2 THEN 'STRONG' WHEN (x.m + y.m) / 2 <= -2 THEN 'WEAK' ELSE 'MIXED' END AS momentum FROM {_REGIME}, {_R20(SPY)} x, {_R20(QQQ)} y""",
)
def _(get):
    move = get("bars").withColumn("m", W.ret(20) * 100).where(F.col("ticker").isin(SPY, QQQ)).groupBy("ticker").agg(F.max_by("m", "session_no").alias("m"))
    moves = move.agg(*[F.max(F.when(F.col("ticker") == k, F.col("m"))).alias(n) for k, n in ((SPY, "m1"), (QQQ, "m2"))])
    both = regime_row(get).select("spy_score", "qqq_score", "above_50", "vix").unionByName(moves, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return one.select(*[c.alias(k) for k, c in D.equity_state(*[F.col(c) for c in ("spy_score", "qqq_score", "m1", "m2", "above_50", "vix")]).items()])


# --- conviction ----------------------------------------------------------------------------------------------------------


def case(get):
    """What is known of every ticker in the snapshots: score, coverage, technical states, analysts, reading of its options, and the
    regime that breadth alone tells."""
    regime = breadth_row(get("bars")).select(C.regime_label(F.col("breadth_score"), F.lit(0.25), F.lit("")).alias("label")).scalar()
    scores = get("predictions").groupBy("ticker").agg(F.max_by("score", "prediction_date").alias("score"))
    analysts = A.analyst_momentum(get("analyst_rating_events")).select("ticker", F.col("state").alias("analyst_state"))
    s = get("snapshots").select("ticker", (F.col("price") / 220).alias("coverage"), "iv_rank", ((F.col("beta") - 1) * 12).alias("put_skew"), (F.col("price") % 100).alias("rsi"))
    df = s.join(scores, "ticker", "left").join(T.technical_opportunity(get("bars")).drop("session_no", "adx", "rvol"), "ticker", "left").join(analysts, "ticker", "left")
    bias = D.options_reading(df.select("ticker", "iv_rank", F.lit(None).cast("double").alias("iv_percentile"), F.lit(None).cast("string").alias("term_state"), F.lit(None).cast("double").alias("put_skew"), F.lit(None).cast("double").alias("call_skew"), F.lit(1.0).alias("confidence"), "score", F.lit("").alias("label")))
    return df.join(bias.select("ticker", F.col("structure_bias").alias("options_bias")), "ticker").withColumn("regime", regime)


_BIAS = "CASE WHEN score >= 0.2 THEN CASE WHEN iv_rank < 40 THEN 'Bullish debit structure' WHEN iv_rank >= 60 THEN 'Bullish credit structure' ELSE 'Bullish — structure neutral' END WHEN score <= -0.2 THEN CASE WHEN iv_rank < 40 THEN 'Bearish debit structure' WHEN iv_rank >= 60 THEN 'Bearish credit structure' ELSE 'Bearish — structure neutral' END WHEN iv_rank >= 60 THEN 'Neutral / premium-selling candidate' WHEN iv_rank < 40 THEN 'No clear options edge' ELSE 'No strong structure preference' END"
_CASE = f"""(WITH l AS (SELECT ticker, ARG_MAX(score, prediction_date) AS score FROM {{predictions}} GROUP BY ticker), k AS (SELECT s.ticker, s.price / 220 AS coverage, s.iv_rank, (s.beta - 1) * 12 AS put_skew, s.price % 100 AS rsi, l.score, t.trend_state, t.momentum_state, t.strength_state, t.volume_state, a.state AS analyst_state, (SELECT {_RLABEL} FROM (SELECT score, '' AS state FROM ({_SQL['a06_breadth']}) ORDER BY trade_date DESC LIMIT 1)) AS regime
    FROM {{snapshots}} s LEFT JOIN l ON l.ticker = s.ticker LEFT JOIN {states._STATES} t ON t.ticker = s.ticker LEFT JOIN ({_SQL['a08_analyst_momentum']}) a ON a.ticker = s.ticker), b AS (SELECT *, {_BIAS} AS bias FROM k),
  v AS (SELECT *, CASE WHEN score >= 0.2 THEN 1 WHEN score <= -0.2 THEN -1 ELSE 0 END AS v1, CASE WHEN CONTAINS(regime, 'RISK_ON') THEN 1 WHEN CONTAINS(regime, 'RISK_OFF') THEN -1 ELSE 0 END AS v2, CASE WHEN CONTAINS(trend_state, 'BULL') THEN 1 WHEN CONTAINS(trend_state, 'BEAR') THEN -1 ELSE 0 END AS v3,
    CASE WHEN CONTAINS(momentum_state, 'BULL') OR momentum_state = 'POSITIVE' THEN 1 WHEN CONTAINS(momentum_state, 'BEAR') OR momentum_state = 'NEGATIVE' THEN -1 ELSE 0 END AS v4, CASE WHEN strength_state IN ('STRONG', 'POSITIVE') THEN 1 WHEN strength_state IN ('WEAK', 'LAGGING') THEN -1 ELSE 0 END AS v5a,
    CASE WHEN CONTAINS(analyst_state, 'POSITIVE') THEN 1 WHEN CONTAINS(analyst_state, 'NEGATIVE') THEN -1 ELSE 0 END AS v6, CASE WHEN CONTAINS(bias, 'Bullish') THEN 1 WHEN CONTAINS(bias, 'Bearish') THEN -1 WHEN CONTAINS(UPPER(bias), 'STRONG') THEN 1 ELSE 0 END AS v7, trend_state IS NOT NULL AS tech FROM b),
  u AS (SELECT *, SIGN(v5a + CASE WHEN volume_state = 'CONFIRMED' THEN CASE WHEN v1 >= 0 THEN 1 ELSE -1 END ELSE 0 END) AS v5 FROM v),
  w AS (SELECT *, (v1 * 0.30 * LEAST(1, ABS(COALESCE(score, 0)) / 0.65) + v2 * 0.20 * CASE WHEN v2 <> 0 THEN 0.8 ELSE 0.35 END + CASE WHEN tech THEN v3 * 0.18 * CASE WHEN CONTAINS(trend_state, 'STRONG') THEN 1.0 ELSE 0.7 END + v4 * 0.14 * CASE WHEN CONTAINS(momentum_state, 'ACCELERATING') THEN 1.0 ELSE 0.7 END + v5 * 0.10 * CASE WHEN volume_state = 'CONFIRMED' THEN 0.9 ELSE 0.65 END ELSE 0 END
    + v6 * 0.05 * 0.75 + v7 * 0.03 * 0.5) / CASE WHEN tech THEN 1.0 ELSE 0.58 END AS weighted FROM u),
  c AS (SELECT *, LEAST(100, ABS(weighted) * 100 * (0.65 + 0.35 * LEAST(GREATEST(coverage, 0), 1))) AS raw FROM w)
  SELECT *, CASE WHEN weighted >= 0.12 THEN CASE WHEN raw >= 79.5 THEN 'STRONG BULL' ELSE 'BULLISH' END WHEN weighted <= -0.12 THEN CASE WHEN raw >= 79.5 THEN 'STRONG BEAR' ELSE 'BEARISH' END ELSE 'NEUTRAL' END AS direction FROM c)"""


@query("m19_conviction", f"SELECT ticker, direction, CAST(ROUND(raw) AS INT) AS conviction, {r(weighted='weighted')} FROM {_CASE}")
def _(get):
    return D.conviction(case(get)).select("ticker", "direction", "conviction", "weighted")


_VOTES = "LIST_VALUE(v1, v2, CASE WHEN tech THEN v3 END, CASE WHEN tech THEN v4 END, CASE WHEN tech THEN v5 END, v6, v7)"
_TARGET = "CASE WHEN CONTAINS(direction, 'BULL') THEN 1 WHEN CONTAINS(direction, 'BEAR') THEN -1 ELSE 0 END"
_AGREE = f"(SELECT *, LEN(LIST_FILTER(votes, lambda x: x <> 0)) AS directional, CASE WHEN target <> 0 THEN LEN(LIST_FILTER(votes, lambda x: x = target)) ELSE 0 END AS agreeing, CASE WHEN target <> 0 THEN LEN(LIST_FILTER(votes, lambda x: x = -target)) ELSE 0 END AS opposing FROM (SELECT *, {_VOTES} AS votes, {_TARGET} AS target FROM {_CASE}))"


@query("m20_agreement", f"SELECT ticker, directional, agreeing, opposing, CASE WHEN directional >= 4 AND agreeing >= 0.75 * directional THEN 'HIGH' WHEN directional > 0 AND agreeing / CAST(directional AS DOUBLE) >= 0.55 THEN 'MODERATE' ELSE 'LOW' END AS agreement FROM {_AGREE}")
def _(get):
    a = D.agreement(D.conviction(case(get)))
    return a.select("ticker", *[F.col(c).cast("long").alias(c) for c in ("directional", "agreeing", "opposing")], "agreement")


_UP, _DN = "target = 1", "target = -1"
_SAY = [
    (f"{_UP} AND strength_state IN ('LAGGING', 'WEAK') OR {_DN} AND strength_state IN ('STRONG', 'POSITIVE')", "Relative-strength divergence"),
    (f"{_UP} AND momentum_state IN ('NEGATIVE', 'ACCELERATING BEARISH') OR {_DN} AND momentum_state IN ('POSITIVE', 'ACCELERATING BULLISH')", "Momentum divergence"),
    ("volume_state = 'WEAK' AND (CONTAINS(direction, 'STRONG') OR STARTS_WITH(trend_state, 'STRONG'))", "Participation divergence"),
    (f"{_UP} AND rsi >= 75", "Extension risk"), (f"{_DN} AND rsi <= 25", "Oversold risk"),
    (f"{_UP} AND CONTAINS(analyst_state, 'NEGATIVE') OR {_DN} AND CONTAINS(analyst_state, 'POSITIVE')", "Analyst divergence"),
    ("iv_rank >= 85", "Volatility pricing risk"), (f"{_UP} AND put_skew >= 8", "Options downside hedge demand"), ("target <> 0 AND opposing >= 2", "Cross-signal disagreement"),
]


@query("m21_divergences", f"SELECT ticker, ARRAY_TO_STRING(LIST_FILTER(LIST_VALUE({', '.join(f'CASE WHEN {c} THEN {chr(39)}{t}{chr(39)} END' for c, t in _SAY)}), lambda x: x IS NOT NULL)[1:6], '; ') AS titles FROM {_AGREE}")
def _(get):
    d = D.divergences(D.conviction(case(get).withColumn("iv_percentile", F.col("iv_rank"))))
    return d.select("ticker", F.array_join(F.transform("divergences", lambda x: x["title"]), "; ").alias("titles"))


@query(
    "m22_options_reading",
    f"""WITH s AS (SELECT ticker, iv_rank, change_pct / 10 AS score, (short_ratio - 5) / 100 AS p, (beta - 1) / 20 AS c, analyst_mean_score / 5 AS confidence FROM {{snapshots}})
    SELECT ticker, CASE WHEN iv_rank IS NULL THEN 'UNKNOWN' WHEN iv_rank < 20 THEN 'VERY LOW' WHEN iv_rank < 40 THEN 'LOW' WHEN iv_rank < 60 THEN 'NORMAL' WHEN iv_rank < 80 THEN 'HIGH' ELSE 'VERY HIGH' END AS iv_state, {_BIAS} AS structure_bias,
      CASE WHEN p IS NULL AND c IS NULL THEN 'UNAVAILABLE' WHEN p * 100 >= 4 AND (c IS NULL OR p * 100 - c * 100 >= 3) THEN 'PUT RICH' WHEN c * 100 >= 4 AND (p IS NULL OR c * 100 - p * 100 >= 3) THEN 'CALL RICH' WHEN p IS NOT NULL AND c IS NOT NULL THEN 'BALANCED' ELSE 'INCOMPLETE' END AS skew_state,
      CAST(CASE WHEN iv_rank IS NULL THEN 1 ELSE 0 END + CASE WHEN confidence < 0.7 THEN 1 ELSE 0 END AS BIGINT) AS cautions FROM s""",
)
def _(get):
    s = get("snapshots").select("ticker", "iv_rank", F.lit(None).cast("double").alias("iv_percentile"), F.lit(None).cast("string").alias("term_state"), ((F.col("short_ratio") - 5) / 100).alias("put_skew"), ((F.col("beta") - 1) / 20).alias("call_skew"), (F.col("analyst_mean_score") / 5).alias("confidence"), (F.col("change_pct") / 10).alias("score"), F.lit("").alias("label"))
    return D.options_reading(s).select("ticker", "iv_state", "structure_bias", "skew_state", F.size("cautions").cast("long").alias("cautions"))


@query("m23_decision", f"SELECT ticker, {states._LABEL} AS quality, CASE WHEN {states._LABEL} = 'HIGH' AND NOT COALESCE(near, false) THEN 'READY' WHEN {states._LABEL} <> 'LOW' THEN 'WATCH' ELSE 'AVOID' END AS status FROM {states._SETUP} LEFT JOIN (SELECT ticker, MIN(report_date) - DATE '{states.REPORTS_DAY}' <= 7 AS near FROM {{earnings_events}} WHERE is_upcoming AND report_date >= DATE '{states.REPORTS_DAY}' GROUP BY ticker) USING (ticker)")
def _(get):
    d = D.decision(states.setups(get).withColumn("term_state", F.lit(None).cast("string")))
    return d.select("ticker", F.col("label").alias("quality"), "status")


# --- streams -------------------------------------------------------------------------------------------------------------


@query(
    "x10_pending_outcomes",
    f"""WITH f AS (SELECT ticker, session_no, close, LEAD(close, 5) {OVER}) AS later, LEAD(trade_date, 5) {OVER}) AS outcome_date FROM {{bars}})
    SELECT p.ticker, p.prediction_date, f.outcome_date, ROUND((later / close - 1) * 100, 4) AS actual_return_pct, (p.score > 0 AND later > close) OR (p.score < 0 AND later < close) AS direction_correct FROM {{predictions}} p JOIN f USING (ticker, session_no) WHERE f.outcome_date <= (SELECT MAX(trade_date) FROM {{bars}}) - 3""",
    4,
)
def _(get):
    """Predictions and closes as streams of four parts; outcomes up to the last watermark, three days before the last close."""
    bars, asked = get("bars").select("ticker", "trade_date", "close"), get("predictions").select("ticker", "prediction_date", "score", "horizon_days")
    path = X.shared_folder(bars.sparkSession)
    out = X.resolve_pending(X.as_stream(asked, "prediction_date", f"{path}/asked"), X.as_stream(bars, "trade_date", f"{path}/bars"))
    return X.drained(out, path).select("ticker", "prediction_date", "outcome_date", "actual_return_pct", "direction_correct")


@query("x12_session_ticks", "SELECT event_id, ticker, ROUND(price, 6) AS price FROM (SELECT *, timezone('America/New_York', timezone('UTC', CAST(ts AS TIMESTAMP))) AS here FROM {ticks}) WHERE ISODOW(here) < 6 AND HOUR(here) * 60 + MINUTE(here) BETWEEN 570 AND 959")
def _(get):
    t = get("ticks").withColumn("ts", F.col("ts").cast("timestamp"))
    return t.where(X.in_session(F.col("ts"))).select("event_id", "ticker", "price")


@query(
    "x13_enriched_ticks",
    f"""WITH d AS (SELECT ticker, close AS prev_close, {f'AVG(volume) {rows(20)}'} AS avg_volume, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY session_no DESC) AS k FROM {{bars}})
    SELECT t.event_id, t.ticker, {r(prev_close='d.prev_close', avg_volume='d.avg_volume', change_pct='(t.price / d.prev_close - 1) * 100')} FROM {{ticks}} t LEFT JOIN d ON d.ticker = t.ticker AND d.k = 1""",
)
def _(get):
    """Ticks as a stream, each batch joined with the daily table."""
    bars = get("bars")
    daily = bars.withColumn("avg_volume", F.avg("volume").over(W.last(20))).groupBy("ticker").agg(F.max_by(F.struct("close", "avg_volume"), "session_no").alias("d")).select("ticker", F.col("d.close").alias("prev_close"), "d.avg_volume")
    path = X.shared_folder(bars.sparkSession)
    ticks = X.as_stream(get("ticks").withColumn("ts", F.col("ts").cast("timestamp")), "ts", f"{path}/ticks")
    return X.drained(X.with_daily_context(ticks, daily).select("event_id", "ticker", "prev_close", "avg_volume", "change_pct"), path)
