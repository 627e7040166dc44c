"""Queries over the basket pipeline: features, ranks, the nine signals of every ticker and their composite."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import basket as B
from ..operators import signals as M
from .context import _clip
from .registry import _OUTCOMES, _STORIES, _WEIGHT, OVER, _outcomes, query, r, rows

#: The basket's day, and the days by which reports are moved to lie about it.
DAY, MOVED = "2024-01-09 00:00:00", 9353


def _sides(get):
    """The sides of every ticker at the basket's day."""
    prices = B.market_side(get("bars"))
    s = get("snapshots").select("ticker", "pe_ratio", "analyst_rating", "analyst_mean_score", "target_price", "short_ratio", "short_pct_float", "beta", "iv_rank", "iv", F.lit(0.8).alias("iv_rank_confidence"), F.when(F.col("ticker") % 4 == 3, "proxy").otherwise("chain").alias("iv_basis"))
    stories = A.weighted_sentiment(get("articles")).select("ticker", F.round("sentiment", 6).alias("sentiment"), F.col("stories").alias("n_articles"))
    reports = B.earnings_side(get("earnings_events").withColumn("report_date", F.date_add("report_date", MOVED)), DAY)
    accuracy = A.accuracy(_outcomes(get)).where("ticker IS NOT NULL").select("ticker", "n", "accuracy", "significant")
    return prices, s, stories, B.article_side(get("articles"), DAY), B.score_side(get("predictions")), reports, accuracy


def gathered(get, inside: bool = True):
    """Tickers with a balance are the basket."""
    held = F.col("s_acctbal") > 0
    return B.gather(get("supplier").where(held if inside else ~held).select(F.col("s_suppkey").alias("ticker")), DAY, *_sides(get))


_LAST = f"""(WITH b AS (SELECT *, ROUND((close / LAG(close) {OVER}) - 1) * 100, 4) AS ret, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY session_no DESC) AS back FROM {{bars}}),
  f AS (SELECT ticker, back, close AS price, ret AS change_pct, MAX(high) {rows(252)} AS hi, MIN(low) {rows(252)} AS lo, volume / AVG(volume) {rows(30)} AS volume_ratio, CASE WHEN COUNT(ret) {rows(14)} >= 5 THEN REGR_SLOPE(ret, session_no) {rows(14)} END AS slope,
    CASE WHEN COUNT(ret) {rows(14)} >= 5 THEN AVG(ret) {rows(5)} - AVG(ret) {rows(14)} END AS accel, CASE WHEN COUNT(ret) {rows(30)} >= 10 THEN STDDEV_SAMP(ret) {rows(30)} * SQRT(252) END AS vol FROM b),
  v AS (SELECT ticker, LIST(ret ORDER BY session_no) AS v FROM b WHERE back <= 120 AND ret IS NOT NULL GROUP BY ticker),
  w AS (SELECT ticker, LEN(v) AS n_returns, {", ".join(f"CASE WHEN LEN(v) >= 15 THEN LIST_REDUCE(LIST_TRANSFORM(LIST_CONCAT([LIST_SUM(LIST_TRANSFORM(v[1:14], lambda x: GREATEST({sign}x, 0))) / 14], LIST_TRANSFORM(v[15:], lambda x: GREATEST({sign}x, 0))), lambda x: CAST(x AS DOUBLE)), lambda a, x: (a * 13 + x) / 14) END AS {name}" for sign, name in (("", "g"), ("-", "l")))},
    LIST_REVERSE(v)[1:14] AS t FROM v)
  SELECT f.*, COALESCE(n_returns, 0) AS n_returns, CASE WHEN l = 0 THEN 100 WHEN g = 0 THEN 0 ELSE 100 - 100 / (1 + g / l) END AS rsi, CASE WHEN t[1] >= 0 THEN 1 ELSE -1 END * COALESCE(LIST_POSITION(LIST_TRANSFORM(t, lambda x: (x >= 0) = (t[1] >= 0)), false) - 1, LEN(t)) AS streak FROM f LEFT JOIN w ON w.ticker = f.ticker WHERE back = 1)"""
_NEWS = f"""(SELECT ticker, COUNT(DISTINCT COALESCE(source, 'unknown')) AS outlets, CASE WHEN SUM(w) > 0 THEN ROUND(LEAST(GREATEST(SUM(sentiment * w) / SUM(w), -1), 1), 6) END AS recency FROM (SELECT *, CASE WHEN sentiment IS NOT NULL THEN EXP(-GREATEST(0, EPOCH(TIMESTAMP '{DAY}') - FLOOR(EPOCH(CAST(published_at AS TIMESTAMP)))) / 3600.0 / 48.0) END AS w
  FROM (SELECT * FROM {{articles}} WHERE published_at IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY published_at DESC, id DESC) <= {B.ARTICLES}) WHERE CAST(published_at AS TIMESTAMP) >= TIMESTAMP '{DAY}' - INTERVAL {B.FRESH_DAYS} DAYS) GROUP BY ticker)"""
_MOVE = "(SELECT ticker, CASE WHEN COUNT(*) >= 2 THEN ARG_MAX(score, prediction_date) - ARG_MIN(score, prediction_date) END AS momentum FROM (SELECT *, MAX(prediction_date) OVER (PARTITION BY ticker) AS newest FROM {predictions} QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY prediction_date DESC) <= 3) WHERE newest - prediction_date <= 14 GROUP BY ticker)"
_REPORTS = f"""(WITH e AS (SELECT ticker, report_date + {MOVED} AS day, seq, eps_actual, CASE WHEN eps_actual IS NOT NULL AND ABS(eps_estimate) >= 0.01 THEN ROUND(GREATEST(LEAST((eps_actual - eps_estimate) / ABS(eps_estimate) * 100, 200), -200), 4) END AS surprise FROM {{earnings_events}} WHERE report_date IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY report_date DESC, seq DESC) <= {B.REPORTS}),
  k AS (SELECT ticker, COUNT(*) AS n_surprises, AVG(surprise) AS mean_surprise, AVG(CAST(surprise > 0 AS INT)) AS beat_share FROM (SELECT * FROM e WHERE surprise IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY day DESC, seq DESC) <= {B.SURPRISES}) GROUP BY ticker),
  l AS (SELECT ticker, surprise FROM e WHERE eps_actual IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY day DESC, seq DESC) = 1),
  n AS (SELECT ticker, MIN(day) FILTER (WHERE day >= DATE '{DAY[:10]}') AS next_report FROM e GROUP BY ticker)
  SELECT n.ticker, next_report, l.surprise AS last_surprise, COALESCE(n_surprises, 0) AS n_surprises, mean_surprise, beat_share FROM n LEFT JOIN k ON k.ticker = n.ticker LEFT JOIN l ON l.ticker = n.ticker)"""
_ACCURACY = f"(SELECT ticker, COUNT(*) AS n, AVG(CAST(COALESCE(SIGN(score) * SIGN(actual_return) > 0, false) AS INT)) AS accuracy FROM {_OUTCOMES} WHERE actual_return IS NOT NULL GROUP BY ticker)"
_RATED = "CASE REPLACE(LOWER(analyst_rating), ' ', '') " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in {"strongbuy": 1.0, "buy": 0.6, "hold": 0.0, "underperform": -0.5}.items()) + " END"
_FEATURES = """(SELECT *, CASE WHEN hi > lo THEN (price - lo) / (hi - lo) END AS position, (price - hi) / hi AS from_high, {rated} AS rating, 3.0 - analyst_mean_score AS mean_inverted, (target_price - price) / price * 100 AS upside, CAST(CASE WHEN pe_ratio > 0 THEN pe_ratio END AS DOUBLE) AS pe,
    NULLIF(volume_ratio, 0) * CASE WHEN COALESCE(change_pct, 0) >= 0 THEN 1 ELSE -1 END AS signed_ratio, NULLIF(short_ratio, 0) * CASE WHEN COALESCE(change_pct, 0) > 0 THEN 1 ELSE -1 END AS squeeze
  FROM (SELECT s.*, p.* EXCLUDE (ticker, back), a.sentiment, a.n_articles, n.outlets, n.recency, m.momentum AS moved, e.* EXCLUDE (ticker), h.n, h.accuracy, CASE WHEN s.ticker % 4 = 3 THEN 'proxy' ELSE 'chain' END AS iv_basis
    FROM (SELECT x.* FROM {{snapshots}} x JOIN {{supplier}} y ON y.s_suppkey = x.ticker WHERE y.s_acctbal {sign}) g JOIN (SELECT * EXCLUDE (price, change_pct) FROM {{snapshots}}) s ON s.ticker = g.ticker LEFT JOIN {last} p ON p.ticker = s.ticker
    LEFT JOIN (SELECT ticker, ROUND(SUM(sentiment * {weight}) / SUM({weight}), 6) AS sentiment, COUNT(*) AS n_articles FROM {stories} WHERE sentiment IS NOT NULL GROUP BY ticker) a ON a.ticker = s.ticker
    LEFT JOIN {news} n ON n.ticker = s.ticker LEFT JOIN {move} m ON m.ticker = s.ticker LEFT JOIN {reports} e ON e.ticker = s.ticker LEFT JOIN {accuracy} h ON h.ticker = s.ticker))"""


def _from(sign: str) -> str:
    parts = {"rated": _RATED, "sign": sign, "last": _LAST, "weight": _WEIGHT, "stories": _STORIES, "news": _NEWS, "move": _MOVE, "reports": _REPORTS, "accuracy": _ACCURACY}
    text = _FEATURES.replace("{{", "{").replace("}}", "}")
    for name, value in parts.items():
        text = text.replace("{" + name + "}", value)
    return text


def _rank(f: str, more: bool) -> str:
    return f"""CASE WHEN {f} IS NOT NULL AND COUNT({f}) OVER () >= 6 THEN CASE WHEN MIN({f}) OVER () = MAX({f}) OVER () THEN 0e0 ELSE ROUND(((RANK() OVER (ORDER BY {f} NULLS LAST) - 1 + (COUNT(*) OVER (PARTITION BY {f}) - 1) / 2) / (COUNT({f}) OVER () - 1) * 2 - 1) * {1 if more else -1}, 4) END END AS xs_{f}"""


_RANKS = ", ".join(_rank(f, more) for f, more in B.RANKED.items())
_NONE = ", ".join(f"CAST(NULL AS DOUBLE) AS xs_{f}" for f in B.RANKED)


def _tidy(x: str, digits: int = 4) -> str:
    """Rounded as Spark rounds: halves of the decimal text away from 0."""
    return f"CAST(ROUND(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"


def _weighted(*parts: tuple[str, float]) -> str:
    low = " + ".join(f"CASE WHEN ({s}) IS NOT NULL THEN {w}e0 ELSE 0e0 END" for s, w in parts)
    top = " + ".join(f"COALESCE(({s}) * {w}e0, 0e0)" for s, w in parts)
    return f"CASE WHEN {low} > 0 THEN {_tidy(_clip(f'({top}) / NULLIF({low}, 0)'))} END"


def _blend(a: str, x: str, w: float = 0.65) -> str:
    m = _clip(f"{w}e0 * xs_{x} + {1 - w!r}e0 * ({a})")
    return f"CASE WHEN ({a}) IS NULL THEN NULL WHEN xs_{x} IS NULL THEN ({a}) ELSE SIGN({m}) * FLOOR(ABS({m}) * 10000 + 0.5e0) / 10000 END"


def _case(c: str, *steps: tuple[str, float], other: float | str) -> str:
    return f"CAST(CASE WHEN {c} IS NULL THEN NULL " + " ".join(f"WHEN {c} {s} THEN {v}" for s, v in steps) + f" ELSE {other} END AS DOUBLE)"


def _safe(x: str) -> str:
    """A clamp that keeps nulls."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN {_clip(x)} END"


_UP = "COALESCE(change_pct, 0) > 0"
_CONF = "CASE WHEN sentiment IS NOT NULL THEN LEAST(1e0, n_articles / 15e0) ELSE 0e0 END"
_PCT = "(CASE WHEN short_pct_float < 1 THEN short_pct_float * 100 ELSE short_pct_float END)"
_IV = "(CASE WHEN iv <= 3 THEN iv * 100 ELSE iv END)"
_REGIME = f"COALESCE({_case('iv_rank', ('>= 80', -0.5), ('>= 60', -0.2), ('>= 40', 0.0), ('>= 20', 0.2), other=0.4)}, {_case(_IV, ('< 20', 0.3), ('< 30', 0.1), ('< 45', -0.1), ('< 65', -0.3), other=-0.5)})"
_ADJUSTED = f"CASE WHEN beta > 0 THEN {_clip(f'{_REGIME} + LEAST(GREATEST((beta - 1) * -0.1, -0.2), 0.2)')} ELSE {_REGIME} END"
#: Parts of the signals, and the number that a full confidence asks for.
_PARTS = {
    "sentiment": ([(_blend(f"sentiment * (0.4e0 + 0.6e0 * ({_CONF}))", "sentiment"), 1.5), (_safe("moved * 2.5"), 1.0), ("CASE WHEN outlets IS NOT NULL THEN LEAST(1e0, (outlets - 1) / 3e0) * 0.5e0 * CASE WHEN COALESCE(sentiment, 0) >= 0 THEN 1 ELSE -1 END END", 0.4), (_blend("recency", "recency"), 1.2)], 4),
    "technical": ([(_blend(_safe("(position - 0.5) * 2"), "position"), 1.2), (_safe("change_pct / 5"), 0.6), (_blend("rating", "rating", 0.8), 1.0), (_blend(_safe("(from_high + 0.10) / 0.20"), "from_high"), 0.8)], 4),
    "momentum": ([(_case("rsi", (">= 80", 0.1), (">= 70", 0.5), (">= 60", 0.4), (">= 50", 0.15), (">= 40", -0.15), (">= 30", -0.4), (">= 20", -0.5), other=-0.1), 1.5), (_blend(_safe("slope / 0.5"), "slope"), 1.2),
        (_case("vol", ("< 20", 0.3), ("< 35", 0.1), ("< 55", -0.1), other=-0.4), 0.8), (f"SIGN(streak) * {_case('ABS(streak)', ('>= 5', 0.7), ('>= 4', 0.6), ('>= 3', 0.4), ('>= 2', 0.2), other=0.0)}", 0.9), (_blend(_safe("accel / 0.5"), "accel"), 1.0)], 1),
    "fundamental": ([(_blend(_case("pe", ("< 15", 0.6), ("< 25", 0.2), ("< 35", 0.0), ("< 50", -0.3), ("< 70", -0.6), other=-0.9), "pe"), 1.0), (_safe("mean_surprise / 10"), 1.2), ("CASE WHEN n_surprises >= 2 THEN (beat_share - 0.5) * 2 END", 0.8)], 3),
    "event": ([(_case("days", ("= 0", -0.6), ("= 1", -0.5), ("= 2", -0.4), ("= 3", -0.3), ("<= 7", -0.15), ("<= 21", 0.05), other=0.0), 1.2), (_safe("last_surprise / 15"), 1.0), (_case("from_high", (">= -0.02", 0.7), (">= -0.10", 0.3), other=0.0), 0.6)], 3),
    "short_interest": ([(_blend(f"CAST(CASE WHEN short_ratio >= 10 THEN CASE WHEN {_UP} THEN 0.6 ELSE -0.5 END WHEN short_ratio >= 5 THEN CASE WHEN {_UP} THEN 0.3 ELSE -0.2 END WHEN short_ratio >= 2 THEN 0.0 WHEN short_ratio IS NOT NULL THEN 0.1 END AS DOUBLE)", "squeeze", 0.4), 1.2), (f"CAST(CASE WHEN {_PCT} >= 20 THEN CASE WHEN {_UP} THEN 0.5 ELSE -0.4 END WHEN {_PCT} >= 10 THEN CASE WHEN {_UP} THEN 0.2 ELSE -0.2 END WHEN {_PCT} IS NOT NULL THEN 0.0 END AS DOUBLE)", 0.8)], 2),
    "analyst": ([(_blend(_safe("(3 - analyst_mean_score) / 2"), "mean_inverted", 0.8), 1.5), (_blend(_safe("upside / 20"), "upside"), 1.2)], 2),
}
_DIRECTION = f"CASE WHEN {_IV} < 30 AND {_UP} THEN 0.2 WHEN {_IV} > 50 AND COALESCE(change_pct, 0) < -2 THEN -0.3 ELSE 0 END"
_COUNTED = {k: " + ".join(f"CAST(({s}) IS NOT NULL AS INT)" for s, _ in parts) for k, (parts, _) in _PARTS.items()}
_SIGNALS = {k: _weighted(*parts) for k, (parts, _) in _PARTS.items()} | {
    "volume": _blend(f"{_case('volume_ratio', ('>= 3', 1.0), ('>= 2', 0.7), ('>= 1.5', 0.4), ('>= 0.8', 0.0), ('>= 0.5', -0.2), other=-0.4)} * CASE WHEN change_pct < 0 THEN -1 ELSE 1 END", "signed_ratio", 0.4),
    "options_iv": f"CASE WHEN {_REGIME} IS NOT NULL THEN ROUND({_clip(f'{_ADJUSTED} + {_DIRECTION}')}, 4) END",
}
_SIGNALS["momentum"] = f"CASE WHEN n_returns >= 5 THEN {_SIGNALS['momentum']} END"
_CONFS = {k: f"LEAST(1e0, ({n}) / {_PARTS[k][1]}e0)" for k, n in _COUNTED.items()} | {
    "sentiment": f"CASE WHEN ({_COUNTED['sentiment']}) > 0 THEN LEAST(1e0, ({_CONF} + LEAST(1e0, ({_COUNTED['sentiment']}) / 4e0)) / 2) ELSE 0 END",
    "momentum": "CASE WHEN n_returns >= 5 THEN LEAST(1e0, n_returns / 60e0) ELSE 0 END", "volume": "CASE WHEN volume_ratio IS NOT NULL THEN LEAST(1e0, ABS(volume_ratio - 1)) END",
    "options_iv": "CASE WHEN iv_rank IS NOT NULL THEN 0.8 WHEN iv IS NOT NULL THEN 0.25 ELSE 0 END",
}



def _scored(sign: str, ranks: str) -> str:
    """All from sides to the structure."""
    sums = lambda what: " + ".join(f"CASE WHEN {k}_conf >= {M.FLOOR} THEN {what.format(k=k, w=w)} ELSE 0 END" for k, w in M.WEIGHTS.items())
    return f"""(WITH f AS MATERIALIZED (SELECT *, CAST(next_report - DATE '{DAY[:10]}' AS INT) AS days FROM {_from(sign)}), x AS MATERIALIZED (SELECT *, {ranks} FROM f),
    s AS MATERIALIZED (SELECT x.* EXCLUDE (sentiment), {", ".join(f"CAST({_SIGNALS[k]} AS DOUBLE) AS s_{k}, COALESCE(ROUND(CAST({_CONFS[k]} AS DOUBLE), 3), 0) AS {k}_conf" for k in M.WEIGHTS)} FROM x),
    c AS (SELECT *, COALESCE({_tidy(_clip(f"({sums('s_{k} * {w}e0 * {k}_conf')}) / NULLIF({sums('{w}e0 * {k}_conf')}, 0)"))}, 0) AS score, ROUND({sums('{w}e0')}, 3) AS coverage, CONCAT_WS(',', {", ".join(f"CASE WHEN {k}_conf < {M.FLOOR} THEN '{k}' END" for k in M.WEIGHTS)}) AS skipped FROM s),
    d AS (SELECT *, CASE WHEN score >= 0.2 THEN 'bullish' WHEN score <= -0.2 THEN 'bearish' ELSE 'neutral' END AS direction, CASE WHEN iv_rank IS NULL OR iv_basis <> 'chain' THEN 'unknown' WHEN iv_rank >= 70 THEN 'high' WHEN iv_rank <= 30 THEN 'low' ELSE 'mid' END AS iv_class FROM c)
    SELECT *, CASE WHEN days BETWEEN 0 AND 3 THEN 'none' WHEN direction = 'neutral' THEN CASE WHEN iv_class = 'high' THEN 'iron_condor' ELSE 'none' END WHEN iv_class = 'high' THEN CASE direction WHEN 'bullish' THEN 'bull_put_spread' ELSE 'bear_call_spread' END WHEN direction = 'bullish' THEN 'bull_call_spread' ELSE 'bear_put_spread' END AS structure,
      CASE WHEN score > 0.5 THEN 'STRONG BUY' WHEN score > 0.2 THEN 'BULLISH' WHEN score > -0.2 THEN 'NEUTRAL' WHEN score > -0.5 THEN 'BEARISH' ELSE 'STRONG SELL' END AS label,
      CASE WHEN n >= 30 THEN ROUND({_clip('score * LEAST(GREATEST(1 + 0.15 * LEAST(1.0, n / 60.0) * (accuracy - 0.5) * 2, 0.5), 1.5)')}, 4) END AS would_be FROM d)"""


_OUT = "ticker, " + ", ".join(f"ROUND(s_{k}, 4) AS {k}, ROUND({k}_conf, 4) AS {k}_conf" for k in M.WEIGHTS) + ", score, coverage, skipped, label, days AS days_to_earnings, structure"


def _columns(df):
    signal = lambda k: F.col(f"{k}_signal" if f"{k}_signal" in df.columns else k).alias(k)
    return df.select("ticker", *[c for k in M.WEIGHTS for c in (signal(k), F.col(f"{k}_conf"))], "score", "coverage", F.array_join("skipped", ",").alias("skipped"), "label", "days_to_earnings", "structure", *[c for c in ("would_be",) if c in df.columns])


@query("p01_features", f"SELECT ticker, {r(**{f: f for f in B.RANKED})} FROM {_from('> 0')}")
def _(get):
    return B.features(gathered(get)).select("ticker", *[F.col(f).cast("double").alias(f) for f in B.RANKED])


@query("w23_ranked_basket", f"SELECT ticker, {', '.join(f'xs_{f}' for f in B.RANKED)} FROM (SELECT *, {_RANKS} FROM {_from('> 0')})", 4)
def _(get):
    return B.ranked(B.features(gathered(get))).select("ticker", *[f"xs_{f}" for f in B.RANKED])


@query("m11_basket", f"SELECT {_OUT}, would_be FROM {_scored('> 0', _RANKS)}", 4)
def _(get):
    """Every ticker of the basket with its nine signals, their composite, the structure to look for and what feedback would make of it."""
    return _columns(B.basket_tradeability(gathered(get)))


@query("m24_review", f"SELECT {_OUT} FROM {_scored('<= 0', _NONE)}", 4)
def _(get):
    """Tickers outside the basket, without ranks."""
    return _columns(B.review(gathered(get, inside=False))).drop("would_be")
