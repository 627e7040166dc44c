"""All queries of the library and their SQL, by name.

A query is named after the row of the operator inventory that it covers.  Doubles are rounded once, at the end, on
both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import options as O
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import signals as M
from ..operators import windows as W
from ..sources.fixtures import inline, table
from ..streaming import streams as X

DIGITS = 6
AS_OF = "2024-01-15 00:00:00"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register ``f(get)``, where ``get`` gives a table by name."""

    def add(f: Callable) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: rounded(f(lambda t: table(spark, sf_dir, t)), digits)
        if sql:
            _SQL[name] = inline(sql)
        return f

    return add


def r(**columns: str) -> str:
    return ", ".join(f"ROUND({e}, {DIGITS}) AS {n}" for n, e in columns.items())


KEY = ["ticker", "session_no"]
OVER = "OVER (PARTITION BY ticker ORDER BY session_no"
RET = "WITH b AS (SELECT *, (close / LAG(close) OVER (PARTITION BY ticker ORDER BY session_no) - 1) * 100 AS ret FROM {bars})"


def rows(n: int, end: int = 0) -> str:
    return f"{OVER} ROWS BETWEEN {n - 1 + end} PRECEDING AND {f'{end} PRECEDING' if end else 'CURRENT ROW'})"


def guard(n: int, value: str) -> str:
    return f"CASE WHEN COUNT(close) {rows(n)} = {n} THEN {value} END"


# --- windows -------------------------------------------------------------------------------------------------------


@query("w01_returns", f"SELECT ticker, session_no, {r(ret_1=f'close / LAG(close, 1) {OVER}) - 1', ret_5=f'close / LAG(close, 5) {OVER}) - 1', ret_20=f'close / LAG(close, 20) {OVER}) - 1')} FROM {{bars}}")
def _(get):
    return get("bars").select(*KEY, *[W.ret(n).alias(f"ret_{n}") for n in (1, 5, 20)])


@query("w03_high_low", f"SELECT ticker, session_no, MAX(high) {rows(252)} AS high_n, MIN(low) {rows(252)} AS low_n FROM {{bars}}", 9)
def _(get):
    return get("bars").select(*KEY, *[c.alias(n) for n, c in W.high_low().items()])


@query("w04_volume_ratio", f"SELECT ticker, session_no, {r(volume_ratio=f'volume / AVG(volume) {rows(30)}')} FROM {{bars}}")
def _(get):
    return get("bars").select(*KEY, W.volume_ratio().alias("volume_ratio"))


@query("w05_rvol", f"SELECT ticker, session_no, {r(rvol=guard(20, f'volume / AVG(volume) {rows(20)}'))} FROM {{bars}}")
def _(get):
    return get("bars").select(*KEY, W.rvol().alias("rvol"))


@query("w06_rvol_prior", f"SELECT ticker, session_no, {r(rvol=f'CASE WHEN COUNT(volume) {rows(20, 1)} >= 5 THEN volume / AVG(volume) {rows(20, 1)} END')} FROM {{bars}}")
def _(get):
    return get("bars").select(*KEY, W.rvol_prior().alias("rvol"))


@query("w07_sma", f"SELECT ticker, session_no, {r(**{f'sma_{n}': guard(n, f'AVG(close) {rows(n)}') for n in (20, 50, 200)}).replace(', 6)', ', 9)')} FROM {{bars}}", 9)
def _(get):
    return get("bars").select(*KEY, *[W.sma(n).alias(f"sma_{n}") for n in (20, 50, 200)])


@query(
    "w08_ema_w10_rsi",
    f"""WITH RECURSIVE b AS (SELECT ticker, session_no, close FROM {{bars}}), e AS (
    SELECT ticker, session_no, close, close AS e9, close AS e20, close AS e50, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l FROM b WHERE session_no = 1
    UNION ALL SELECT b.ticker, b.session_no, b.close, e.e9 + (b.close - e.e9) * 2 / 10, e.e20 + (b.close - e.e20) * 2 / 21, e.e50 + (b.close - e.e50) * 2 / 51,
      CASE WHEN e.g IS NULL THEN GREATEST(b.close - e.close, 0) ELSE e.g * 13 / 14 + GREATEST(b.close - e.close, 0) / 14 END,
      CASE WHEN e.l IS NULL THEN GREATEST(e.close - b.close, 0) ELSE e.l * 13 / 14 + GREATEST(e.close - b.close, 0) / 14 END
    FROM e JOIN b ON b.ticker = e.ticker AND b.session_no = e.session_no + 1)
    SELECT ticker, session_no, {r(ema_9='e9', ema_20='e20', ema_50='e50', rsi='CASE WHEN l <> 0 THEN 100 - 100 / (1 + g / l) END')} FROM e""",
)
def _(get):
    return W.smoothers(get("bars"))


@query(
    "w09_wilder_rsi",
    RET
    + f""", v AS (SELECT ticker, session_no, LIST(ret) FILTER (WHERE ret IS NOT NULL) {rows(120)} AS v FROM b),
    s AS (SELECT ticker, session_no, v, LIST_REDUCE(LIST_TRANSFORM(LIST_CONCAT([LIST_SUM(LIST_TRANSFORM(v[1:14], lambda x: GREATEST(x, 0))) / 14], LIST_TRANSFORM(v[15:], lambda x: GREATEST(x, 0))), lambda x: CAST(x AS DOUBLE)), lambda a, x: (a * 13 + x) / 14) AS g,
      LIST_REDUCE(LIST_TRANSFORM(LIST_CONCAT([LIST_SUM(LIST_TRANSFORM(v[1:14], lambda x: GREATEST(-x, 0))) / 14], LIST_TRANSFORM(v[15:], lambda x: GREATEST(-x, 0))), lambda x: CAST(x AS DOUBLE)), lambda a, x: (a * 13 + x) / 14) AS l FROM v WHERE LEN(v) >= 15)
    SELECT ticker, session_no, {r(rsi='CASE WHEN l = 0 THEN 100 WHEN g = 0 THEN 0 ELSE 100 - 100 / (1 + g / l) END')} FROM s""",
)
def _(get):
    return W.run_features(W.with_returns(get("bars").select(*KEY, "close"))).select(*KEY, "rsi").where("rsi is not null")


@query(
    "w12_atr",
    f"""WITH b AS (SELECT *, high - low AS hl, GREATEST(high - low, ABS(high - LAG(close) {OVER})), ABS(low - LAG(close) {OVER}))) AS tr FROM {{bars}})
    SELECT ticker, session_no, {r(atr=f'CASE WHEN COUNT(close) {rows(14)} < 2 THEN 0 ELSE (SUM(tr) {rows(14)} - FIRST_VALUE(tr) {rows(14)} + FIRST_VALUE(hl) {rows(14)}) / COUNT(close) {rows(14)} END')} FROM b""",
)
def _(get):
    return W.atr(get("bars")).select(*KEY, "atr")


@query("w14_slope_w15_acceleration", RET + f" SELECT ticker, session_no, {r(slope=f'CASE WHEN COUNT(ret) {rows(14)} >= 5 THEN REGR_SLOPE(ret, session_no) {rows(14)} END', accel=f'CASE WHEN COUNT(ret) {rows(14)} >= 5 THEN AVG(ret) {rows(5)} - AVG(ret) {rows(14)} END')} FROM b")
def _(get):
    return W.with_returns(get("bars")).select(*KEY, W.slope().alias("slope"), W.acceleration().alias("accel"))


@query("w16_momentum_acceleration", f"SELECT ticker, session_no, {r(acceleration=f'(close / LAG(close, 5) {OVER}) - 1) - (close / LAG(close, 20) {OVER}) - 1) / 4')} FROM {{bars}}")
def _(get):
    return get("bars").select(*KEY, (W.ret(5) - W.ret(20) / 4).alias("acceleration"))


@query("w17_annual_vol", RET + f" SELECT ticker, session_no, {r(vol=f'CASE WHEN COUNT(ret) {rows(30)} >= 10 THEN STDDEV_SAMP(ret) {rows(30)} * SQRT(252) END')} FROM b")
def _(get):
    return W.with_returns(get("bars")).select(*KEY, W.annual_vol().alias("vol"))


@query("w18_realized_vol", f"WITH b AS (SELECT *, LN(close / LAG(close) {OVER})) AS lr FROM {{bars}}) SELECT ticker, session_no, {r(realized_vol=f'CASE WHEN COUNT(lr) {rows(30)} >= 9 THEN STDDEV_SAMP(lr) {rows(30)} * SQRT(252) END')} FROM b")
def _(get):
    return W.realized_vol(get("bars")).select(*KEY, "realized_vol")


@query(
    "w19_streak",
    RET
    + f""", v AS (SELECT ticker, session_no, LIST_REVERSE(LIST(ret) FILTER (WHERE ret IS NOT NULL) {rows(14)}) AS v FROM b)
    SELECT ticker, session_no, CAST(CASE WHEN v[1] >= 0 THEN 1 ELSE -1 END * COALESCE(LIST_POSITION(LIST_TRANSFORM(v, lambda x: (x >= 0) = (v[1] >= 0)), false) - 1, LEN(v)) AS INT) AS streak FROM v WHERE LEN(v) > 0""",
)
def _(get):
    return W.run_features(W.with_returns(get("bars").select(*KEY, "close"))).select(*KEY, "streak").where("streak is not null")


@query(
    "w20_support_resistance",
    f"""WITH t AS (SELECT *, CASE WHEN COUNT(close) {OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 AND high = MAX(high) {OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) THEN high END AS top,
      CASE WHEN COUNT(close) {OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 AND low = MIN(low) {OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) THEN low END AS dip FROM {{bars}})
    SELECT a.ticker, a.session_no, {r(resistance='MIN(CASE WHEN t.top > a.close THEN t.top END)', support='MAX(CASE WHEN t.dip < a.close THEN t.dip END)')}
    FROM {{bars}} a LEFT JOIN t ON t.ticker = a.ticker AND t.session_no BETWEEN a.session_no - 11 AND a.session_no - 2 GROUP BY a.ticker, a.session_no""",
)
def _(get):
    return W.support_resistance(get("bars")).select(*KEY, "resistance", "support")


@query("w21_forward_returns", f"SELECT ticker, session_no, {r(**{f'fwd_{h}': f'LEAD(close, {h}) {OVER}) / close - 1' for h in (5, 10, 21, 63)})} FROM {{bars}}")
def _(get):
    return get("bars").select(*KEY, *[W.forward(h).alias(f"fwd_{h}") for h in (5, 10, 21, 63)])


@query(
    "w22_percentile_score",
    f"""WITH g AS (SELECT ticker, trade_date, CAST(volume AS DOUBLE) AS v, COUNT(volume) OVER (PARTITION BY trade_date) AS n, RANK() OVER (PARTITION BY trade_date ORDER BY volume) - 1 AS k,
      COUNT(*) OVER (PARTITION BY trade_date, volume) - 1 AS ties, MIN(volume) OVER (PARTITION BY trade_date) = MAX(volume) OVER (PARTITION BY trade_date) AS flat FROM {{bars}})
    SELECT ticker, trade_date, ROUND(CASE WHEN n >= 6 THEN CASE WHEN flat THEN 0 ELSE (k + ties / 2.0) / (n - 1) * 2 - 1 END END, 4) AS xs FROM g""",
)
def _(get):
    return get("bars").select("ticker", "trade_date", W.percentile_score(F.col("volume"), ["trade_date"]).alias("xs"))


@query("w25_percentile_last", f"WITH v AS (SELECT ticker, session_no, close, LIST(close) {rows(60)} AS v FROM {{bars}}) SELECT ticker, session_no, {r(pct='CASE WHEN LEN(v) >= 20 THEN LEN(LIST_FILTER(v, lambda x: x <= close)) * 100.0 / LEN(v) END')} FROM v")
def _(get):
    return get("bars").select(*KEY, W.percentile_last("close", 60).alias("pct"))


_IV = "(SELECT ticker, trade_date AS snapshot_date, 0.2 + ((ticker * 31 + session_no * 17) % 97) / CAST(400 AS DOUBLE) AS iv FROM {bars} WHERE session_no % 7 = 0)"


@query(
    "w24_iv_rank",
    f"""WITH s AS {_IV}, a AS (SELECT s.ticker, s.snapshot_date, s.iv, MIN(p.iv) AS lo, MAX(p.iv) AS hi, COUNT(*) AS n, COUNT(*) FILTER (WHERE p.iv < s.iv) AS below
      FROM s JOIN s p ON p.ticker = s.ticker AND p.snapshot_date BETWEEN s.snapshot_date - 365 AND s.snapshot_date GROUP BY s.ticker, s.snapshot_date, s.iv)
    SELECT ticker, snapshot_date, ROUND(iv, 6) AS iv, ROUND(lo, 6) AS low, ROUND(hi, 6) AS high, ROUND(CASE WHEN n >= 20 THEN CASE WHEN hi - lo > 1e-9 THEN (iv - lo) / (hi - lo) * 100 ELSE 50 END END, 4) AS iv_rank, ROUND(CASE WHEN n >= 20 THEN below * 100.0 / n END, 4) AS iv_percentile, n AS days FROM a""",
)
def _(get):
    """Chain snapshots of every seventh session, so that a year holds enough of them."""
    iv = get("bars").where("session_no % 7 = 0").select("ticker", F.col("trade_date").alias("snapshot_date"), F.expr("0.2D + ((ticker * 31 + session_no * 17) % 97) / 400D").alias("iv"))
    return M.iv_rank(iv).select("ticker", "snapshot_date", "iv", "low", "high", F.round("iv_rank", 4).alias("iv_rank"), F.round("iv_percentile", 4).alias("iv_percentile"), "days")


# --- signals and backtest --------------------------------------------------------------------------------------------


@query("composite_score_panel")
def composite_score_panel(get):
    """M02, M03, M06, W23, M10 and F14 over every ticker and date."""
    return M.score_panel(get("bars")).select("ticker", "trade_date", "technical", "momentum", "volume_signal", "score", "coverage", "label")


@query("v03_panel_backtest")
def _(get):
    return M.backtest(get("bars"))


@query("v04_backtest_summary")
def _(get):
    return A.backtest_summary(M.backtest(get("bars")))


@query(
    "a06_breadth",
    f"""WITH p AS (SELECT *, {', '.join(f"{guard(n, f'AVG(close) {rows(n)}')} AS sma_{n}" for n in (20, 50, 200))}, close / LAG(close, 5) {OVER}) - 1 AS ret_5, close / LAG(close, 20) {OVER}) - 1 AS ret_20 FROM {{bars}}),
    g AS (SELECT trade_date, {', '.join(f'AVG(CAST(close > sma_{n} AS INT)) * 100 AS above_{n}' for n in (20, 50, 200))}, AVG(CAST(ret_5 > 0 AS INT)) * 100 AS up_5, AVG(CAST(ret_20 > 0 AS INT)) * 100 AS up_20, COUNT(*) AS total, COUNT(sma_20) AS usable FROM p GROUP BY trade_date)
    SELECT trade_date, {r(above_20='above_20', above_50='above_50', above_200='above_200', up_5='up_5', up_20='up_20', confidence='usable / total')}, total, usable,
      {r(score="(COALESCE(above_20 / 50 - 1, 0) + COALESCE(above_50 / 50 - 1, 0) + COALESCE(above_200 / 50 - 1, 0) + COALESCE(up_5 / 50 - 1, 0) + COALESCE(up_20 / 50 - 1, 0)) / NULLIF(CAST(above_20 IS NOT NULL AS INT) + CAST(above_50 IS NOT NULL AS INT) + CAST(above_200 IS NOT NULL AS INT) + CAST(up_5 IS NOT NULL AS INT) + CAST(up_20 IS NOT NULL AS INT), 0)")} FROM g""",
)
def _(get):
    return A.breadth(get("bars").select("ticker", "trade_date", "close", *[W.sma(n).alias(f"sma_{n}") for n in (20, 50, 200)], *[W.ret(n).alias(f"ret_{n}") for n in (5, 20)]))


# --- point-in-time joins ---------------------------------------------------------------------------------------------

_LAST_PREDICTION = "FROM {trades} t ASOF LEFT JOIN {predictions} p ON t.ticker = p.ticker AND t.opened_date >= p.prediction_date"


@query("j03_asof_prediction", f"SELECT t.id, t.ticker, t.opened_date, p.prediction_date, p.score {_LAST_PREDICTION}")
def _(get):
    return J.asof_join(get("trades").select("id", "ticker", "opened_date"), get("predictions").select("ticker", "prediction_date", "score"), ["ticker"], "opened_date", "prediction_date")


@query(
    "j06_interval_momentum",
    """SELECT t.id, COUNT(e.external_id) AS events, COUNT(*) FILTER (WHERE e.action_company = 'Upgrades') AS upgrades FROM {trades} t
    LEFT JOIN {analyst_rating_events} e ON e.ticker = t.ticker AND CAST(e.published_at AS DATE) BETWEEN DATE '2024-01-01' + CAST(t.holding_days AS INT) - 30 AND DATE '2024-01-01' + CAST(t.holding_days AS INT) GROUP BY t.id""",
)
def _(get):
    trades = get("trades").select("id", "ticker", F.date_add(F.lit("2024-01-01").cast("date"), F.col("holding_days").cast("int")).alias("at"))
    events = get("analyst_rating_events").select("ticker", "external_id", "published_at", "action_company")
    hits = J.interval_join(trades, events, ["ticker"], "at", "published_at", 30).groupBy("id").agg(F.count("external_id").alias("events"), F.count_if(F.col("action_company") == "Upgrades").alias("upgrades"))
    return trades.select("id").join(hits, "id", "left").na.fill(0)


_OUTCOMES = """(SELECT a.ticker, a.prediction_date, a.score, a.base_close, o.close AS outcome_close, ROUND((o.close / a.base_close - 1) * 100, 4) AS actual_return
    FROM (SELECT p.ticker, p.prediction_date, p.score, b.session_no, b.close AS base_close FROM {predictions} p ASOF LEFT JOIN {bars} b ON p.ticker = b.ticker AND p.prediction_date >= b.trade_date) a
    LEFT JOIN {bars} o ON o.ticker = a.ticker AND o.session_no = a.session_no + 5)"""


def _outcomes(get) -> DataFrame:
    return A.resolved(J.forward_outcome(get("predictions"), get("bars")))


@query("v08_resolve_outcomes", f"SELECT ticker, prediction_date, score, base_close, outcome_close, actual_return, COALESCE(SIGN(score) * SIGN(actual_return) > 0, false) AS direction_correct, {r(magnitude_error='ABS(actual_return - 3 * score)')} FROM {_OUTCOMES}")
def _(get):
    return _outcomes(get).select("ticker", "prediction_date", "score", "base_close", "outcome_close", "actual_return", "direction_correct", "magnitude_error")


@query(
    "a09_a10_accuracy",
    f"""WITH o AS (SELECT *, COALESCE(SIGN(score) * SIGN(actual_return) > 0, false) AS hit, ABS(actual_return - 3 * score) AS err FROM {_OUTCOMES} WHERE actual_return IS NOT NULL)
    SELECT ticker, COUNT(*) AS n, {r(accuracy='AVG(CAST(hit AS INT))', standard_error='SQRT(0.25 / COUNT(*))', bull_return='AVG(CASE WHEN score > 0.05 THEN actual_return END)', bear_return='AVG(CASE WHEN score < -0.05 THEN actual_return END)', mean_error='AVG(err)')},
      ABS(AVG(CAST(hit AS INT)) - 0.5) > 2 * SQRT(0.25 / COUNT(*)) AS significant FROM o GROUP BY GROUPING SETS ((ticker), ())""",
)
def _(get):
    return A.accuracy(_outcomes(get))


@query(
    "a14_calibration",
    f"""WITH o AS (SELECT *, COALESCE(SIGN(score) * SIGN(actual_return) > 0, false) AS hit, CASE WHEN score <= -1 THEN NULL WHEN score <= -0.5 THEN '(-1,-0.5]' WHEN score <= -0.2 THEN '(-0.5,-0.2]' WHEN score <= 0.2 THEN '(-0.2,0.2]' WHEN score <= 0.5 THEN '(0.2,0.5]' WHEN score <= 1 THEN '(0.5,1]' END AS bucket FROM {_OUTCOMES} WHERE actual_return IS NOT NULL)
    SELECT bucket, COUNT(*) AS n, {r(mean_return='AVG(actual_return)', accuracy_pct='AVG(CAST(hit AS INT)) * 100')} FROM o WHERE bucket IS NOT NULL GROUP BY bucket""",
)
def _(get):
    return A.calibration(_outcomes(get))


# --- aggregations ------------------------------------------------------------------------------------------------------

_NORMAL = "TRIM(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(LOWER(TRIM(headline)), '^(update|exclusive|breaking|correct(ed)?)\\s*\\d*\\s*[-:]\\s*', ''), '^[a-z .]{2,20}\\s+[-–—]\\s+', ''), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in A.SOURCE_WEIGHTS.items()) + " ELSE 1.0 END"
_STORIES = f"(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, CASE WHEN COALESCE(headline, '') = '' THEN CONCAT('#', id) ELSE {_NORMAL.replace('{2,20}', '{{2,20}}')} END ORDER BY {_WEIGHT} DESC, id) AS k FROM {{articles}}) WHERE k = 1)".replace("{{articles}}", "{articles}").replace("{{2,20}}", "{2,20}")


@query("f01_headline_key", f"SELECT id, CASE WHEN COALESCE(headline, '') = '' THEN '' ELSE SHA1({_NORMAL}) END AS headline_key FROM {{articles}}")
def _(get):
    return get("articles").select("id", S.headline_key(F.col("headline")).alias("headline_key"))


@query("f02_clean_text", "SELECT page_id, TRIM(REGEXP_REPLACE(REGEXP_REPLACE(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM {pages}")
def _(get):
    return get("pages").select("page_id", S.clean_text(F.col("html")).alias("body"))


@query("a01_weighted_sentiment", f"SELECT ticker, {r(sentiment=f'SUM(sentiment * {_WEIGHT}) / SUM({_WEIGHT})')}, COUNT(*) AS stories FROM {_STORIES} WHERE sentiment IS NOT NULL GROUP BY ticker")
def _(get):
    return A.weighted_sentiment(get("articles"))


@query("a02_source_breakdown", "SELECT ticker, source, COUNT(*) AS n, COUNT(*) OVER (PARTITION BY ticker) AS outlets FROM {articles} GROUP BY ticker, source")
def _(get):
    b = A.source_breakdown(get("articles"))
    return b.select("ticker", "outlets", F.explode("sources").alias("source", "n")).select("ticker", "source", "n", F.col("outlets").cast("long").alias("outlets"))


@query("a04_recency_sentiment", f"SELECT ticker, {r(recency=f'LEAST(GREATEST(SUM(sentiment * w) / SUM(w), -1), 1)')} FROM (SELECT *, EXP(-(EPOCH(TIMESTAMP '{AS_OF}') - FLOOR(EPOCH(COALESCE(CAST(published_at AS TIMESTAMP), TIMESTAMP '{AS_OF}')))) / 3600.0 / 48.0) AS w FROM {{articles}} WHERE sentiment IS NOT NULL) GROUP BY ticker")
def _(get):
    return A.recency_sentiment(get("articles"), AS_OF)


@query(
    "a08_analyst_momentum",
    """WITH e AS (SELECT *, CASE WHEN action_company = 'Upgrades' THEN 2.0 WHEN action_company = 'Downgrades' THEN -2.0 WHEN action_company = 'Initiates' THEN CASE WHEN rating_current IN ('Buy', 'Overweight') THEN 1.5 WHEN rating_current IN ('Sell', 'Underperform') THEN -1.5 ELSE 0 END ELSE 0 END
      + CASE action_pt WHEN 'Raises' THEN 1.0 WHEN 'Lowers' THEN -1.0 ELSE 0 END AS s FROM {analyst_rating_events}),
    g AS (SELECT ticker, CAST(SUM(s) AS DOUBLE) AS momentum, COUNT(*) FILTER (WHERE action_company = 'Upgrades') AS upgrades, COUNT(*) FILTER (WHERE action_company = 'Downgrades') AS downgrades, COUNT(*) FILTER (WHERE action_pt = 'Raises') AS raises, COUNT(*) FILTER (WHERE action_pt = 'Lowers') AS cuts FROM e GROUP BY ticker)
    SELECT *, CASE WHEN momentum >= 4 THEN 'STRONGLY POSITIVE' WHEN momentum >= 1.5 THEN 'POSITIVE' WHEN momentum <= -4 THEN 'STRONGLY NEGATIVE' WHEN momentum <= -1.5 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS state FROM g""",
)
def _(get):
    return A.analyst_momentum(get("analyst_rating_events"))


_METRICS = """(SELECT *, (exit_value - entry_value) * CASE WHEN entry_type = 'CREDIT' OR (instrument_type = 'STOCK' AND direction = 'BEARISH') THEN -1 ELSE 1 END * quantity * multiplier AS pnl,
    COALESCE(planned_max_loss, ABS(entry_value * quantity * multiplier)) AS risk FROM {trades})"""


@query("v05_trade_metrics", f"SELECT id, {r(pnl='pnl', risk='risk', return_on_risk='CASE WHEN risk <> 0 THEN pnl / risk * 100 END')} FROM {_METRICS}")
def _(get):
    return A.trade_metrics(get("trades")).select("id", "pnl", "risk", "return_on_risk")


@query("a13_trade_performance", f"SELECT COUNT(*) AS n, {r(net='SUM(pnl)', win_rate='AVG(CAST(pnl > 0 AS INT))', profit_factor='SUM(CASE WHEN pnl > 0 THEN pnl END) / -SUM(CASE WHEN pnl < 0 THEN pnl END)', expectancy='AVG(pnl)')}, COUNT(*) FILTER (WHERE pnl > 0) AS wins FROM {_METRICS} WHERE status = 'CLOSED'")
def _(get):
    return A.performance(A.trade_metrics(get("trades")))


@query(
    "a15_attribution",
    f"""WITH m AS (SELECT *, CASE WHEN risk <> 0 THEN pnl / risk * 100 END AS ror FROM {_METRICS} WHERE status = 'CLOSED')
    SELECT 'strategy' AS dimension, COALESCE(strategy, 'Unknown') AS label, COUNT(*) AS n, {r(pnl_sum='SUM(pnl)', mean_ror='AVG(ror)')} FROM m GROUP BY 2
    UNION ALL SELECT 'direction', COALESCE(direction, 'Unknown'), COUNT(*), ROUND(SUM(pnl), 6), ROUND(AVG(ror), 6) FROM m GROUP BY 2
    UNION ALL SELECT 'entry_type', COALESCE(entry_type, 'Unknown'), COUNT(*), ROUND(SUM(pnl), 6), ROUND(AVG(ror), 6) FROM m GROUP BY 2""",
)
def _(get):
    return A.attribution(A.trade_metrics(get("trades")), ["strategy", "direction", "entry_type"])


@query("a16_portfolio_risk", f"SELECT ticker, {r(at_risk='SUM(risk)', share_pct='SUM(risk) / SUM(SUM(risk)) OVER () * 100')}, SUM(risk) / SUM(SUM(risk)) OVER () * 100 >= 35 AS flagged FROM {_METRICS} WHERE status = 'OPEN' GROUP BY ticker")
def _(get):
    return A.portfolio_risk(A.trade_metrics(get("trades")))


@query("w28_pnl_curve", f"SELECT id, {r(cumulative='SUM(pnl) OVER (PARTITION BY ticker ORDER BY opened_date + CAST(holding_days AS INT), id ROWS UNBOUNDED PRECEDING)')} FROM {_METRICS} WHERE status = 'CLOSED'")
def _(get):
    """A curve for each ticker; the one over all trades follows."""
    t = A.trade_metrics(get("trades")).where("status = 'CLOSED'")
    w = Window.partitionBy("ticker").orderBy(F.date_add("opened_date", F.col("holding_days").cast("int")), "id").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("id", F.sum("pnl").over(w).alias("cumulative"))


@query("w28_pnl_curve_all", f"SELECT id, ROUND(CAST(SUM(CAST(COALESCE(pnl, 0) AS DECIMAL(28, 8))) OVER (ORDER BY opened_date + CAST(holding_days AS INT) NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS DOUBLE), {DIGITS}) AS cumulative FROM {_METRICS} WHERE status = 'CLOSED'")
def _(get):
    return A.pnl_curve(A.trade_metrics(get("trades")))


@query("f13_surprise_pct", "SELECT ticker, seq, ROUND(CASE WHEN ABS(eps_estimate) >= 0.01 THEN LEAST(GREATEST((eps_actual - eps_estimate) / ABS(eps_estimate) * 100, CASE WHEN eps_actual IS NOT NULL THEN -200 END), 200 + 0 * eps_actual) END, 4) AS surprise FROM {earnings_events}")
def _(get):
    return get("earnings_events").select("ticker", "seq", S.surprise_pct(F.col("eps_actual"), F.col("eps_estimate")).alias("surprise"))


@query("f14_f15_labels", "SELECT ticker, prediction_date, CASE WHEN score > 0.5 THEN 'STRONG BUY' WHEN score > 0.2 THEN 'BULLISH' WHEN score > -0.2 THEN 'NEUTRAL' WHEN score > -0.5 THEN 'BEARISH' ELSE 'STRONG SELL' END AS setup, CASE WHEN score >= 0.2 THEN 'BULLISH' WHEN score <= -0.2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment FROM {predictions}")
def _(get):
    return get("predictions").select("ticker", "prediction_date", S.tradeability_label(F.col("score")).alias("setup"), S.sentiment_label(F.col("score")).alias("sentiment"))


@query("f07_weekdays", "SELECT id, CAST((SELECT COUNT(*) FROM RANGE(1, holding_days + 1) g(k) WHERE ISODOW(opened_date + CAST(k AS INT)) < 6) AS BIGINT) AS weekdays FROM {trades}")
def _(get):
    return get("trades").select("id", S.weekdays_between(F.col("opened_date"), F.date_add("opened_date", F.col("holding_days").cast("int"))).alias("weekdays"))


# --- top-k, sets, upserts ------------------------------------------------------------------------------------------------


@query("t01_latest_articles", "SELECT id, ticker FROM {articles} QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY published_at DESC NULLS LAST, id DESC) <= 5")
def _(get):
    return J.latest_n(get("articles"), ["ticker"], [F.desc_nulls_last("published_at"), F.desc("id")], 5).select("id", "ticker")


@query("j01_latest_price", "SELECT ticker, trade_date, close FROM {bars} QUALIFY RANK() OVER (PARTITION BY ticker ORDER BY trade_date DESC) = 1")
def _(get):
    return J.latest_per_key(get("bars"), ["ticker"], "trade_date", ties="all").select("ticker", "trade_date", "close")


@query("u03_unique_stories", f"SELECT id, ticker FROM {_STORIES}")
def _(get):
    return A.unique_stories(get("articles")).select("id", "ticker")


@query("u05_merge_earnings", "SELECT ticker, period, COUNT(*) AS versions, ARG_MAX(eps_actual, seq) FILTER (WHERE eps_actual IS NOT NULL) AS eps_actual, ARG_MAX(eps_estimate, seq) AS eps_estimate, COUNT(eps_actual) = 0 AS is_upcoming FROM {earnings_events} GROUP BY ticker, period")
def _(get):
    e = get("earnings_events")
    return e.groupBy("ticker", "period").agg(F.count("*").alias("versions"), F.max_by("eps_actual", F.when(F.col("eps_actual").isNotNull(), F.col("seq"))).alias("eps_actual"), F.max_by("eps_estimate", "seq").alias("eps_estimate"), (F.count("eps_actual") == 0).alias("is_upcoming"))


@query("j13_insert_new", "SELECT id, url FROM {articles} a WHERE NOT EXISTS (SELECT 1 FROM {articles} b WHERE b.url = a.url AND b.id % 3 = 0) AND id % 3 <> 0 AND url IS NOT NULL")
def _(get):
    a = get("articles").where("url is not null").select("id", "url")
    return J.insert_new(a.where("id % 3 <> 0"), a.where("id % 3 = 0"), ["url"]).select("id", "url")


# --- options ---------------------------------------------------------------------------------------------------------------


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.5 * ABS({x}) / 1.4142135623730951))"
    poly = "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({c} + {t} * {poly})"
    tail = f"(0.5 * {t} * EXP(-{x} * {x} / 2 + {poly}))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


_D = "(SELECT *, (LN(underlying_price / strike) + (0.042 + iv * iv / 2) * t) / (iv * SQRT(t)) AS d1, (LN(underlying_price / strike) + (0.042 + iv * iv / 2) * t) / (iv * SQRT(t)) - iv * SQRT(t) AS d2 FROM (SELECT *, dte / CAST(365 AS DOUBLE) AS t FROM {option_chain} WHERE iv IS NOT NULL))"
_N = f"(SELECT *, {_cdf('d1')} AS n1, {_cdf('d2')} AS n2 FROM {_D})"
_CHAIN_KEY = "ticker, trade_date, expiration, opt_right, strike"


@query(
    "o01_o02_greeks",
    f"""SELECT {_CHAIN_KEY}, ROUND(CASE opt_right WHEN 'C' THEN underlying_price * n1 - strike * EXP(-0.042 * t) * n2 ELSE strike * EXP(-0.042 * t) * (1 - n2) - underlying_price * (1 - n1) END, 5) AS price,
    ROUND(CASE opt_right WHEN 'C' THEN n1 ELSE n1 - 1 END, 5) AS delta, ROUND(EXP(-d1 * d1 / 2) / 2.5066282746310002 / (underlying_price * iv * SQRT(t)), 5) AS gamma, ROUND(underlying_price * EXP(-d1 * d1 / 2) / 2.5066282746310002 * SQRT(t) / 100, 5) AS vega FROM {_N}""",
    5,
)
def _(get):
    return O.with_greeks(get("option_chain").where("iv is not null")).select("ticker", "trade_date", "expiration", "opt_right", "strike", "price", "delta", "gamma", "vega")


@query("p04_liquidity", "SELECT ticker, trade_date, COUNT(*) AS quotes, COUNT(*) FILTER (WHERE bid >= 0.05 AND open_interest >= 100 AND volume >= 10 AND (ask - bid) / ((ask + bid) / 2) <= 0.10) AS strict FROM {option_chain} GROUP BY ticker, trade_date")
def _(get):
    spread = (F.col("ask") - F.col("bid")) / F.nullif((F.col("ask") + F.col("bid")) / 2, F.lit(0.0))
    ok = (F.col("bid") >= 0.05) & (F.col("open_interest") >= 100) & (F.col("volume") >= 10) & spread.isNotNull() & (spread <= 0.10)
    return get("option_chain").groupBy("ticker", "trade_date").agg(F.count("*").alias("quotes"), F.count_if(ok).alias("strict"))


@query("t05_nearest_expiry", "SELECT ticker, trade_date, ARG_MIN(dte, ABS(dte - 30) * 1000 + dte) AS dte FROM {option_chain} WHERE dte BETWEEN 7 AND 60 GROUP BY ticker, trade_date")
def _(get):
    return get("option_chain").where("dte between 7 and 60").groupBy("ticker", "trade_date").agg(F.min_by("dte", F.struct(F.abs(F.col("dte") - 30), "dte")).alias("dte"))


@query(
    "a22_atm_iv",
    """WITH k AS (SELECT ticker, trade_date, dte, iv, ROW_NUMBER() OVER (PARTITION BY ticker, trade_date, dte, opt_right ORDER BY ABS(strike - underlying_price), strike) AS k FROM {option_chain} WHERE iv > 0.01 AND iv < 3)
    SELECT ticker, trade_date, dte, ROUND(MEDIAN(iv), 6) AS atm_iv FROM k WHERE k <= 2 GROUP BY ticker, trade_date, dte""",
)
def _(get):
    near = J.latest_n(get("option_chain").where("iv > 0.01 and iv < 3"), ["ticker", "trade_date", "dte", "opt_right"], [F.abs(F.col("strike") - F.col("underlying_price")), F.col("strike")], 2)
    return near.groupBy("ticker", "trade_date", "dte").agg(F.median("iv").alias("atm_iv"))


@query("o03_implied_vol")
def _(get):
    """The volatility behind each model price, from the price alone."""
    c = O.with_greeks(get("option_chain").where("iv is not null")).select("ticker", "trade_date", "expiration", "opt_right", "strike", "underlying_price", F.round("iv", 3).alias("iv"), "price", (F.col("dte") / F.lit(365.0)).alias("t"))
    return O.with_implied_vol(c, "price").select("ticker", "trade_date", "expiration", "opt_right", "strike", "iv", F.round("found", 3).alias("found"))


# --- streaming forms, on the whole table ------------------------------------------------------------------------------------

_SLOT = "EPOCH_MS(CAST(FLOOR(EPOCH(CAST(ts AS TIMESTAMP)) / 300) AS BIGINT) * 300000)"


@query("x04_tick_bars", f"SELECT ticker, {_SLOT} AS start, ARG_MIN(price, ROW(ts, event_id)) AS open, MAX(price) AS high, MIN(price) AS low, ARG_MAX(price, ROW(ts, event_id)) AS close, CAST(SUM(size) AS BIGINT) AS volume FROM {{ticks}} GROUP BY ticker, {_SLOT}")
def _(get):
    return X.bars(get("ticks"))


@query(
    "x08_activity_sessions",
    """WITH g AS (SELECT ticker, ts, CASE WHEN ts <= LAG(ts) OVER (PARTITION BY ticker ORDER BY ts, event_id) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new, event_id FROM {ticks}),
    s AS (SELECT ticker, ts, SUM(new) OVER (PARTITION BY ticker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT ticker, MIN(ts) AS start, MAX(ts) + INTERVAL 30 MINUTES AS "end", COUNT(*) AS n FROM s GROUP BY ticker, k""",
)
def _(get):
    return X.activity(get("ticks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from . import basket, contracts, context, markup, market, payloads, states, terminal  # noqa: E402, F401  these register the rest
