"""Queries over states, dates, texts and folds of the market inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import merges as G
from ..operators import technical as T
from ..operators import windows as W
from .registry import OVER, query, r, rows

CALENDAR_DAY = "2020-11-01"
REPORTS_DAY = "1998-06-01"

# --- labels --------------------------------------------------------------------------------------------------------------


@query(
    "f16_direction",
    """SELECT ticker, prediction_date, CASE WHEN score >= 0.2 THEN 'bullish' WHEN score <= -0.2 THEN 'bearish' WHEN score IS NOT NULL THEN 'neutral' END AS direction,
      CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score >= 0.5 THEN 'STRONG BULL' WHEN score >= 0.2 THEN 'BULLISH' WHEN score <= -0.5 THEN 'STRONG BEAR' WHEN score <= -0.2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal,
      CASE WHEN ABS(score) < 0.2 THEN '<0.20' WHEN ABS(score) < 0.3 THEN '0.20–0.30' WHEN ABS(score) < 0.4 THEN '0.30–0.40' WHEN ABS(score) < 0.5 THEN '0.40–0.50' WHEN ABS(score) < 0.6 THEN '0.50–0.60' WHEN score IS NULL THEN 'Unknown' ELSE '0.60+' END AS bucket FROM {predictions}""",
)
def _(get):
    s = F.col("score")
    return get("predictions").select("ticker", "prediction_date", S.direction(s).alias("direction"), S.semantic_signal(s).alias("signal"), S.journal_score_bucket(s).alias("bucket"))


@query(
    "f17_iv_states",
    """SELECT ticker, CASE WHEN iv_rank IS NULL THEN 'Unknown' WHEN iv_rank < 20 THEN '<20' WHEN iv_rank < 40 THEN '20–40' WHEN iv_rank < 60 THEN '40–60' WHEN iv_rank < 80 THEN '60–80' ELSE '80+' END AS bucket,
      CASE WHEN iv_rank IS NULL THEN 'UNKNOWN' WHEN iv_rank < 20 THEN 'VERY LOW' WHEN iv_rank < 40 THEN 'LOW' WHEN iv_rank < 60 THEN 'NORMAL' WHEN iv_rank < 80 THEN 'HIGH' ELSE 'VERY HIGH' END AS state FROM {snapshots}""",
)
def _(get):
    rank = F.col("iv_rank")
    return get("snapshots").select("ticker", S.journal_iv_bucket(rank).alias("bucket"), F.coalesce(S.iv_state(rank), F.lit("UNKNOWN")).alias("state"))


@query("p03_active_basket", "SELECT s_suppkey AS ticker, s_name AS name FROM {supplier} WHERE s_acctbal > 0")
def _(get):
    return get("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"))


# --- dates and texts -----------------------------------------------------------------------------------------------------


@query(
    "f08_parse_time",
    """SELECT event_id, STRFTIME(CASE event_id % 6 WHEN 5 THEN NULL WHEN 0 THEN DATE_TRUNC('day', ts) ELSE DATE_TRUNC('second', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM {events}""",
)
def _(get):
    """Every event's time, written in five layouts and one that is none, read back."""
    layouts = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "EEE, dd MMM yyyy HH:mm:ss Z", "yyyyMMdd'T'HHmmss")
    text = F.lit("no date")
    for i, layout in enumerate(layouts):
        text = F.when(F.col("event_id") % 6 == i, F.date_format(F.col("ts").cast("timestamp"), layout)).otherwise(text)
    return get("events").select("event_id", F.date_format(S.parse_time(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query(
    "f09_business_days",
    """SELECT id, ROUND(GREATEST(holding_days, 0) / CAST(365 AS DOUBLE), 6) AS years, CAST(LIST_FILTER(GENERATE_SERIES(CAST(opened_date + 1 AS TIMESTAMP), CAST(opened_date + CAST(2 * holding_days + 7 AS INT) AS TIMESTAMP), INTERVAL 1 DAY), lambda d: ISODOW(d) < 6)[holding_days] AS DATE) AS exit_day FROM {trades}""",
)
def _(get):
    return get("trades").select("id", (F.greatest("holding_days", F.lit(0)) / F.lit(365.0)).alias("years"), S.add_business_days(F.col("opened_date"), F.col("holding_days")).alias("exit_day"))


@query(
    "f10_infer_year",
    f"""SELECT id, CASE WHEN MONTH(event_date) = 2 AND DAY(event_date) = 29 THEN NULL ELSE CAST(MAKE_DATE(2020 + CASE WHEN o < -180 THEN 1 WHEN o > 180 THEN -1 ELSE 0 END, MONTH(event_date), DAY(event_date)) AS DATE) END AS inferred
    FROM (SELECT id, event_date, DATEDIFF('day', DATE '{CALENDAR_DAY}', MAKE_DATE(2020, MONTH(event_date), DAY(event_date))) AS o FROM {{macro_events}})""",
)
def _(get):
    """Calendar headers without a year, read around a day."""
    header = F.date_format("event_date", "EEEE, MMM. d")
    return get("macro_events").select("id", S.infer_year(header, F.lit(CALENDAR_DAY).cast("date")).alias("inferred"))


@query("f21_json_map", f"SELECT ticker, prediction_date, {r(score='score')}, horizon_days AS horizon FROM {{predictions}}")
def _(get):
    """Components written to a JSON map and read from it."""
    text = F.to_json(F.create_map(F.lit("score"), F.col("score"), F.lit("horizon"), F.col("horizon_days").cast("double")))
    back = F.from_json(text, "map<string,double>")
    return get("predictions").select("ticker", "prediction_date", back["score"].alias("score"), back["horizon"].cast("int").alias("horizon"))


@query(
    "f22_array_tail",
    f"""SELECT ticker, session_no, LEN(a) AS kept, {r(newest='LIST_REVERSE(a)[1]', total='LIST_SUM(a)')} FROM (SELECT ticker, session_no, LIST_FILTER(LIST(ret) {rows(5)}, lambda x: x IS NOT NULL) AS a FROM (SELECT *, close / LAG(close) {OVER}) - 1 AS ret FROM {{bars}}))""",
)
def _(get):
    tail = F.filter(F.collect_list("ret").over(W.last(5)), lambda x: x.isNotNull())
    b = get("bars").withColumn("ret", W.ret(1)).withColumn("a", tail)
    total = F.when(F.size("a") > 0, F.aggregate("a", F.lit(0.0), lambda s, x: s + x))
    return b.select("ticker", "session_no", F.size("a").cast("long").alias("kept"), F.get(F.reverse("a"), F.lit(0)).alias("newest"), total.alias("total"))


_RAW = "LOWER(CONCAT(COALESCE(headline, ''), ' ', COALESCE(body_snippet, '')))"


@query("j16_macro_articles", f"SELECT id, 'MARKET' AS ticker, published_at FROM {{articles}} WHERE {' OR '.join(f'CONTAINS({_RAW}, {w!r})' for w in S.MACRO_WORDS)}")
def _(get):
    """One scan with one alternation: no word holds a pattern sign."""
    raw = F.lower(F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("body_snippet", F.lit(""))))
    return get("articles").where(raw.rlike("|".join(S.MACRO_WORDS))).select("id", F.lit("MARKET").alias("ticker"), "published_at")


# --- trends --------------------------------------------------------------------------------------------------------------

_UP, _DOWN = "b.high - e.high", "e.low - b.low"
#: Moving averages and directional index as a recursion over sessions.
_SERIES = f"""(WITH RECURSIVE e AS (
  SELECT ticker, session_no, high, low, close, close AS e20, close AS e50, close AS e200, high - low AS tr, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS m, CAST(NULL AS DOUBLE) AS adx FROM {{bars}} WHERE session_no = 1
  UNION ALL SELECT ticker, session_no, high, low, close, e20, e50, e200, tr, p, m, CASE WHEN tr = 0 OR p + m = 0 THEN adx WHEN adx IS NULL THEN 100 * ABS(p - m) / (p + m) ELSE adx * 13 / 14 + 100 * ABS(p - m) / (p + m) / 14 END FROM (
    SELECT b.ticker, b.session_no, b.high, b.low, b.close, e.e20 + (b.close - e.e20) * 2 / 21 AS e20, e.e50 + (b.close - e.e50) * 2 / 51 AS e50, e.e200 + (b.close - e.e200) * 2 / 201 AS e200,
      e.tr * 13 / 14 + GREATEST(b.high - b.low, ABS(b.high - e.close), ABS(b.low - e.close)) / 14 AS tr,
      e.p * 13 / 14 + CASE WHEN {_UP} > {_DOWN} AND {_UP} > 0 THEN {_UP} ELSE 0 END / 14 AS p,
      e.m * 13 / 14 + CASE WHEN {_DOWN} > {_UP} AND {_DOWN} > 0 THEN {_DOWN} ELSE 0 END / 14 AS m, e.adx
    FROM e JOIN {{bars}} b ON b.ticker = e.ticker AND b.session_no = e.session_no + 1)) SELECT * FROM e)"""
_PANEL = f"""(SELECT * FROM (SELECT x.*, y.e20, y.e50, y.e200, y.adx FROM (SELECT *, (close / LAG(close, 5) {OVER}) - 1) * 100 AS r5, (close / LAG(close, 20) {OVER}) - 1) * 100 AS r20, (close / LAG(close, 60) {OVER}) - 1) * 100 AS r60,
  CASE WHEN COUNT(close) {rows(20)} = 20 THEN volume / AVG(volume) {rows(20)} END AS rvol, CASE WHEN COUNT(close) {rows(200)} = 200 THEN AVG(close) {rows(200)} END AS s200, MAX(session_no) OVER (PARTITION BY ticker) AS n FROM {{bars}}) x
  JOIN {_SERIES} y ON x.ticker = y.ticker AND x.session_no = y.session_no WHERE x.session_no = x.n))"""


@query("w11_adx", f"SELECT ticker, session_no, {r(ema_20='e20', ema_50='e50', ema_200='e200', adx='adx')} FROM {_SERIES}")
def _(get):
    return T.trend_series(get("bars"))


def _vote(cond: str, w: float) -> str:
    return f"({w} * CASE WHEN {cond} THEN 1 ELSE -1 END)"


_E = {s: f"CASE WHEN n >= {s} THEN e{s} END" for s in (20, 50, 200)}
_VOTES = [(f"close > {_E[20]}", "20", 0.25), (f"close > {_E[50]}", "50", 0.20), (f"({_E[20]}) > {_E[50]}", "50", 0.20), (f"({_E[50]}) > {_E[200]}", "200", 0.15)]
_PARTS = [(f"CASE WHEN n >= {n} THEN {_vote(c, w)} END", f"n >= {n}", w) for c, n, w in _VOTES]
_PARTS += [(f"0.1 * LEAST(GREATEST(r{d} / {size}, -1), 1)", f"r{d} IS NOT NULL", 0.1) for d, size in ((20, 10), (60, 20))]
_TOTAL = " + ".join(f"COALESCE({v}, 0)" for v, _, _ in _PARTS)
_WEIGHT = " + ".join(f"CASE WHEN {c} THEN CAST({w} AS DOUBLE) ELSE 0 END" for _, c, w in _PARTS)


@query("m12_index_trend", f"SELECT ticker, session_no, {r(score=f'CASE WHEN n >= 60 THEN ({_TOTAL}) / ({_WEIGHT}) END', confidence=f'CASE WHEN n >= 60 THEN LEAST({_WEIGHT}, 1) ELSE 0 END')} FROM {_PANEL}")
def _(get):
    return T.index_trend(get("bars"))


_UNKNOWN = "CASE WHEN n < 30 THEN 'UNKNOWN'"
_STRONG = "CASE WHEN adx >= 25 THEN 'STRONG ' ELSE '' END"
_STATES = f"""(WITH p AS (SELECT * FROM {_PANEL}), q AS (SELECT *, r5 - r20 / 4 AS accel, COALESCE(r20, 0) AS m20, r20 - (SELECT AVG(r20) FROM p WHERE ticker IN (1, 2)) AS rs FROM p)
  SELECT ticker, session_no, adx, rvol,
    {_UNKNOWN} WHEN close > e20 AND e20 > e50 AND (s200 IS NULL OR e50 > s200) THEN {_STRONG} || 'BULL' WHEN close < e20 AND e20 < e50 AND (s200 IS NULL OR e50 < s200) THEN {_STRONG} || 'BEAR' ELSE 'MIXED' END AS trend_state,
    {_UNKNOWN} WHEN accel IS NULL THEN 'UNKNOWN' WHEN accel > 1 AND m20 > 0 THEN 'ACCELERATING BULLISH' WHEN accel < -1 AND m20 < 0 THEN 'ACCELERATING BEARISH' WHEN m20 > 0 THEN 'POSITIVE' WHEN m20 < 0 THEN 'NEGATIVE' ELSE 'FLAT' END AS momentum_state,
    {_UNKNOWN} WHEN rs >= 5 THEN 'STRONG' WHEN rs >= 1 THEN 'POSITIVE' WHEN rs <= -5 THEN 'WEAK' WHEN rs <= -1 THEN 'LAGGING' ELSE 'NEUTRAL' END AS strength_state,
    {_UNKNOWN} WHEN rvol >= 1.5 THEN 'CONFIRMED' WHEN rvol >= 1.1 THEN 'ABOVE AVERAGE' WHEN rvol < 0.8 THEN 'WEAK' ELSE 'NORMAL' END AS volume_state FROM q)"""


@query("m17_technical_states", f"SELECT ticker, session_no, {r(adx='adx', rvol='rvol')}, trend_state, momentum_state, strength_state, volume_state FROM {_STATES}")
def _(get):
    return T.technical_opportunity(get("bars"))


_HAVE = ("short_ratio", "short_pct_float", "analyst_mean_score", "target_price", "beta")
_SETUP = f"""(WITH l AS (SELECT ticker, ARG_MAX(score, prediction_date) AS score FROM {{predictions}} GROUP BY ticker),
  v AS (SELECT ticker, CAST(MIN(report_date) - DATE '{REPORTS_DAY}' AS INT) AS event_days FROM {{earnings_events}} WHERE is_upcoming AND report_date >= DATE '{REPORTS_DAY}' GROUP BY ticker),
  c AS (SELECT s.ticker, l.score, ({' + '.join(f'CASE WHEN s.{c} IS NULL THEN 0 ELSE 1 END' for c in _HAVE)}) / CAST(5 AS DOUBLE) AS coverage, s.iv_rank AS iv_pct, v.event_days, t.trend_state, t.momentum_state, t.strength_state, t.volume_state
    FROM {{snapshots}} s LEFT JOIN l ON l.ticker = s.ticker LEFT JOIN v ON v.ticker = s.ticker LEFT JOIN {_STATES} t ON t.ticker = s.ticker),
  k AS (SELECT *, COALESCE(ABS(score), 0) AS size,
    CASE WHEN ABS(score) >= 0.4 THEN 1 ELSE 0 END + CASE WHEN coverage >= 0.7 THEN 1 ELSE 0 END + CASE WHEN CONTAINS(trend_state, 'STRONG') THEN 1 ELSE 0 END + CASE WHEN CONTAINS(momentum_state, 'ACCELERATING') THEN 1 ELSE 0 END
      + CASE WHEN volume_state = 'CONFIRMED' THEN 1 ELSE 0 END + CASE WHEN strength_state = 'STRONG' THEN 1 ELSE 0 END + CASE WHEN iv_pct < 40 THEN 1 ELSE 0 END AS good,
    CASE WHEN coverage < 0.45 THEN 1 ELSE 0 END + CASE WHEN iv_pct > 80 THEN 1 ELSE 0 END + CASE WHEN event_days <= 7 THEN 1 ELSE 0 END AS bad FROM c)
  SELECT ticker, score, LEAST(good, 4) AS strengths, LEAST(bad, 4) AS risks, LEAST(GREATEST(50 + 35 * size + 10 * (COALESCE(NULLIF(coverage, 0), 0.5) - 0.5) + 4 * good - 5 * bad, 0), 100) AS points FROM k)"""
_LABEL = "CASE WHEN points >= 75 THEN 'HIGH' WHEN points >= 55 THEN 'MODERATE' ELSE 'LOW' END"


def setups(get):
    """Setup quality of every ticker in the snapshots."""
    day = F.lit(REPORTS_DAY).cast("date")
    scores = get("predictions").groupBy("ticker").agg(F.max_by("score", "prediction_date").alias("score"))
    reports = get("earnings_events").where(F.col("is_upcoming") & (F.col("report_date") >= day)).groupBy("ticker").agg(F.datediff(F.min("report_date"), day).alias("event_days"))
    coverage = sum((F.col(c).isNotNull().cast("int") for c in _HAVE), F.lit(0)) / F.lit(5.0)
    df = get("snapshots").select("ticker", coverage.alias("coverage"), F.col("iv_rank").alias("iv_pct"))
    for other in (scores, reports, T.technical_opportunity(get("bars")).drop("session_no", "adx", "rvol")):
        df = df.join(other, "ticker", "left")
    return T.setup_quality(df)


@query("m18_setup_quality", f"SELECT ticker, {r(points='points')}, strengths, risks, {_LABEL} AS label FROM {_SETUP}")
def _(get):
    return setups(get).select("ticker", "points", F.size("strengths").alias("strengths"), F.size("risks").alias("risks"), "label")


@query("p12_moderate_setups", f"SELECT ticker, {_LABEL} AS label FROM {_SETUP} WHERE {_LABEL} IN ('MODERATE', 'HIGH')")
def _(get):
    return setups(get).where(F.col("label").isin("MODERATE", "HIGH")).select("ticker", "label")


@query("t07_ranked_opportunities", f"SELECT ticker, {r(points='points', score='score')} FROM {_SETUP} ORDER BY 2 DESC, 3 DESC")
def _(get):
    return setups(get).select("ticker", "points", "score").orderBy(F.desc_nulls_last("points"), F.desc_nulls_last("score"))


@query(
    "w13_intraday_overlays",
    f"""WITH t AS (SELECT *, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS market_date FROM {{ticks}}),
    o AS (SELECT *, AVG(size) OVER (PARTITION BY ticker ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sma,
      SUM(price * size) OVER d AS pv, SUM(size) OVER d AS v FROM t WINDOW d AS (PARTITION BY ticker, market_date ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, {r(volume_sma_20='sma', bar_rvol='size / NULLIF(sma, 0)', vwap='pv / NULLIF(v, 0)')} FROM o""",
)
def _(get):
    """Overlays of intraday prints: the price of a print is its typical price."""
    t = get("ticks").withColumn("market_date", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")))
    day = Window.partitionBy("ticker", "market_date").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sma = F.avg("size").over(Window.partitionBy("ticker").orderBy("ts", "event_id").rowsBetween(-19, 0))
    vwap = F.sum(F.col("price") * F.col("size")).over(day) / F.nullif(F.sum("size").over(day), F.lit(0))
    return t.select("event_id", sma.alias("volume_sma_20"), (F.col("size") / F.nullif(sma, F.lit(0.0))).alias("bar_rvol"), vwap.alias("vwap"))


# --- merges and folds ----------------------------------------------------------------------------------------------------


@query(
    "p14_yields",
    f"""SELECT a.trade_date, {r(rate_pct='COALESCE(a.two_year, a.ten_year)', delta_bps='(a.two_year - b.two_year) * 100')}, a.two_year IS NULL AS persisted FROM {{rates}} a LEFT JOIN {{rates}} b ON b.trade_date = a.trade_date - 1""",
)
def _(get):
    """Yield and its change in basis points; where the quote is missing, the stored longer yield without a change."""
    a = get("rates")
    b = a.select(F.date_add("trade_date", 1).alias("trade_date"), F.col("two_year").alias("before"))
    return a.join(b, "trade_date", "left").select("trade_date", F.coalesce("two_year", "ten_year").alias("rate_pct"), ((F.col("two_year") - F.col("before")) * 100).alias("delta_bps"), F.col("two_year").isNull().alias("persisted"))


@query("u06_macro_merge", "SELECT name, event_date, ARG_MAX(event_hour, (id % 2) * 1000000000000 + id) AS event_hour, COUNT(*) AS seen FROM {macro_events} GROUP BY name, event_date")
def _(get):
    """One row for each name and day; rows with odd ids are the later batch and win, then the latest id."""
    return get("macro_events").groupBy("name", "event_date").agg(F.max_by("event_hour", F.struct(F.col("id") % 2, "id")).alias("event_hour"), F.count("*").alias("seen"))


_KEY = ["ticker", "trade_date", "expiration", "opt_right", "strike"]


@query(
    "u12_quote_cache",
    """WITH c AS (SELECT * FROM {option_chain} WHERE open_interest < 900), n AS (SELECT * FROM {option_chain} WHERE volume >= 30)
    SELECT ticker, trade_date, COUNT(*) AS quotes, COUNT(*) FILTER (WHERE fresh) AS added FROM (SELECT ticker, trade_date, FALSE AS fresh FROM c UNION ALL
      SELECT ticker, trade_date, TRUE FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.ticker = n.ticker AND c.trade_date = n.trade_date AND c.expiration = n.expiration AND c.opt_right = n.opt_right AND c.strike = n.strike)) GROUP BY ticker, trade_date""",
)
def _(get):
    """Only quotes whose key the cache lacks are added."""
    chain = get("option_chain")
    cache = chain.where("open_interest < 900")
    added = chain.where("volume >= 30").join(cache, _KEY, "left_anti")
    both = cache.select("ticker", "trade_date", F.lit(False).alias("fresh")).unionByName(added.select("ticker", "trade_date", F.lit(True).alias("fresh")))
    return both.groupBy("ticker", "trade_date").agg(F.count("*").alias("quotes"), F.count_if("fresh").alias("added"))


@query(
    "v06_journal",
    """WITH e AS (SELECT id, opened_date AS seen_at, entry_value AS entry, CAST(NULL AS DOUBLE) AS mark, CAST(NULL AS DOUBLE) AS exit_mark FROM {trades}
      UNION ALL SELECT id, opened_date + 1, NULL, (entry_value + exit_value) / 2, NULL FROM {trades} UNION ALL SELECT id, opened_date + CAST(holding_days AS INT), NULL, NULL, exit_value FROM {trades} WHERE status = 'CLOSED')
    SELECT id, MAX(seen_at) AS seen_at, ROUND(MAX(entry), 6) AS entry, ROUND(MAX(mark), 6) AS mark, ROUND(MAX(exit_mark), 6) AS exit_mark, CASE WHEN MAX(exit_mark) IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status FROM e GROUP BY id""",
)
def _(get):
    """Open, mark and close events folded to one row a trade: the last value of each field that is there."""
    t, none = get("trades"), F.lit(None).cast("double")
    events = [
        t.select("id", F.col("opened_date").alias("seen_at"), F.col("entry_value").alias("entry"), none.alias("mark"), none.alias("exit_mark")),
        t.select("id", F.date_add("opened_date", 1).alias("seen_at"), none.alias("entry"), ((F.col("entry_value") + F.col("exit_value")) / 2).alias("mark"), none.alias("exit_mark")),
        t.where("status = 'CLOSED'").select("id", F.date_add("opened_date", F.col("holding_days").cast("int")).alias("seen_at"), none.alias("entry"), none.alias("mark"), F.col("exit_value").alias("exit_mark")),
    ]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seen_at"))).alias(c) for c in ("entry", "mark", "exit_mark")]
    folded = events[0].unionByName(events[1]).unionByName(events[2]).groupBy("id").agg(F.max("seen_at").alias("seen_at"), *last)
    return folded.withColumn("status", F.when(F.col("exit_mark").isNull(), "OPEN").otherwise("CLOSED"))


@query("v09_resolve_gate", f"SELECT ticker, MAX(prediction_date) AS last_day, MAX(prediction_date) < DATE '{CALENDAR_DAY}' AS due FROM {{predictions}} GROUP BY ticker")
def _(get):
    """A ticker is due once a day: when its last resolved day lies before the day asked for."""
    last = F.max("prediction_date")
    return get("predictions").groupBy("ticker").agg(last.alias("last_day"), (last < F.lit(CALENDAR_DAY).cast("date")).alias("due"))


@query(
    "u11_companies",
    """WITH o AS (SELECT s_suppkey AS ticker, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'OLD' ELSE '' END AS sector, 'stored' AS keywords FROM {supplier} WHERE s_suppkey % 3 <> 0),
    n AS (SELECT c_custkey % (SELECT 2 * COUNT(*) FROM {supplier}) AS ticker, c_custkey AS seq, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE '' END AS sector, CASE WHEN c_nationkey % 5 = 0 THEN CONCAT('k', c_nationkey) END AS keywords FROM {customer}),
    g AS (SELECT ticker, ARG_MAX(name, seq) AS name, ARG_MAX(sector, seq) FILTER (WHERE sector <> '') AS sector, ARG_MAX(keywords, seq) FILTER (WHERE keywords <> '') AS keywords FROM n GROUP BY ticker)
    SELECT COALESCE(o.ticker, g.ticker) AS ticker, COALESCE(g.name, o.name) AS name, COALESCE(g.sector, o.sector, '') AS sector, COALESCE(g.keywords, o.keywords, '') AS keywords FROM o FULL JOIN g ON g.ticker = o.ticker""",
)
def _(get):
    s = get("supplier")
    stored = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "OLD").otherwise("").alias("sector"), F.lit("stored").alias("keywords"))
    key = F.col("c_custkey")
    n = s.agg(F.count("*") * 2).scalar()
    new = get("customer").select((key % n).alias("ticker"), key.alias("seq"), F.col("c_name").alias("name"), F.when(key % 4 == 0, F.col("c_mktsegment")).otherwise("").alias("sector"), F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("k"), F.col("c_nationkey").cast("string"))).alias("keywords"))
    return G.merge_companies(stored, new)
