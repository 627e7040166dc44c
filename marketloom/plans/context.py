"""Queries over context, calendars, snapshots, merges and reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import context as C
from ..operators import joins as J
from ..operators import windows as W
from .registry import _METRICS, _OUTCOMES, _STORIES, _cdf, _outcomes, query, r

_clip = lambda x: f"LEAST(GREATEST({x}, -1), 1)"


def _words(words: dict[str, tuple[str, ...]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN REGEXP_MATCHES(LOWER(name), '{'|'.join(w)}') THEN '{label}'" for label, w in words.items()) + f" ELSE '{other}' END"


_IMPORTANCE = _words(S.MACRO_IMPORTANCE, "Low")


@query("f03_tickers", "SELECT doc_id, CASE WHEN REGEXP_FULL_MATCH(t, '[A-Z0-9][A-Z0-9.\\-]{0,14}') THEN t END AS ticker, ARRAY_TO_STRING(LIST_FILTER(LIST_TRANSFORM(STRING_SPLIT(SUBSTR(text, 1, 60), ','), lambda k: REGEXP_REPLACE(k, '^\\s+|\\s+$', '', 'g')), lambda k: k <> ''), '|') AS keywords FROM (SELECT doc_id, text, UPPER(REGEXP_REPLACE(SUBSTR(text, 1, 1 + CAST(doc_id % 6 AS INT)), '^\\s+|\\s+$', '', 'g')) AS t FROM {documents} WHERE text IS NOT NULL)")
def _(get):
    d = get("documents").where("text IS NOT NULL")
    return d.select("doc_id", S.normalize_ticker(F.expr("substr(text, 1, 1 + cast(doc_id % 6 as int))")).alias("ticker"), F.array_join(S.keyword_list(F.substring("text", 1, 60)), "|").alias("keywords"))


@query("f04_macro_category", f"SELECT id, name, {_words(S.MACRO_CATEGORIES, 'Other')} AS category, {_IMPORTANCE} AS importance FROM {{macro_events}}")
def _(get):
    return get("macro_events").select("id", "name", S.macro_category(F.col("name")).alias("category"), S.macro_importance(F.col("name")).alias("importance"))


@query("f06_rating_value", "SELECT external_id, CAST(CASE REPLACE(REPLACE(LOWER(rating_current), ' ', ''), '_', '') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.RATING_VALUES.items()) + " END AS DOUBLE) AS value FROM {analyst_rating_events}")
def _(get):
    return get("analyst_rating_events").select("external_id", S.rating_value(F.col("rating_current")).alias("value"))


@query("f11_blend", f"SELECT ticker, session_no, {r(blended='CASE WHEN xs IS NULL THEN score ELSE ROUND(' + _clip('0.65 * xs + 0.35 * score') + ', 4) END')} FROM (SELECT *, CASE WHEN session_no % 4 = 0 THEN NULL ELSE ((ticker * 31 + session_no * 17) % 201 - 100) / CAST(101 AS DOUBLE) END AS xs FROM {{predictions}})", 6)
def _(get):
    p = get("predictions").withColumn("xs", F.expr("CASE WHEN session_no % 4 = 0 THEN NULL ELSE ((ticker * 31 + session_no * 17) % 201 - 100) / 101D END"))
    return p.select("ticker", "session_no", S.blend(F.col("score"), F.col("xs")).alias("blended"))


@query("f12_normal", f"SELECT ticker, session_no, {r(density='EXP(-x * x / 2) / 2.5066282746310002', below=_cdf('x'))} FROM (SELECT ticker, session_no, score * 4 AS x FROM {{predictions}})")
def _(get):
    x = F.col("score") * 4
    return get("predictions").select("ticker", "session_no", S.norm_pdf(x).alias("density"), S.norm_cdf(x).alias("below"))


@query("f18_term_state", "SELECT ticker, trade_date, CASE WHEN i30 IS NULL OR i60 IS NULL THEN NULL WHEN i60 - i30 < -0.015 THEN 'BACKWARDATION' WHEN i60 - i30 > 0.015 AND (i90 IS NULL OR i90 - i60 >= -0.01) THEN 'CONTANGO' ELSE 'FLAT' END AS state FROM (SELECT ticker, trade_date, ROUND(AVG(CASE WHEN dte = 35 THEN iv END), 6) AS i30, ROUND(AVG(CASE WHEN dte = 63 THEN iv END), 6) AS i60, ROUND(AVG(CASE WHEN dte = 91 THEN iv END), 6) AS i90 FROM {option_chain} GROUP BY ticker, trade_date)")
def _(get):
    at = lambda d: F.round(F.avg(F.when(F.col("dte") == d, F.col("iv"))), 6)
    t = get("option_chain").groupBy("ticker", "trade_date").agg(at(35).alias("i30"), at(63).alias("i60"), at(91).alias("i90"))
    return t.select("ticker", "trade_date", S.term_state(F.col("i30"), F.col("i60"), F.col("i90")).alias("state"))


@query("f23_source_weights", f"SELECT ticker, source, {r(weight='ROUND(n / SUM(n) OVER (PARTITION BY ticker), 4)')} FROM (SELECT ticker, source, CAST(COUNT(*) AS DOUBLE) AS n FROM {{articles}} GROUP BY ticker, source)")
def _(get):
    n = get("articles").groupBy("ticker", "source").agg(F.count("*").cast("double").alias("n"))
    return n.select("ticker", "source", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("ticker")), 4).alias("weight"))


@query("f24_absolute_urls", "SELECT page_id, CASE WHEN u LIKE 'http://%' OR u LIKE 'https://%' THEN u WHEN u LIKE '/%' THEN CONCAT('https://site.example', u) ELSE u END AS url FROM (SELECT page_id, CASE CAST(page_id % 3 AS INT) WHEN 0 THEN url WHEN 1 THEN CONCAT('/p/', CAST(page_id AS VARCHAR(20))) ELSE 'mailto:x' END AS u FROM {pages})")
def _(get):
    u = get("pages").withColumn("u", F.expr("CASE cast(page_id % 3 as int) WHEN 0 THEN url WHEN 1 THEN concat('/p/', cast(page_id as string)) ELSE 'mailto:x' END"))
    return u.select("page_id", S.absolute_url(F.col("u"), "https://site.example").alias("url"))


# --- aggregations ------------------------------------------------------------------------------------------------------


@query("a03_story_counts", f"SELECT a.ticker, a.outlets, a.n AS articles, s.n AS stories, a.n - s.n AS duplicates FROM (SELECT ticker, COUNT(DISTINCT source) AS outlets, COUNT(*) AS n FROM {{articles}} GROUP BY ticker) a JOIN (SELECT ticker, COUNT(*) AS n FROM {_STORIES} GROUP BY ticker) s ON a.ticker = s.ticker")
def _(get):
    every = get("articles").groupBy("ticker").agg(F.count_distinct("source").alias("outlets"), F.count("*").alias("articles"))
    stories = A.unique_stories(get("articles")).groupBy("ticker").agg(F.count("*").alias("stories"))
    return every.join(stories, "ticker").withColumn("duplicates", F.col("articles") - F.col("stories"))


@query("a05_source_diversity", f"SELECT ticker, {r(diversity='LEAST(1.0, (COUNT(DISTINCT source) - 1) / 3.0)')} FROM {{articles}} WHERE published_at IS NOT NULL GROUP BY ticker")
def _(get):
    return get("articles").where("published_at IS NOT NULL").groupBy("ticker").agg(F.least(F.lit(1.0), (F.count_distinct("source") - 1) / 3.0).alias("diversity"))


@query("a07_index_breadth", f"""WITH b AS (SELECT *, CASE WHEN COUNT(close) OVER w = 50 THEN AVG(close) OVER w END AS sma FROM {{bars}} WINDOW w AS (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
    g AS (SELECT trade_date, AVG(CAST(close > sma AS INT)) * 100 AS pct, COUNT(*) AS members FROM b WHERE sma IS NOT NULL GROUP BY trade_date)
    SELECT trade_date, members, {r(pct_above='pct')}, CASE WHEN pct >= 60 THEN 'HEALTHY' WHEN pct < 40 THEN 'WEAK' ELSE 'MIXED' END AS state FROM g""")
def _(get):
    b = get("bars").withColumn("sma", W.sma(50)).where("sma IS NOT NULL")
    g = b.groupBy("trade_date").agg((F.avg((F.col("close") > F.col("sma")).cast("int")) * 100).alias("pct_above"), F.count("*").alias("members"))
    return g.withColumn("state", F.when(F.col("pct_above") >= 60, "HEALTHY").when(F.col("pct_above") < 40, "WEAK").otherwise("MIXED"))


_FEATURES = ("price", "change_pct", "short_ratio", "analyst_mean_score", "beta", "iv_rank")


@query("a12_dispersion", "SELECT feature, n, ROUND(mean, 6) AS mean, ROUND(sd, 6) AS sd, lo, hi, n < 2 OR hi = lo OR (ABS(mean) > 1e-9 AND sd / ABS(mean) < 0.05) AS degenerate FROM (SELECT feature, COUNT(*) AS n, AVG(v) AS mean, STDDEV_SAMP(v) AS sd, MIN(v) AS lo, MAX(v) AS hi FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v FROM {{snapshots}}" for f in _FEATURES) + ") WHERE v IS NOT NULL GROUP BY feature)")
def _(get):
    long = get("snapshots").unpivot("ticker", list(_FEATURES), "feature", "v").where("v IS NOT NULL")
    g = long.groupBy("feature").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return g.withColumn("degenerate", F.expr("n < 2 OR hi = lo OR (abs(mean) > 1e-9 AND sd / abs(mean) < 0.05)"))


@query("a17_open_book", f"SELECT COUNT(*) AS n, {r(marked='SUM(pnl)', at_risk='SUM(risk)')}, CASE WHEN COUNT(*) = 0 THEN 'Flat' WHEN SUM(CASE WHEN direction = 'BULLISH' THEN 1 ELSE -1 END) > 0 THEN 'Bullish' ELSE 'Bearish' END AS bias FROM {_METRICS} WHERE status = 'OPEN'")
def _(get):
    t = A.trade_metrics(get("trades")).where("status = 'OPEN'")
    side = F.sum(F.when(F.col("direction") == "BULLISH", 1).otherwise(-1))
    return t.agg(F.count("*").alias("n"), F.sum("pnl").alias("marked"), F.sum("risk").alias("at_risk"), F.when(F.count("*") == 0, "Flat").when(side > 0, "Bullish").otherwise("Bearish").alias("bias"))


_LAST14 = "(SELECT ticker, session_no, ret FROM (SELECT *, close / LAG(close) OVER (PARTITION BY ticker ORDER BY session_no) - 1 AS ret, MAX(session_no) OVER (PARTITION BY ticker) - session_no AS back FROM {bars}) WHERE back < 14 AND ret IS NOT NULL)"


def _last14(get):
    back = F.max("session_no").over(Window.partitionBy("ticker")) - F.col("session_no")
    return get("bars").select("ticker", "session_no", "trade_date", W.ret(1).alias("ret"), back.alias("back")).where("back < 14 AND ret IS NOT NULL")


@query("a18_performance", f"SELECT ticker, {r(total='PRODUCT(1 + ret) - 1', best='MAX(ret)', worst='MIN(ret)', mean='AVG(ret)')}, COUNT(*) FILTER (WHERE ret > 0) AS up_days, COUNT(*) FILTER (WHERE ret < 0) AS down_days FROM {_LAST14} GROUP BY ticker")
def _(get):
    x = F.col("ret")
    return _last14(get).groupBy("ticker").agg((F.product(1 + x) - 1).alias("total"), F.max(x).alias("best"), F.min(x).alias("worst"), F.avg(x).alias("mean"), F.count_if(x > 0).alias("up_days"), F.count_if(x < 0).alias("down_days"))


@query("w30_performance_matrix", f"SELECT ticker, session_no, {r(pct='ret * 100')} FROM {_LAST14}")
def _(get):
    return _last14(get).select("ticker", "session_no", (F.col("ret") * 100).alias("pct"))


_STAMPS = {"bars": "trade_date", "predictions": "prediction_date", "trades": "opened_date", "earnings_events": "report_date", "macro_events": "event_date"}


@query("a19_freshness", " UNION ALL ".join(f"SELECT '{t}' AS name, MAX({c}) AS latest FROM {{{t}}}" for t, c in _STAMPS.items()))
def _(get):
    parts = [get(t).agg(F.max(c).alias("latest")).select(F.lit(t).alias("name"), "latest") for t, c in _STAMPS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("a21_readiness", " UNION ALL ".join(f"SELECT '{t}' AS name, COUNT(*) AS n, COUNT(*) > 0 AS ready FROM {{{t}}}" for t in _STAMPS))
def _(get):
    out = None
    for t in _STAMPS:
        one = get(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n", (F.col("n") > 0).alias("ready"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a20_event_counts", f"SELECT CAST(EXTRACT(YEAR FROM event_date) AS INT) AS y, CAST(EXTRACT(MONTH FROM event_date) AS INT) AS m, COUNT(*) AS n, COUNT(*) FILTER (WHERE {_IMPORTANCE} = 'High') AS high FROM {{macro_events}} GROUP BY 1, 2")
def _(get):
    e = get("macro_events").groupBy(F.year("event_date").alias("y"), F.month("event_date").alias("m"))
    return e.agg(F.count("*").alias("n"), F.count_if(S.macro_importance(F.col("name")) == "High").alias("high"))


@query("a23_dedupe_predictions", "SELECT ticker, opened_date, MAX(id) AS id FROM {trades} GROUP BY ticker, opened_date")
def _(get):
    return get("trades").groupBy("ticker", "opened_date").agg(F.max("id").alias("id"))


# --- series and context ------------------------------------------------------------------------------------------------


@query("w26_change_feed", """WITH l AS (SELECT *, LAG(score) OVER w AS before, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY prediction_date DESC) AS k FROM {predictions} WINDOW w AS (PARTITION BY ticker ORDER BY prediction_date)),
    t AS (SELECT *, CASE WHEN score > 0.5 THEN 'STRONG BUY' WHEN score > 0.2 THEN 'BULLISH' WHEN score > -0.2 THEN 'NEUTRAL' WHEN score > -0.5 THEN 'BEARISH' ELSE 'STRONG SELL' END AS label,
      CASE WHEN before > 0.5 THEN 'STRONG BUY' WHEN before > 0.2 THEN 'BULLISH' WHEN before > -0.2 THEN 'NEUTRAL' WHEN before > -0.5 THEN 'BEARISH' ELSE 'STRONG SELL' END AS was FROM l WHERE k = 1 AND before IS NOT NULL)
    SELECT ticker, prediction_date, was, label, ROUND(score - before, 6) AS change FROM t WHERE label <> was OR ABS(ROUND(score - before, 6)) >= 0.15""")
def _(get):
    w = Window.partitionBy("ticker").orderBy("prediction_date")
    p = get("predictions").withColumn("before", F.lag("score").over(w)).withColumn("next", F.lead("score").over(w)).where("next IS NULL AND before IS NOT NULL")
    p = p.select("ticker", "prediction_date", S.tradeability_label(F.col("before")).alias("was"), S.tradeability_label(F.col("score")).alias("label"), F.round(F.col("score") - F.col("before"), 6).alias("change"))
    return p.where((F.col("label") != F.col("was")) | (F.abs("change") >= 0.15))


_MOMENTUM = "SELECT ticker, session_no, CASE WHEN n >= 2 THEN score - first END AS momentum FROM (SELECT ticker, session_no, score, FIRST_VALUE(score) OVER w3 AS first, COUNT(*) OVER w14 AS n, COUNT(*) OVER w3 AS m FROM {predictions} WINDOW w3 AS (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w14 AS (PARTITION BY ticker ORDER BY session_no RANGE BETWEEN 14 PRECEDING AND CURRENT ROW))"


@query("w27_sentiment_momentum", f"SELECT ticker, session_no, {r(momentum='CASE WHEN momentum IS NOT NULL THEN ' + _clip('momentum * 2.5') + ' END')} FROM ({_MOMENTUM})")
def _(get):
    by = Window.partitionBy("ticker").orderBy("session_no")
    move = F.when(F.count("*").over(by.rangeBetween(-14, 0)) >= 2, F.col("score") - F.first("score").over(by.rowsBetween(-2, 0)))
    return get("predictions").select("ticker", "session_no", move.alias("m")).select("ticker", "session_no", S.clamp(F.col("m") * 2.5, -1.0, 1.0).alias("momentum"))


_RATES = "(SELECT *, (ten_year - LAG(ten_year, 5) OVER w) * 100 AS c5, (ten_year - LAG(ten_year, 20) OVER w) * 100 AS c20, ten_year - two_year AS curve FROM {rates} WHERE two_year IS NOT NULL AND ten_year IS NOT NULL WINDOW w AS (ORDER BY trade_date))"


@query("w29_rates", f"SELECT trade_date, {r(change_5='c5', change_20='c20', curve='curve')} FROM {_RATES}")
def _(get):
    return C.rates_changes(get("rates")).select("trade_date", "change_5", "change_20", "curve")


@query("m14_rates_score", f"SELECT trade_date, {r(score=_clip(f'0.75 * -{_clip(chr(40) + "COALESCE(NULLIF(c20, 0), NULLIF(c5, 0), 0)" + chr(41) + " / 50")} + 0.25 * {_clip("curve")}'))} FROM {_RATES}")
def _(get):
    return C.rates_score(get("rates")).select("trade_date", "score")


@query("m13_volatility_regime", f"""WITH b AS (SELECT ticker, session_no, close, (close / LAG(close, 5) OVER (PARTITION BY ticker ORDER BY session_no) - 1) * 100 AS r5, LIST(close) OVER (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l20, LIST(close) OVER (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS l252 FROM {{bars}}),
    p AS (SELECT *, LEN(LIST_FILTER(l20, lambda x: x <= close)) * 100.0 / LEN(l20) AS p20, LEN(LIST_FILTER(l252, lambda x: x <= close)) * 100.0 / LEN(l252) AS p252 FROM b WHERE session_no >= 21)
    SELECT ticker, session_no, {r(score=_clip("0.55 * CASE WHEN close < 15 THEN 0.55 WHEN close < 20 THEN 0.25 WHEN close < 30 THEN -0.35 ELSE -0.85 END - 0.30 * " + _clip("COALESCE(r5, 0) / 25") + " - 0.15 * " + _clip("(COALESCE(p252, p20) - 50) / 50")))},
      CONCAT(CASE WHEN close < 15 THEN 'CALM' WHEN close < 20 THEN 'NORMAL' WHEN close < 30 THEN 'ELEVATED' ELSE 'STRESSED' END, CASE WHEN COALESCE(r5, 0) > 3 THEN '_RISING' WHEN COALESCE(r5, 0) < -3 THEN '_FALLING' ELSE '_FLAT' END) AS state FROM p""")
def _(get):
    b = get("bars").select("ticker", "session_no", "close", (W.ret(5) * 100).alias("r5"), W.percentile_last("close", 20).alias("p20"), W.percentile_last("close", 252).alias("p252")).where("session_no >= 21")
    out = C.volatility_regime(F.col("close"), F.col("r5"), F.col("p20"), F.col("p252"))
    return b.select("ticker", "session_no", out["score"].alias("score"), out["state"].alias("state"))


_DAYS = "(SELECT DISTINCT CAST(trade_date AS TIMESTAMP) AS as_of FROM {bars})"
_EVENTS = f"(SELECT id, event_date + event_hour * INTERVAL 1 HOUR AS event_at, {_IMPORTANCE} AS importance, ROW_NUMBER() OVER (ORDER BY event_date, event_hour, id) AS place FROM {{macro_events}})"
_NEXT = f"""(WITH e AS {_EVENTS}, d AS {_DAYS}, n AS (SELECT d.as_of, MIN(e.place) AS place FROM d JOIN e ON e.event_at >= d.as_of GROUP BY d.as_of),
    c AS (SELECT n.as_of, e.*, ROW_NUMBER() OVER (PARTITION BY n.as_of ORDER BY CASE WHEN e.importance = 'High' THEN 0 ELSE 1 END, e.place) AS k FROM n JOIN e ON e.place BETWEEN n.place AND n.place + 49)
    SELECT as_of, id, event_at FROM c WHERE k = 1)"""


def _next(get):
    e = get("macro_events").select("id", F.expr("cast(event_date as timestamp) + make_dt_interval(0, event_hour)").alias("event_at"), S.macro_importance(F.col("name")).alias("importance"))
    days = get("bars").select(F.col("trade_date").cast("timestamp").alias("as_of")).distinct()
    return C.next_event(e, days).where("id IS NOT NULL")


_HOURS = "(EPOCH(CAST(event_at AS TIMESTAMP)) - EPOCH(as_of)) / 3600.0"


@query("t09_next_event", f"SELECT CAST(as_of AS DATE) AS as_of, id, {r(hours=_HOURS)} FROM {_NEXT}")
def _(get):
    return _next(get).select(F.to_date("as_of").alias("as_of"), "id", ((F.unix_timestamp("event_at") - F.unix_timestamp("as_of")) / 3600.0).alias("hours"))


@query("m15_macro_risk", f"SELECT CAST(as_of AS DATE) AS as_of, CAST(CASE WHEN {_HOURS} <= 6 THEN 1.0 WHEN {_HOURS} <= 24 THEN 0.8 WHEN {_HOURS} <= 48 THEN 0.5 WHEN {_HOURS} <= 72 THEN 0.25 ELSE 0.0 END AS DOUBLE) AS risk FROM {_NEXT}")
def _(get):
    return _next(get).select(F.to_date("as_of").alias("as_of"), C.macro_risk((F.unix_timestamp("event_at") - F.unix_timestamp("as_of")) / 3600.0).alias("risk"))


@query("f20_regime_label", """SELECT ticker, session_no, CONCAT(CASE WHEN score >= 0.45 THEN 'STRONG_RISK_ON' WHEN score >= 0.15 THEN 'RISK_ON' WHEN score <= -0.45 THEN 'STRONG_RISK_OFF' WHEN score <= -0.15 THEN 'RISK_OFF' ELSE 'NEUTRAL' END,
    CASE WHEN session_no % 5 = 0 OR ticker % 7 = 0 THEN '_CAUTION' ELSE '' END) AS label FROM {predictions}""")
def _(get):
    risk = F.when(F.col("session_no") % 5 == 0, 0.8).otherwise(0.25)
    return get("predictions").select("ticker", "session_no", C.regime_label(F.col("score"), risk, F.when(F.col("ticker") % 7 == 0, "STRESSED_RISING").otherwise("CALM_FLAT")).alias("label"))


# --- signals of a snapshot -----------------------------------------------------------------------------------------------


def _mean(*parts: tuple[str, float]) -> str:
    top, low = (" + ".join(f"COALESCE({x}, 0)" for x in side) for side in ([f"({s}) * {w}" for s, w in parts], [f"CASE WHEN ({s}) IS NOT NULL THEN {w} END" for s, w in parts]))
    return f"CASE WHEN {low} > 0 THEN ROUND({_clip(f'({top}) / NULLIF({low}, 0)')}, 4) END"


_OWN = "CASE WHEN short_ratio >= 10 THEN CASE WHEN change_pct > 0 THEN 0.6 ELSE -0.5 END WHEN short_ratio >= 5 THEN CASE WHEN change_pct > 0 THEN 0.3 ELSE -0.2 END WHEN short_ratio >= 2 THEN 0.0 WHEN short_ratio IS NOT NULL THEN 0.1 END"
_HELD = "CASE WHEN pct >= 20 THEN CASE WHEN change_pct > 0 THEN 0.5 ELSE -0.4 END WHEN pct >= 10 THEN CASE WHEN change_pct > 0 THEN 0.2 ELSE -0.2 END WHEN pct IS NOT NULL THEN 0.0 END"


@query("m07_short_interest", f"SELECT ticker, CAST({_mean((_OWN, 1.2), (_HELD, 0.8))} AS DOUBLE) AS short_interest, (CAST(short_ratio IS NOT NULL AS INT) + CAST(pct IS NOT NULL AS INT)) / 2.0 AS short_interest_conf FROM (SELECT *, CASE WHEN short_pct_float < 1 THEN short_pct_float * 100 ELSE short_pct_float END AS pct FROM {{snapshots}})")
def _(get):
    return get("snapshots").select("ticker", *[c.alias(k) for k, c in C.short_interest().items()])


_UPSIDE = "LEAST(GREATEST((target_price - price) / price * 100 / 20, -1), 1)"


@query("m09_analyst", f"SELECT ticker, {_mean(('LEAST(GREATEST((3 - analyst_mean_score) / 2, -1), 1)', 1.5), (_UPSIDE, 1.2)).replace('LEAST(GREATEST((3 - analyst_mean_score) / 2, -1), 1)', 'CASE WHEN analyst_mean_score IS NOT NULL THEN LEAST(GREATEST((3 - analyst_mean_score) / 2, -1), 1) END').replace(_UPSIDE, f'CASE WHEN target_price IS NOT NULL THEN {_UPSIDE} END')} AS analyst, (CAST(analyst_mean_score IS NOT NULL AS INT) + CAST(target_price IS NOT NULL AS INT)) / 2.0 AS analyst_conf FROM {{snapshots}}")
def _(get):
    return get("snapshots").select("ticker", *[c.alias(k) for k, c in C.analyst_view().items()])


@query("m08_options_iv", f"""WITH p AS (SELECT *, CASE WHEN iv <= 3 THEN iv * 100 ELSE iv END AS pct FROM {{snapshots}}),
    g AS (SELECT *, COALESCE(CASE WHEN iv_rank >= 80 THEN -0.5 WHEN iv_rank >= 60 THEN -0.2 WHEN iv_rank >= 40 THEN 0.0 WHEN iv_rank >= 20 THEN 0.2 WHEN iv_rank IS NOT NULL THEN 0.4 END, CASE WHEN pct < 20 THEN 0.3 WHEN pct < 30 THEN 0.1 WHEN pct < 45 THEN -0.1 WHEN pct < 65 THEN -0.3 WHEN pct IS NOT NULL THEN -0.5 END) AS regime FROM p)
    SELECT ticker, CASE WHEN regime IS NOT NULL THEN CAST(ROUND({_clip("CASE WHEN beta > 0 THEN " + _clip("regime + LEAST(GREATEST((beta - 1) * -0.1, -0.2), 0.2)") + " ELSE regime END + CASE WHEN pct < 30 AND change_pct > 0 THEN 0.2 WHEN pct > 50 AND change_pct < -2 THEN -0.3 ELSE 0 END")}, 4) AS DOUBLE) END AS options_iv, CAST(CASE WHEN iv_rank IS NOT NULL THEN 0.8 WHEN iv IS NOT NULL THEN 0.25 ELSE 0 END AS DOUBLE) AS options_iv_conf FROM g""")
def _(get):
    return get("snapshots").select("ticker", *[c.alias(k) for k, c in C.options_iv(F.lit(0.8)).items()])


_SENT = f"(SELECT ticker, AVG(sentiment) AS sentiment, COUNT(sentiment) AS n_articles, COUNT(DISTINCT source) AS outlets FROM {{articles}} GROUP BY ticker)"
_CONF = "CASE WHEN sentiment IS NOT NULL THEN LEAST(1.0, n_articles / 15.0) ELSE 0.0 END"
_HOLD = f"CASE WHEN sentiment IS NOT NULL THEN sentiment * (0.4 + 0.6 * ({_CONF})) END"
_DIV = "LEAST(1.0, (outlets - 1) / 3.0) * 0.5 * CASE WHEN COALESCE(sentiment, 0) >= 0 THEN 1 ELSE -1 END"


@query("m01_sentiment", f"""WITH m AS (SELECT ticker, ARG_MAX(momentum, session_no) AS momentum FROM ({_MOMENTUM}) GROUP BY ticker), j AS (SELECT s.*, m.momentum FROM {_SENT} s LEFT JOIN m ON m.ticker = s.ticker),
    v AS (SELECT ticker, {_HOLD} AS held, CASE WHEN momentum IS NOT NULL THEN {_clip('momentum * 2.5')} END AS mom, {_DIV} AS div, {_CONF} AS conf FROM j)
    SELECT ticker, CAST({_mean(('held', 1.5), ('mom', 1.0), ('div', 0.4))} AS DOUBLE) AS sentiment_signal, CAST(ROUND(LEAST(1.0, (conf + (CAST(held IS NOT NULL AS INT) + CAST(mom IS NOT NULL AS INT) + 1) / 4.0) / 2), 3) AS DOUBLE) AS sentiment_conf FROM v""")
def _(get):
    by = Window.partitionBy("ticker").orderBy("session_no")
    move = F.when(F.count("*").over(by.rangeBetween(-14, 0)) >= 2, F.col("score") - F.first("score").over(by.rowsBetween(-2, 0)))
    last = get("predictions").select("ticker", "session_no", move.alias("m")).groupBy("ticker").agg(F.max_by("m", "session_no").alias("momentum"))
    s = get("articles").groupBy("ticker").agg(F.avg("sentiment").alias("sentiment"), F.count("sentiment").alias("n_articles"), F.count_distinct("source").alias("outlets"))
    j = s.join(last, "ticker", "left").withColumn("recency", F.lit(None).cast("double"))
    return j.select("ticker", *[c.alias(k) for k, c in C.sentiment_signal().items()])


@query("m25_feedback", f"""WITH a AS (SELECT ticker, COUNT(*) AS n, AVG(CAST(COALESCE(SIGN(score) * SIGN(actual_return) > 0, false) AS INT)) AS acc FROM {_OUTCOMES} WHERE actual_return IS NOT NULL GROUP BY ticker)
    SELECT p.ticker, p.session_no, CASE WHEN n >= 30 THEN ROUND({_clip('p.score / 1.003 * LEAST(GREATEST(1 + 0.15 * LEAST(1.0, n / 60.0) * (acc - 0.5) * 2, 0.5), 1.5)')}, 4) END AS would_be, ROUND(p.score / 1.003, 4) AS adjusted FROM {{predictions}} p LEFT JOIN a ON a.ticker = p.ticker""", 4)
def _(get):
    a = A.accuracy(_outcomes(get)).where("ticker IS NOT NULL").select("ticker", "n", "accuracy", "significant")
    out = C.feedback(F.col("score") / 1.003, F.col("n"), F.least(F.lit(1.0), F.col("n") / 60.0), (F.col("accuracy") - 0.5) * 2, F.col("significant"))
    return get("predictions").join(a, "ticker", "left").select("ticker", "session_no", *[c.alias(k) for k, c in out.items()])


# --- joins, merges, reviews ------------------------------------------------------------------------------------------------


@query("j09_contract_match", """SELECT a.ticker, a.trade_date, b.trade_date AS exit_date, a.expiration, a.opt_right, a.strike, ROUND(b.bid - a.ask, 6) AS made FROM {option_chain} a
    JOIN {option_chain} b ON b.ticker = a.ticker AND b.expiration = a.expiration AND b.opt_right = a.opt_right AND CAST(ROUND(b.strike * 100) AS BIGINT) = CAST(ROUND(a.strike * 100) AS BIGINT) AND b.trade_date > a.trade_date""")
def _(get):
    c = get("option_chain").withColumn("cents", F.round(F.col("strike") * 100).cast("long"))
    out = c.select("ticker", "expiration", "opt_right", "cents", F.col("trade_date").alias("exit_date"), F.col("bid").alias("exit_bid"))
    both = c.join(out, ["ticker", "expiration", "opt_right", "cents"]).where("exit_date > trade_date")
    return both.select("ticker", "trade_date", "exit_date", "expiration", "opt_right", "strike", (F.col("exit_bid") - F.col("ask")).alias("made"))


@query("t06_nearest_strikes", "SELECT ticker, trade_date, expiration, opt_right, strike, k FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, trade_date, expiration, opt_right ORDER BY ABS(strike - underlying_price), strike) AS k FROM {option_chain}) WHERE k <= 2")
def _(get):
    w = Window.partitionBy("ticker", "trade_date", "expiration", "opt_right").orderBy(F.abs(F.col("strike") - F.col("underlying_price")), "strike")
    return get("option_chain").withColumn("k", F.row_number().over(w).cast("long")).where("k <= 2").select("ticker", "trade_date", "expiration", "opt_right", "strike", "k")


_NEW = "(SELECT ticker, prediction_date, ROUND(-score, 6) AS score FROM {predictions} WHERE session_no % 2 = 0)"


@query("u08_prediction_upsert", f"""SELECT COALESCE(o.ticker, n.ticker) AS ticker, COALESCE(o.prediction_date, n.prediction_date) AS prediction_date, CASE WHEN n.ticker IS NULL OR o.actual_return IS NOT NULL THEN o.score ELSE n.score END AS score
    FROM {_OUTCOMES} o FULL JOIN {_NEW} n ON n.ticker = o.ticker AND n.prediction_date = o.prediction_date""")
def _(get):
    """Refreshed until resolved, then frozen."""
    old = _outcomes(get).select("ticker", "prediction_date", "score", "actual_return")
    new = get("predictions").where("session_no % 2 = 0").select("ticker", "prediction_date", F.round(-F.col("score"), 6).alias("fresh"))
    return old.join(new, ["ticker", "prediction_date"], "full").select("ticker", "prediction_date", F.expr("CASE WHEN fresh IS NULL OR actual_return IS NOT NULL THEN score ELSE fresh END").alias("score"))


@query("u09_snapshot_upsert", """SELECT ticker, snapshot_date, ROUND(iv, 6) AS iv, basis FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, snapshot_date ORDER BY basis) AS k FROM (
    SELECT ticker, trade_date AS snapshot_date, AVG(iv) AS iv, 'chain' AS basis FROM {option_chain} WHERE iv IS NOT NULL GROUP BY ticker, trade_date UNION ALL
    SELECT ticker, trade_date, 0.2 + (session_no % 10) / 100.0, 'proxy' FROM {bars} WHERE session_no % 7 = 0)) WHERE k = 1""")
def _(get):
    """One row for each ticker and day: a chain overwrites a proxy."""
    chain = get("option_chain").where("iv IS NOT NULL").groupBy("ticker", F.col("trade_date").alias("snapshot_date")).agg(F.avg("iv").alias("iv")).withColumn("basis", F.lit("chain"))
    proxy = get("bars").where("session_no % 7 = 0").select("ticker", F.col("trade_date").alias("snapshot_date"), F.expr("0.2D + (session_no % 10) / 100D").alias("iv"), F.lit("proxy").alias("basis"))
    return chain.unionByName(proxy).groupBy("ticker", "snapshot_date").agg(F.min_by("iv", "basis").alias("iv"), F.min("basis").alias("basis"))


@query("u10_backfill", """SELECT p.ticker, p.trade_date FROM {bars} p LEFT JOIN (SELECT DISTINCT ticker, trade_date FROM {option_chain}) c ON c.ticker = p.ticker AND c.trade_date = p.trade_date WHERE c.ticker IS NULL AND p.trade_date >= DATE '2020-03-01'""")
def _(get):
    """Insert if absent, within a cutoff."""
    return get("bars").where("trade_date >= DATE '2020-03-01'").select("ticker", "trade_date").join(get("option_chain").select("ticker", "trade_date"), ["ticker", "trade_date"], "left_anti")


@query("v07_trade_review", f"""SELECT id, CASE WHEN moved IS NULL OR pnl IS NULL THEN 'UNKNOWN' WHEN right_way AND pnl > 0 THEN 'RIGHT_AND_PAID' WHEN right_way THEN 'RIGHT_BUT_LOST' WHEN pnl > 0 THEN 'WRONG_BUT_PAID' ELSE 'WRONG_AND_LOST' END AS review
    FROM (SELECT t.id, t.pnl, b.close / a.close - 1 AS moved, (b.close > a.close) = (t.direction = 'BULLISH') AS right_way FROM {_METRICS} t
    LEFT JOIN {{bars}} a ON a.ticker = t.ticker AND a.trade_date = t.opened_date LEFT JOIN {{bars}} b ON b.ticker = t.ticker AND b.trade_date = t.opened_date + CAST(t.holding_days AS INT) WHERE t.status = 'CLOSED')""")
def _(get):
    """Was the direction right, and did the trade pay?"""
    t = A.trade_metrics(get("trades")).where("status = 'CLOSED'").withColumn("closed_date", F.date_add("opened_date", F.col("holding_days").cast("int")))
    bars = get("bars")
    j = t.join(bars.select("ticker", F.col("trade_date").alias("opened_date"), F.col("close").alias("a")), ["ticker", "opened_date"], "left").join(bars.select("ticker", F.col("trade_date").alias("closed_date"), F.col("close").alias("b")), ["ticker", "closed_date"], "left")
    right = (F.col("b") > F.col("a")) == (F.col("direction") == "BULLISH")
    return j.select("id", F.when(F.col("a").isNull() | F.col("b").isNull() | F.col("pnl").isNull(), "UNKNOWN").when(right & (F.col("pnl") > 0), "RIGHT_AND_PAID").when(right, "RIGHT_BUT_LOST").when(F.col("pnl") > 0, "WRONG_BUT_PAID").otherwise("WRONG_AND_LOST").alias("review"))


@query("x01_increment", """SELECT ticker, trade_date, ROUND(sma, 6) AS sma_20 FROM (SELECT b.ticker, b.trade_date, CASE WHEN COUNT(close) OVER w = 20 THEN AVG(close) OVER w END AS sma, m.mark FROM {bars} b LEFT JOIN (SELECT ticker, MAX(trade_date) AS mark FROM {option_chain} GROUP BY ticker) m ON m.ticker = b.ticker
    WINDOW w AS (PARTITION BY b.ticker ORDER BY b.session_no ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE mark IS NULL OR trade_date > mark""")
def _(get):
    """Recomputed only past each ticker's high-water mark, over a warm-up of 400 days before it."""
    marks = get("option_chain").groupBy("ticker").agg(F.max("trade_date").alias("mark"))
    b = get("bars").join(marks, "ticker", "left").where("mark IS NULL OR trade_date > date_sub(mark, 400)")
    return b.select("ticker", "trade_date", "mark", W.sma(20).alias("sma_20")).where("mark IS NULL OR trade_date > mark").drop("mark")
