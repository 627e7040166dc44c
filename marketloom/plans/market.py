"""Further queries of the market inventory: predicates, point-in-time joins, top-k, set operations, scores, options
and streaming forms.  Registered through the registry, which imports this module at its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import options as O
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import signals as M
from ..operators import windows as W
from .registry import _METRICS, _N, _NORMAL, OVER, query, r, rows

EARNINGS_DAY = "1998-06-01"
FRESH_AT = "2024-01-09 00:00:00"
CHAIN = ["ticker", "trade_date", "expiration", "opt_right", "strike"]


def _day() -> Column:
    return F.lit(EARNINGS_DAY).cast("date")


# --- predicates and projections --------------------------------------------------------------------------------------


@query("p02_fresh_articles", f"SELECT id, ticker FROM {{articles}} WHERE published_at IS NOT NULL AND CAST(published_at AS TIMESTAMP) >= TIMESTAMP '{FRESH_AT}' - INTERVAL 7 DAYS")
def _(get):
    return get("articles").where(F.col("published_at") >= F.lit(FRESH_AT).cast("timestamp") - F.expr("INTERVAL 7 DAYS")).select("id", "ticker")


@query(
    "p05_historical_liquidity",
    """SELECT ticker, trade_date, COUNT(*) AS quotes, COUNT(*) FILTER (WHERE bid > 0 AND ask > 0 AND COALESCE(open_interest, 25) >= 25 AND COALESCE((ask - bid) / NULLIF((ask + bid) / 2, 0), 0) <= 0.25 AND iv IS NOT NULL) AS liquid
    FROM {option_chain} GROUP BY ticker, trade_date""",
)
def _(get):
    spread = (F.col("ask") - F.col("bid")) / F.nullif((F.col("ask") + F.col("bid")) / 2, F.lit(0.0))
    ok = (F.col("bid") > 0) & (F.col("ask") > 0) & (F.coalesce("open_interest", F.lit(25)) >= 25) & (F.coalesce(spread, F.lit(0.0)) <= 0.25) & F.col("iv").isNotNull()
    return get("option_chain").groupBy("ticker", "trade_date").agg(F.count("*").alias("quotes"), F.count_if(ok).alias("liquid"))


@query(
    "p06_quote_quality",
    f"SELECT ticker, trade_date, expiration, opt_right, strike, {r(mid='CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 ELSE COALESCE(NULLIF(ask, 0), NULLIF(bid, 0)) END', spread_pct='CASE WHEN bid > 0 AND ask > 0 THEN (ask - bid) / ((bid + ask) / 2) END')} FROM {{option_chain}}",
)
def _(get):
    two_sided, mid = (F.col("bid") > 0) & (F.col("ask") > 0), (F.col("bid") + F.col("ask")) / 2
    one_sided = F.coalesce(F.nullif("ask", F.lit(0.0)), F.nullif("bid", F.lit(0.0)))
    return get("option_chain").select(*CHAIN, F.when(two_sided, mid).otherwise(one_sided).alias("mid"), F.when(two_sided, (F.col("ask") - F.col("bid")) / mid).alias("spread_pct"))


@query("p07_plausible_iv", "SELECT ticker, COUNT(*) FILTER (WHERE iv > 0.01 AND iv < 3) AS atm, COUNT(*) FILTER (WHERE iv > 0.01 AND iv < 5) AS surface, COUNT(*) FILTER (WHERE iv IS NULL OR iv <= 0.01 OR iv > 3) AS recompute FROM {option_chain} GROUP BY ticker")
def _(get):
    iv = F.col("iv")
    return get("option_chain").groupBy("ticker").agg(F.count_if((iv > 0.01) & (iv < 3)).alias("atm"), F.count_if((iv > 0.01) & (iv < 5)).alias("surface"), F.count_if(iv.isNull() | (iv <= 0.01) | (iv > 3)).alias("recompute"))


@query(
    "p08_expiry_window",
    "SELECT ticker, trade_date, ARG_MIN(dte, CASE WHEN dte BETWEEN 40 AND 60 THEN 0 ELSE 100000 END + ABS(dte - 45) * 1000 + dte) AS dte, NOT BOOL_OR(dte BETWEEN 40 AND 60) AS widened FROM {option_chain} WHERE dte >= 7 GROUP BY ticker, trade_date",
)
def _(get):
    inside = F.col("dte").between(40, 60)
    return get("option_chain").where("dte >= 7").groupBy("ticker", "trade_date").agg(F.min_by("dte", F.struct((~inside).alias("far"), F.abs(F.col("dte") - 45).alias("off"), "dte")).alias("dte"), (~F.bool_or(inside)).alias("widened"))


@query("p09_purge_stale_upcoming", f"SELECT ticker, seq FROM {{earnings_events}} WHERE NOT (is_upcoming AND eps_actual IS NULL AND report_date < DATE '{EARNINGS_DAY}' - 3)")
def _(get):
    return get("earnings_events").where(~(F.col("is_upcoming") & F.col("eps_actual").isNull() & (F.col("report_date") < F.date_sub(_day(), 3)))).select("ticker", "seq")


#: Words of material analyst actions.
MATERIAL = "UPGRADE|DOWNGRADE|INITIAT|REINST|RAISE|LOWER|CUT|INCREASE|DECREASE"


@query("p10_material_actions", f"SELECT external_id, ticker FROM {{analyst_rating_events}} WHERE REGEXP_MATCHES(UPPER(CONCAT(COALESCE(action_company, ''), ' ', COALESCE(action_pt, ''))), '{MATERIAL}')")
def _(get):
    return get("analyst_rating_events").where(F.upper(F.concat_ws(" ", "action_company", "action_pt")).rlike(MATERIAL)).select("external_id", "ticker")


@query("p11_calendar_month", f"SELECT e.ticker, e.seq, e.report_date FROM {{earnings_events}} e WHERE e.is_upcoming AND e.report_date >= DATE '{EARNINGS_DAY}' AND e.report_date < DATE '{EARNINGS_DAY}' + INTERVAL 1 MONTH AND e.ticker IN (SELECT s_suppkey FROM {{supplier}} WHERE s_acctbal > 0)")
def _(get):
    basket = get("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker"))
    month = (F.col("report_date") >= _day()) & (F.col("report_date") < F.add_months(_day(), 1))
    return get("earnings_events").where(F.col("is_upcoming") & month).join(basket, "ticker", "left_semi").select("ticker", "seq", "report_date")


@query("p13_finite_clamp", "SELECT ticker, seq, ROUND(CASE WHEN eps_estimate <> 0 AND eps_actual IS NOT NULL THEN LEAST(GREATEST(eps_actual / eps_estimate, -5), 5) END, 6) AS ratio FROM {earnings_events}")
def _(get):
    ratio = S.clamp(S.finite(F.try_divide("eps_actual", "eps_estimate")), -5.0, 5.0)
    return get("earnings_events").select("ticker", "seq", ratio.alias("ratio"))


#: Chart ranges and their days.
RANGES = {"1D": 3, "5D": 10, "1M": 40, "3M": 110, "6M": 220, "1Y": 380}
_RANGES = ", ".join(f"('{k}', {v})" for k, v in RANGES.items())


@query(
    "p15_chart_ranges",
    f"""WITH b AS (SELECT *, MAX(trade_date) OVER (PARTITION BY ticker) AS at FROM {{bars}})
    SELECT ticker, label, COUNT(*) AS bars, MAX(high) AS high, MIN(low) AS low, {r(change_pct='(ARG_MAX(close, trade_date) / ARG_MIN(close, trade_date) - 1) * 100')}
    FROM b JOIN (VALUES {_RANGES}) AS g(label, days) ON b.trade_date >= b.at - CAST(days AS INT) GROUP BY ticker, label""",
)
def _(get):
    labels = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("days")) for k, v in RANGES.items()])
    age = F.datediff(F.max("trade_date").over(Window.partitionBy("ticker")), "trade_date")
    b = get("bars").withColumn("age", age).where(F.col("age") <= max(RANGES.values())).withColumn("range", F.explode(F.filter(labels, lambda x: x["days"] >= F.col("age"))))
    change = F.max_by("close", "trade_date") / F.min_by("close", "trade_date") - 1
    return b.groupBy("ticker", F.col("range.label").alias("label")).agg(F.count("*").alias("bars"), F.max("high").alias("high"), F.min("low").alias("low"), (change * 100).alias("change_pct"))


# --- joins ---------------------------------------------------------------------------------------------------------------

_SNAPSHOTS = "(SELECT ticker, trade_date AS snapshot_date, AVG(iv) AS iv FROM {option_chain} WHERE iv IS NOT NULL GROUP BY ticker, trade_date)"
_REGIME = f"(SELECT trade_date AS regime_date, AVG(ret) AS mean_return, COUNT(ret) AS n FROM (SELECT trade_date, (close / LAG(close) {OVER}) - 1) * 100 AS ret FROM {{bars}}) WHERE ret IS NOT NULL GROUP BY trade_date)"


def snapshots(get) -> DataFrame:
    return get("option_chain").where("iv is not null").groupBy("ticker", F.col("trade_date").alias("snapshot_date")).agg(F.avg("iv").alias("iv"))


def regime(get) -> DataFrame:
    """One row for each day."""
    return W.with_returns(get("bars")).where("ret is not null").groupBy(F.col("trade_date").alias("regime_date")).agg(F.avg("ret").alias("mean_return"), F.count("ret").alias("n"))


def asof_day(left: DataFrame, daily: DataFrame, left_on: str, day: str) -> DataFrame:
    """As-of without a key: the daily row is carried over the distinct days (one row each, so the window is bounded by
    the calendar), then joined by equality; the left side is not sorted and never in one partition."""
    days = J.asof_join(left.select(left_on).distinct(), daily, [], left_on, day)
    return left.join(days, left_on, "left")


@query("j04_asof_regime", f"SELECT t.id, t.opened_date, g.regime_date, ROUND(g.mean_return, 6) AS mean_return FROM {{trades}} t ASOF LEFT JOIN {_REGIME} g ON t.opened_date >= g.regime_date")
def _(get):
    return asof_day(get("trades").select("id", "opened_date"), regime(get), "opened_date", "regime_date").select("id", "opened_date", "regime_date", "mean_return")


@query("j05_asof_options", f"SELECT t.id, s.snapshot_date, ROUND(s.iv, 6) AS iv FROM {{trades}} t ASOF LEFT JOIN {_SNAPSHOTS} s ON t.ticker = s.ticker AND t.opened_date >= s.snapshot_date")
def _(get):
    return J.asof_join(get("trades").select("id", "ticker", "opened_date"), snapshots(get), ["ticker"], "opened_date", "snapshot_date").select("id", "snapshot_date", "iv")


@query(
    "j07_entry_context",
    f"""WITH a AS (SELECT t.id, t.ticker, t.opened_date, p.prediction_date, p.score FROM {{trades}} t ASOF LEFT JOIN {{predictions}} p ON t.ticker = p.ticker AND t.opened_date >= p.prediction_date),
    b AS (SELECT a.*, s.snapshot_date, s.iv FROM a ASOF LEFT JOIN {_SNAPSHOTS} s ON a.ticker = s.ticker AND a.opened_date >= s.snapshot_date),
    c AS (SELECT b.*, g.mean_return FROM b ASOF LEFT JOIN {_REGIME} g ON b.opened_date >= g.regime_date)
    SELECT c.id, c.prediction_date, c.score, c.snapshot_date, ROUND(c.iv, 6) AS iv, ROUND(c.mean_return, 6) AS mean_return,
      COUNT(o.close) AS sessions_before, ROUND(MAX(o.high), 6) AS high_before FROM c LEFT JOIN {{bars}} o ON o.ticker = c.ticker AND o.trade_date BETWEEN c.opened_date - 30 AND c.opened_date GROUP BY ALL""",
)
def _(get):
    t = get("trades").select("id", "ticker", "opened_date")
    t = J.asof_join(t, get("predictions").select("ticker", "prediction_date", "score"), ["ticker"], "opened_date", "prediction_date")
    t = asof_day(J.asof_join(t, snapshots(get), ["ticker"], "opened_date", "snapshot_date"), regime(get), "opened_date", "regime_date")
    # one window result for each (ticker, day) that trades ask for, however many trades it has
    asked = t.select("ticker", "opened_date").distinct()
    seen = J.interval_join(asked, get("bars").select("ticker", "trade_date", "high"), ["ticker"], "opened_date", "trade_date", 30).groupBy("ticker", "opened_date").agg(F.count("*").alias("sessions_before"), F.max("high").alias("high_before"))
    return t.join(seen, ["ticker", "opened_date"], "left").na.fill(0, ["sessions_before"]).select("id", "prediction_date", "score", "snapshot_date", "iv", "mean_return", "sessions_before", "high_before")


@query(
    "j10_exit_date",
    """WITH c AS (SELECT id, ticker, opened_date + CAST(holding_days AS INT) AS target FROM {trades}), d AS (SELECT DISTINCT ticker, trade_date FROM {option_chain})
    SELECT c.id, MIN(d.trade_date) AS exit_date FROM c LEFT JOIN d ON d.ticker = c.ticker AND d.trade_date BETWEEN c.target AND c.target + 7 AND ISODOW(d.trade_date) < 6 GROUP BY c.id""",
)
def _(get):
    """The first chain day among the target and the five business days after it: the weekdays of eight days."""
    target = F.date_add("opened_date", F.col("holding_days").cast("int"))
    days = F.filter(F.sequence(target, F.date_add(target, 7)), lambda d: F.weekday(d) < 5)
    asked = get("trades").select("id", "ticker", F.explode_outer(days).alias("trade_date"))
    found = asked.join(get("option_chain").select("ticker", "trade_date").distinct().withColumn("exit_date", F.col("trade_date")), ["ticker", "trade_date"], "left")
    return found.groupBy("id").agg(F.min("exit_date").alias("exit_date"))


_WATCHED = "(SELECT s_suppkey AS ticker FROM {supplier} WHERE s_acctbal > 0 UNION SELECT ticker FROM {trades} WHERE status = 'OPEN')"


def watched(get) -> DataFrame:
    """Tickers of the basket and of open positions."""
    return get("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker")).union(get("trades").where("status = 'OPEN'").select("ticker")).distinct()


@query("u02_watched_tickers", f"SELECT ticker FROM {_WATCHED}")
def _(get):
    return watched(get)


@query("j12_watched_events", f"SELECT external_id, ticker FROM {{analyst_rating_events}} WHERE ticker IN (SELECT ticker FROM {_WATCHED})")
def _(get):
    return get("analyst_rating_events").join(watched(get), "ticker", "left_semi").select("external_id", "ticker")


@query(
    "j14_relative_strength",
    f"""WITH p AS (SELECT ticker, trade_date, close / LAG(close, 20) {OVER}) - 1 AS ret_20 FROM {{bars}})
    SELECT p.ticker, p.trade_date, ROUND((p.ret_20 - b.one) * 100, 6) AS versus_first, ROUND((p.ret_20 - b.two) * 100, 6) AS versus_second FROM p JOIN (SELECT trade_date, MAX(CASE WHEN ticker = 1 THEN ret_20 END) AS one, MAX(CASE WHEN ticker = 2 THEN ret_20 END) AS two FROM p GROUP BY trade_date) b ON b.trade_date = p.trade_date""",
)
def _(get):
    p = get("bars").select("ticker", "trade_date", W.ret(20).alias("ret_20"))
    bench = p.groupBy("trade_date").agg(*[F.max(F.when(F.col("ticker") == k, F.col("ret_20"))).alias(n) for k, n in ((1, "a"), (2, "b"))])
    return p.join(bench, "trade_date").select("ticker", "trade_date", ((F.col("ret_20") - F.col("a")) * 100).alias("versus_first"), ((F.col("ret_20") - F.col("b")) * 100).alias("versus_second"))


@query(
    "j17_label_against_universe",
    f"""WITH f AS (SELECT ticker, session_no, {', '.join(f'(LEAD(close, {h}) {OVER}) / close - 1) * 100 AS f{h}' for h in (5, 10, 21))} FROM {{bars}}),
    l AS (SELECT CASE WHEN p.score >= 0.2 THEN 'BULLISH' WHEN p.score <= -0.2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label, u.horizon, u.ret FROM {{predictions}} p JOIN f USING (ticker, session_no)
      CROSS JOIN LATERAL (VALUES (5, f.f5), (10, f.f10), (21, f.f21)) AS u(horizon, ret) WHERE u.ret IS NOT NULL)
    SELECT label, horizon, COUNT(*) AS n, ROUND(AVG(ret), 6) AS mean_return, ROUND(AVG(ret) - SUM(SUM(ret)) OVER (PARTITION BY horizon) / SUM(COUNT(*)) OVER (PARTITION BY horizon), 6) AS excess FROM l GROUP BY label, horizon""",
)
def _(get):
    wide = get("bars").select("ticker", "session_no", F.array(*[F.struct(F.lit(h).alias("horizon"), (W.forward(h) * 100).alias("ret")) for h in (5, 10, 21)]).alias("all"))
    f = wide.select("ticker", "session_no", F.explode("all").alias("e")).select("ticker", "session_no", "e.*")
    p = get("predictions").select("ticker", "session_no", S.sentiment_label(F.col("score")).alias("label"))
    g = p.join(f.where("ret is not null"), ["ticker", "session_no"]).groupBy("label", "horizon").agg(F.count("*").alias("n"), F.sum("ret").alias("total"))
    w = Window.partitionBy("horizon")
    mean = F.col("total") / F.col("n")
    return g.select("label", "horizon", "n", mean.alias("mean_return"), (mean - F.sum("total").over(w) / F.sum("n").over(w)).alias("excess"))


@query(
    "j18_price_with_iv",
    f"""WITH p AS (SELECT ticker, trade_date, close FROM {{bars}} QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY trade_date DESC) = 1),
    s AS (SELECT ticker, ARG_MAX(iv, snapshot_date) AS iv_current, MIN(iv) AS iv_low, MAX(iv) AS iv_high, COUNT(*) AS iv_days FROM {_SNAPSHOTS} GROUP BY ticker)
    SELECT p.ticker, p.trade_date, p.close, {r(iv='iv_current', iv_low='iv_low', iv_high='iv_high', iv_rank='CASE WHEN iv_high - iv_low > 1e-9 THEN ROUND((iv_current - iv_low) / (iv_high - iv_low) * 100, 3) WHEN iv_high IS NOT NULL THEN 50 END')}, COALESCE(iv_days, 0) AS iv_days FROM p LEFT JOIN s USING (ticker)""",
)
def _(get):
    p = J.latest_per_key(get("bars"), ["ticker"], "trade_date").select("ticker", "trade_date", "close")
    s = snapshots(get).groupBy("ticker").agg(F.max_by("iv", "snapshot_date").alias("iv"), F.min("iv").alias("iv_low"), F.max("iv").alias("iv_high"), F.count("*").alias("iv_days"))
    rng = F.col("iv_high") - F.col("iv_low")
    rank = F.when(rng > 1e-9, F.round((F.col("iv") - F.col("iv_low")) / rng * 100, 3)).when(F.col("iv_high").isNotNull(), 50.0)
    return p.join(s, "ticker", "left").withColumn("iv_rank", rank).na.fill(0, ["iv_days"])


_ENDS = """(SELECT ticker, MIN(report_date) FILTER (WHERE report_date >= DATE '{day}') AS next_report, ARG_MAX((eps_actual - eps_estimate) / ABS(eps_estimate) * 100, CAST(EPOCH(report_date) AS BIGINT) * 1000000000 + seq) FILTER (WHERE report_date < DATE '{day}' AND eps_actual IS NOT NULL AND ABS(eps_estimate) >= 0.01) AS surprise
    FROM {earnings_events} GROUP BY ticker)""".replace("{day}", EARNINGS_DAY)


def report_ends(get) -> DataFrame:
    e, known = get("earnings_events"), (F.col("report_date") < _day()) & F.col("eps_actual").isNotNull() & (F.abs("eps_estimate") >= 0.01)
    raw = F.try_divide(F.col("eps_actual") - F.col("eps_estimate"), F.abs("eps_estimate")) * 100
    return e.groupBy("ticker").agg(F.min(F.when(F.col("report_date") >= _day(), F.col("report_date"))).alias("next_report"), F.max_by(raw, F.when(known, F.struct("report_date", "seq"))).alias("surprise"))


@query("t12_report_ends", f"SELECT ticker, next_report, ROUND(surprise, 6) AS surprise FROM {_ENDS}")
def _(get):
    return report_ends(get)


@query(
    "j02_basket_state",
    f"""WITH p AS (SELECT ticker, ARG_MAX(close, trade_date) AS close, MAX(trade_date) AS trade_date FROM {{bars}} GROUP BY ticker), o AS (SELECT ticker, ARG_MAX(iv, snapshot_date) AS iv FROM {_SNAPSHOTS} GROUP BY ticker),
    q AS (SELECT ticker, ARG_MAX(score, prediction_date) AS score FROM {{predictions}} GROUP BY ticker), a AS (SELECT ticker, COUNT(*) AS articles FROM {{articles}} GROUP BY ticker)
    SELECT s.s_suppkey AS ticker, p.trade_date, p.close, ROUND(o.iv, 6) AS iv, q.score, e.next_report, COALESCE(a.articles, 0) AS articles
    FROM {{supplier}} s LEFT JOIN p ON p.ticker = s.s_suppkey LEFT JOIN o ON o.ticker = s.s_suppkey LEFT JOIN q ON q.ticker = s.s_suppkey LEFT JOIN {_ENDS} e ON e.ticker = s.s_suppkey LEFT JOIN a ON a.ticker = s.s_suppkey WHERE s.s_acctbal > 0""",
)
def _(get):
    sides = [
        get("bars").groupBy("ticker").agg(F.max_by("close", "trade_date").alias("close"), F.max("trade_date").alias("trade_date")), snapshots(get).groupBy("ticker").agg(F.max_by("iv", "snapshot_date").alias("iv")),
        get("predictions").groupBy("ticker").agg(F.max_by("score", "prediction_date").alias("score")), report_ends(get).select("ticker", "next_report"), get("articles").groupBy("ticker").agg(F.count("*").alias("articles")),
    ]
    out = get("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker"))
    for side in sides:
        out = out.join(side, "ticker", "left")
    return out.na.fill(0, ["articles"]).select("ticker", "trade_date", "close", "iv", "score", "next_report", "articles")


# --- top-k and sets --------------------------------------------------------------------------------------------------------


@query("t02_first_last", "SELECT ticker, ARG_MIN(close, trade_date) AS first_close, ARG_MAX(close, trade_date) AS last_close, MAX(trade_date) AS trade_date FROM {bars} GROUP BY ticker")
def _(get):
    return get("bars").groupBy("ticker").agg(F.min_by("close", "trade_date").alias("first_close"), F.max_by("close", "trade_date").alias("last_close"), F.max("trade_date").alias("trade_date"))


@query("t08_change_feed", f"SELECT external_id, ticker, action_company, action_pt FROM {{analyst_rating_events}} WHERE REGEXP_MATCHES(UPPER(CONCAT(action_company, ' ', action_pt)), '{MATERIAL}') ORDER BY published_at DESC, external_id DESC LIMIT 12")
def _(get):
    return get("analyst_rating_events").where(F.upper(F.concat_ws(" ", "action_company", "action_pt")).rlike(MATERIAL)).orderBy(F.desc("published_at"), F.desc("external_id")).limit(12).select("external_id", "ticker", "action_company", "action_pt")


@query("t10_enrichment_candidates", "SELECT ticker, prediction_date, score FROM {predictions} WHERE ABS(score) >= 0.2 ORDER BY prediction_date DESC, ABS(score) DESC, ticker LIMIT 200")
def _(get):
    return get("predictions").where(F.abs("score") >= 0.2).orderBy(F.desc("prediction_date"), F.desc(F.abs("score")), "ticker").limit(200).select("ticker", "prediction_date", "score")


@query(
    "u01_calendar",
    """SELECT 'earnings' AS kind, ticker, CAST(seq AS VARCHAR) AS ref, CAST(report_date AS TIMESTAMP) AS at FROM {earnings_events}
    UNION ALL SELECT 'analyst', ticker, CAST(external_id AS VARCHAR), DATE_TRUNC('second', CAST(published_at AS TIMESTAMP)) FROM {analyst_rating_events}""",
)
def _(get):
    e = get("earnings_events").select(F.lit("earnings").alias("kind"), "ticker", F.col("seq").cast("string").alias("ref"), F.col("report_date").cast("timestamp").alias("at"))
    a = get("analyst_rating_events").select(F.lit("analyst").alias("kind"), "ticker", F.col("external_id").cast("string").alias("ref"), F.date_trunc("second", "published_at").alias("at"))
    return e.unionByName(a)


@query(
    "u04_article_insert",
    f"""WITH a AS (SELECT id, ticker, CASE WHEN COALESCE(headline, '') = '' THEN CONCAT('#', id) ELSE {_NORMAL} END AS k, url FROM {{articles}}),
    u AS (SELECT * FROM a QUALIFY ROW_NUMBER() OVER (PARTITION BY COALESCE(url, CONCAT('#', id)) ORDER BY id) = 1) SELECT id, ticker FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, k ORDER BY id) = 1""",
)
def _(get):
    """The first article of a URL stays, of these the first of a headline; aggregated before the shuffle, not ranked."""
    own = F.concat(F.lit("#"), F.col("id").cast("string"))
    a = get("articles").select("id", "ticker", "headline", F.coalesce("url", own).alias("url"))
    first = a.groupBy("url").agg(F.min_by(F.struct("id", "ticker", "headline"), "id").alias("a")).select("a.*")
    key = F.when(F.coalesce("headline", F.lit("")) == "", own).otherwise(S.headline_key(F.col("headline")))
    return first.groupBy("ticker", key.alias("k")).agg(F.min("id").alias("id")).select("id", "ticker")


@query("u07_analyst_upsert", "SELECT SHA1(CONCAT_WS('|', ticker, action_company, action_pt, rating_current)) AS key, MAX(external_id) AS external_id, COUNT(*) AS versions FROM {analyst_rating_events} GROUP BY ticker, action_company, action_pt, rating_current")
def _(get):
    parts = ["ticker", "action_company", "action_pt", "rating_current"]
    return get("analyst_rating_events").groupBy(*parts).agg(F.max("external_id").alias("external_id"), F.count("*").alias("versions")).select(F.sha1(F.concat_ws("|", *[F.col(p).cast("string") for p in parts])).alias("key"), "external_id", "versions")


@query("u13_provider_fallback", "SELECT external_id, ticker, action_company AS source FROM {analyst_rating_events} e WHERE action_company = 'Upgrades' OR (action_company = 'Reiterates' AND NOT EXISTS (SELECT 1 FROM {analyst_rating_events} p WHERE p.ticker = e.ticker AND p.action_company = 'Upgrades'))")
def _(get):
    """Rows of the second source only for tickers of which the first has none."""
    e = get("analyst_rating_events").select("external_id", "ticker", F.col("action_company").alias("source"))
    first = e.where("source = 'Upgrades'")
    return first.unionByName(e.where("source = 'Reiterates'").join(first.select("ticker").distinct(), "ticker", "left_anti"))


# --- scores ----------------------------------------------------------------------------------------------------------------


@query(
    "m04_fundamental",
    """WITH s AS (SELECT ticker, GREATEST(LEAST((eps_actual - eps_estimate) / ABS(eps_estimate) * 100, 200), -200) AS surprise FROM {earnings_events} WHERE eps_actual IS NOT NULL AND ABS(eps_estimate) >= 0.01 QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY report_date DESC, seq DESC) <= 4),
    g AS (SELECT ticker, COUNT(*) AS n, LEAST(GREATEST(AVG(ROUND(surprise, 4)) / 10, -1), 1) AS a, (AVG(CAST(surprise > 0 AS INT)) - 0.5) * 2 AS b FROM s GROUP BY ticker)
    SELECT ticker, n, ROUND(CASE WHEN n >= 2 THEN (a * 1.2 + b * 0.8) / 2.0 ELSE a END, 4) AS fundamental, ROUND(CASE WHEN n >= 2 THEN 2 ELSE 1 END / 3.0, 4) AS confidence FROM g""",
    4,
)
def _(get):
    """Of the last four results with a surprise: their mean and the share of beats."""
    s = get("earnings_events").withColumn("surprise", S.surprise_pct(F.col("eps_actual"), F.col("eps_estimate"))).where("surprise is not null")
    g = J.latest_n(s, ["ticker"], [F.desc("report_date"), F.desc("seq")], 4).groupBy("ticker").agg(F.count("*").alias("n"), F.avg("surprise").alias("mean"), F.avg((F.col("surprise") > 0).cast("int")).alias("share"))
    a, b = S.clamp(F.col("mean") / 10, -1.0, 1.0), F.when(F.col("n") >= 2, (F.col("share") - 0.5) * 2)
    return g.select("ticker", "n", S.weighted_mean([(a, 1.2), (b, 0.8)]).alias("fundamental"), (S.present([a, b]) / 3).alias("confidence"))


@query(
    "m05_event",
    f"""WITH h AS (SELECT ticker, ARG_MAX(close, session_no) / ARG_MAX(hi, session_no) - 1 AS off FROM (SELECT ticker, session_no, close, MAX(high) {rows(252)} AS hi FROM {{bars}}) GROUP BY ticker),
    x AS (SELECT h.ticker, CAST(e.next_report AS DATE) - DATE '{EARNINGS_DAY}' AS days, e.surprise, h.off FROM h LEFT JOIN {_ENDS} e USING (ticker)),
    y AS (SELECT ticker, CAST(days AS INT) AS days_to_earnings, CASE WHEN days = 0 THEN -0.6 WHEN days = 1 THEN -0.5 WHEN days = 2 THEN -0.4 WHEN days = 3 THEN -0.3 WHEN days <= 7 THEN -0.15 WHEN days <= 21 THEN 0.05 WHEN days IS NOT NULL THEN 0 END AS a,
      CASE WHEN surprise IS NOT NULL THEN LEAST(GREATEST(surprise / 15, -1), 1) END AS b, CASE WHEN off >= -0.02 THEN 0.7 WHEN off >= -0.10 THEN 0.3 WHEN off IS NOT NULL THEN 0 END AS c FROM x)
    SELECT ticker, days_to_earnings, ROUND((COALESCE(a * 1.2, 0) + COALESCE(b, 0) + COALESCE(c * 0.6, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 1.2 END + CASE WHEN b IS NULL THEN 0 ELSE 1.0 END + CASE WHEN c IS NULL THEN 0 ELSE 0.6 END), 4) AS event FROM y""",
    4,
)
def _(get):
    """Next report, last surprise and distance from the high."""
    high = W.high_low()["high_n"]
    h = J.latest_per_key(get("bars").withColumn("off", F.col("close") / high - 1), ["ticker"], "trade_date").select("ticker", "off")
    days = F.datediff("next_report", _day())
    soon = F.when(days == 0, -0.6).when(days == 1, -0.5).when(days == 2, -0.4).when(days == 3, -0.3).when(days <= 7, -0.15).when(days <= 21, 0.05).when(days.isNotNull(), 0.0)
    parts = [(soon, 1.2), (S.clamp(F.col("surprise") / 15, -1.0, 1.0), 1.0), (M.bands(F.col("off"), [(-0.02, 0.7), (-0.10, 0.3)], 0.0), 0.6)]
    return h.join(report_ends(get), "ticker", "left").select("ticker", days.alias("days_to_earnings"), S.weighted_mean(parts).alias("event"))


@query(
    "m27_analyst_event_score",
    """SELECT external_id, s AS score, CASE WHEN s >= 4 THEN 'STRONGLY POSITIVE' WHEN s >= 1.5 THEN 'POSITIVE' WHEN s <= -4 THEN 'STRONGLY NEGATIVE' WHEN s <= -1.5 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS state FROM (SELECT external_id,
      CAST(CASE action_company WHEN 'Upgrades' THEN 2.0 WHEN 'Downgrades' THEN -2.0 WHEN 'Initiates' THEN CASE WHEN rating_current IN ('Buy', 'Overweight') THEN 1.5 WHEN rating_current IN ('Sell', 'Underperform') THEN -1.5 ELSE 0 END ELSE 0 END
      + CASE action_pt WHEN 'Raises' THEN 1.0 WHEN 'Lowers' THEN -1.0 ELSE 0 END AS DOUBLE) AS s FROM {analyst_rating_events})""",
)
def _(get):
    scored = A.analyst_event_score(F.col("action_company"), F.col("action_pt"), F.col("rating_current"))
    return get("analyst_rating_events").select("external_id", scored.alias("score")).withColumn("state", A.momentum_state(F.col("score")))


@query(
    "m28_position_warnings",
    f"""WITH q AS (SELECT ticker, ARG_MAX(score, prediction_date) AS score FROM {{predictions}} GROUP BY ticker)
    SELECT t.id, COALESCE(e.next_report - DATE '{EARNINGS_DAY}' BETWEEN 0 AND 7, false) AS earnings_soon, COALESCE((t.direction = 'BULLISH' AND q.score <= -0.2) OR (t.direction = 'BEARISH' AND q.score >= 0.2), false) AS flipped
    FROM {{trades}} t LEFT JOIN q USING (ticker) LEFT JOIN {_ENDS} e USING (ticker) WHERE t.status = 'OPEN'""",
)
def _(get):
    q = get("predictions").groupBy("ticker").agg(F.max_by("score", "prediction_date").alias("score"))
    t = get("trades").where("status = 'OPEN'").select("id", "ticker", "direction").join(q, "ticker", "left").join(report_ends(get), "ticker", "left")
    flipped = ((F.col("direction") == "BULLISH") & (F.col("score") <= -0.2)) | ((F.col("direction") == "BEARISH") & (F.col("score") >= 0.2))
    false = F.lit(False)
    return t.select("id", F.coalesce(F.datediff("next_report", _day()).between(0, 7), false).alias("earnings_soon"), F.coalesce(flipped, false).alias("flipped"))


_ALERT = "CASE WHEN score >= 0.6 THEN 'BULLISH' WHEN score <= -0.3 THEN 'BEARISH' END"


@query("m29_alerts", f"SELECT ticker, prediction_date, score, {_ALERT} AS direction FROM {{predictions}} WHERE score >= 0.6 OR score <= -0.3")
def _(get):
    return get("predictions").select("ticker", "prediction_date", "score", F.when(F.col("score") >= 0.6, "BULLISH").when(F.col("score") <= -0.3, "BEARISH").alias("direction")).where("direction is not null")


@query("x07_alert_once", f"SELECT ticker, {_ALERT} AS direction, DATE_TRUNC('week', prediction_date) AS session, MIN(prediction_date) AS first_at, COUNT(*) AS fired FROM {{predictions}} WHERE score >= 0.6 OR score <= -0.3 GROUP BY 1, 2, 3")
def _(get):
    """One alert for a ticker, direction and session (a week here); a group-by is its batch form."""
    direction = F.when(F.col("score") >= 0.6, "BULLISH").when(F.col("score") <= -0.3, "BEARISH")
    p = get("predictions").select("ticker", direction.alias("direction"), "prediction_date").where("direction is not null")
    return p.groupBy("ticker", "direction", F.trunc("prediction_date", "week").alias("session")).agg(F.min("prediction_date").alias("first_at"), F.count("*").alias("fired"))


@query(
    "x09_change_feed",
    "WITH l AS (SELECT ticker, prediction_date, CASE WHEN score >= 0.2 THEN 'BULLISH' WHEN score <= -0.2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label FROM {predictions}) SELECT ticker, prediction_date, LAG(label) OVER (PARTITION BY ticker ORDER BY prediction_date) AS was, label FROM l QUALIFY was <> label",
)
def _(get):
    p = get("predictions").select("ticker", "prediction_date", S.sentiment_label(F.col("score")).alias("label"))
    return p.withColumn("was", F.lag("label").over(Window.partitionBy("ticker").orderBy("prediction_date"))).where("was <> label")


_SESSION = "OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query("x05_session_vwap", f"SELECT event_id, ticker, {r(vwap=f'SUM(price * size) {_SESSION} / SUM(size) {_SESSION}')} FROM {{ticks}}")
def _(get):
    w = Window.partitionBy("ticker", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return get("ticks").select("event_id", "ticker", (F.sum(F.col("price") * F.col("size")).over(w) / F.sum("size").over(w)).alias("vwap"))


# --- options -----------------------------------------------------------------------------------------------------------------


@query("o04_probability_itm", f"SELECT ticker, trade_date, expiration, opt_right, strike, ROUND(CASE opt_right WHEN 'C' THEN n2 ELSE 1 - n2 END, 5) AS prob_itm FROM {_N}", 5)
def _(get):
    return O.with_greeks(get("option_chain").where("iv is not null")).select(*CHAIN, "prob_itm")


_DELTA = f"(SELECT ticker, trade_date, dte, strike, bid, ask, ROUND(ABS(n1 - 1), 5) + CASE WHEN bid >= 0.05 AND open_interest >= 100 AND volume >= 10 AND (ask - bid) / ((ask + bid) / 2) <= 0.10 THEN 0 ELSE 10 END AS d FROM {_N} WHERE opt_right = 'P')"
_COST = "ROUND(ABS((CASE WHEN d >= 10 THEN d - 10 ELSE d END) - {target}) + CASE WHEN d >= 10 THEN 0.15 ELSE 0 END, 5)"


@query(
    "t03_o06_put_spread_legs",
    f"""WITH c AS {_DELTA}, s AS (SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, trade_date, dte ORDER BY {_COST.replace('{target}', '0.30')}, strike) = 1),
    l AS (SELECT c.* FROM c JOIN s ON s.ticker = c.ticker AND s.trade_date = c.trade_date AND s.dte = c.dte AND s.strike <> c.strike QUALIFY ROW_NUMBER() OVER (PARTITION BY c.ticker, c.trade_date, c.dte ORDER BY {_COST.replace('{target}', '0.15').replace(' d ', ' c.d ').replace('THEN d -', 'THEN c.d -')}, c.strike) = 1)
    SELECT s.ticker, s.trade_date, s.dte, s.strike AS short_strike, l.strike AS long_strike, ROUND(l.ask - s.bid, 4) AS net_debit, ROUND((l.ask + l.bid) / 2 - (s.ask + s.bid) / 2, 4) AS net_debit_mid FROM s LEFT JOIN l ON l.ticker = s.ticker AND l.trade_date = s.trade_date AND l.dte = s.dte""",
    4,
)
def _(get):
    """Two legs in turn: the second may not take the first one's strike.  Both come from one pass over a chain's day,
    whose puts at one expiry are a bounded list.  Every expiry of a day has its spread."""
    c = O.with_greeks(get("option_chain").where("iv is not null and opt_right = 'P'"))
    strict = (F.col("bid") >= 0.05) & (F.col("open_interest") >= 100) & (F.col("volume") >= 10) & ((F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) <= 0.10)
    cost = lambda target: F.round(F.abs(F.round(F.abs("delta"), 5) - target) + F.when(strict, 0.0).otherwise(0.15), 5)
    quote = F.struct("strike", "bid", "ask")
    short = F.min_by(quote, F.struct(cost(0.30), "strike"))
    longs = F.sort_array(F.collect_list(F.struct(cost(0.15).alias("cost"), "strike", "bid", "ask")))
    g = c.groupBy("ticker", "trade_date", "dte").agg(short.alias("s"), longs.alias("ls")).withColumn("l", F.get(F.filter("ls", lambda x: x["strike"] != F.col("s.strike")), F.lit(0)))
    mid = lambda leg: (F.col(f"{leg}.ask") + F.col(f"{leg}.bid")) / 2
    return g.select("ticker", "trade_date", "dte", F.col("s.strike").alias("short_strike"), F.col("l.strike").alias("long_strike"), (F.col("l.ask") - F.col("s.bid")).alias("net_debit"), (mid("l") - mid("s")).alias("net_debit_mid"))


_ATM = "(SELECT ticker, trade_date, dte, AVG(iv) AS atm FROM (SELECT * FROM {option_chain} WHERE iv > 0.01 AND iv < 5 QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, trade_date, dte, opt_right ORDER BY ABS(strike - underlying_price), strike) = 1) GROUP BY ticker, trade_date, dte)"
_AT = {n: f"ARG_MIN(atm, ABS(dte - {n}) * 1000 + dte)" for n in (30, 60, 90)}


@query(
    "o12_vol_surface",
    f"""SELECT ticker, trade_date, {r(iv30=_AT[30], iv60=_AT[60], iv90=_AT[90], slope_60_30=f'{_AT[60]} - {_AT[30]}', expected_move=f'{_AT[30]} * SQRT(GREATEST(ARG_MIN(dte, ABS(dte - 30) * 1000 + dte), 1) / 365.0)')} FROM {_ATM} GROUP BY ticker, trade_date""",
)
def _(get):
    near = F.min_by("iv", F.struct(F.abs(F.col("strike") - F.col("underlying_price")), "strike"))
    atm = get("option_chain").where("iv > 0.01 and iv < 5").groupBy("ticker", "trade_date", "dte", "opt_right").agg(near.alias("iv")).groupBy("ticker", "trade_date", "dte").agg(F.avg("iv").alias("atm"))
    at = lambda c, n: F.min_by(c, F.struct(F.abs(F.col("dte") - n), "dte"))
    g = atm.groupBy("ticker", "trade_date").agg(*[at("atm", n).alias(f"iv{n}") for n in (30, 60, 90)], at("dte", 30).alias("near"))
    return g.select("ticker", "trade_date", "iv30", "iv60", "iv90", (F.col("iv60") - F.col("iv30")).alias("slope_60_30"), (F.col("iv30") * F.sqrt(F.greatest("near", F.lit(1)) / 365.0)).alias("expected_move"))


@query(
    "o11_atm_iv_sample",
    """WITH e AS (SELECT *, ABS(dte - 30) * 1000 + dte AS off FROM {option_chain} WHERE dte BETWEEN 7 AND 60), n AS (SELECT * FROM e QUALIFY off = MIN(off) OVER (PARTITION BY ticker, trade_date)),
    k AS (SELECT * FROM n WHERE iv > 0.01 AND iv < 3 QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, trade_date, opt_right ORDER BY ABS(strike - underlying_price), strike) <= 2) SELECT ticker, trade_date, MAX(dte) AS dte, ROUND(MEDIAN(iv), 6) AS atm_iv, COUNT(*) AS quotes FROM k GROUP BY ticker, trade_date""",
)
def _(get):
    """The expiry nearest 30 days, its two strikes nearest the spot for each right, their median."""
    c = get("option_chain").where("dte between 7 and 60")
    best = F.min(F.struct(F.abs(F.col("dte") - 30).alias("off"), "dte")).over(Window.partitionBy("ticker", "trade_date"))
    near = c.withColumn("best", best).where("dte = best.dte and iv > 0.01 and iv < 3").drop("best")
    top = J.latest_n(near, ["ticker", "trade_date", "opt_right"], [F.abs(F.col("strike") - F.col("underlying_price")), F.col("strike")], 2)
    return top.groupBy("ticker", "trade_date").agg(F.max("dte").alias("dte"), F.median("iv").alias("atm_iv"), F.count("*").alias("quotes"))


@query("a15_attribution_pairs", f"SELECT strategy, direction, COUNT(*) AS n, {r(win_rate='AVG(CAST(pnl > 0 AS INT))', net='SUM(pnl)')} FROM {_METRICS} WHERE status = 'CLOSED' GROUP BY strategy, direction")
def _(get):
    t = A.trade_metrics(get("trades")).where("status = 'CLOSED'")
    return t.groupBy("strategy", "direction").agg(F.count("*").alias("n"), F.avg((F.col("pnl") > 0).cast("int")).alias("win_rate"), F.sum("pnl").alias("net"))
