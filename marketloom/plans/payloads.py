"""Queries over vendor payloads: given tables written as JSON texts and read back, some of them broken."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import payloads as P
from .registry import query, r

_AT = "STRFTIME(CAST(published_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
_SHOW = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sent(df, keys, item, order, wrap=None, broken=None):
    """One payload for each key: its rows as an array in their order, in an object of one field where ``wrap`` names it.  Broken ones
    end in the middle."""
    array = F.transform(F.array_sort(F.collect_list(F.struct(*order, item.alias("__i")))), lambda x: x["__i"])
    text = F.to_json(F.struct(array.alias(wrap)) if wrap else array)
    g = df.groupBy(*keys).agg(text.alias("payload"))
    return g.withColumn("payload", F.when(broken, F.expr("substring(payload, 1, 25)")).otherwise(F.col("payload"))) if broken is not None else g


def bar_payloads(get):
    b = get("bars").withColumn("page", F.floor(F.col("session_no") / 100).cast("long"))
    close = F.when(F.col("session_no") % 37 == 0, "n/a").otherwise(F.col("close").cast("string"))
    item = F.struct(F.date_format("trade_date", "yyyy-MM-dd'T'00:00:00'Z'").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), close.alias("c"), F.col("volume").alias("v"))
    return sent(b, ["ticker", "page"], item, ["session_no"], "bars", (F.col("ticker") + F.col("page")) % 13 == 0)


_PAGE = "(session_no - session_no % 100) / 100"


@query("s03_bars", f"SELECT ticker, trade_date, {r(open='open', high='high', low='low', close='close')}, CAST(volume AS DOUBLE) AS volume FROM {{bars}} WHERE session_no % 37 <> 0 AND (ticker + {_PAGE}) % 13 <> 0")
def _(get):
    return P.bars(bar_payloads(get), ["ticker", "page"]).select("ticker", F.to_date("ts").alias("trade_date"), "open", "high", "low", "close", "volume")


@query("s03_bad_records", f"SELECT DISTINCT ticker, CAST({_PAGE} AS BIGINT) AS page FROM {{bars}} WHERE (ticker + {_PAGE}) % 13 = 0")
def _(get):
    return P.bad_records(bar_payloads(get), ["ticker", "page"])


@query(
    "s04_quotes",
    f"""WITH b AS (SELECT *, LAG(close) OVER (PARTITION BY ticker ORDER BY session_no) AS before FROM {{bars}}), q AS (SELECT *, CASE WHEN ticker % 3 <> 0 THEN close + 0.25 WHEN ticker % 6 <> 0 THEN close + 0.5 ELSE close END AS last FROM b)
    SELECT ticker, session_no, {r(last='last', bid='last - 0.01', ask='last + 0.01', prev_close='before', change_pct='(last / before - 1) * 100')}, volume AS day_volume FROM q""",
)
def _(get):
    """Every bar as a snapshot; a third have no trade, and half of these no minute bar."""
    from pyspark.sql import Window

    b = get("bars").withColumn("before", F.lag("close").over(Window.partitionBy("ticker").orderBy("session_no")))
    third, sixth = F.col("ticker") % 3 == 0, F.col("ticker") % 6 == 0
    last = F.when(~third, F.col("close") + 0.25).when(~sixth, F.col("close") + 0.5).otherwise(F.col("close"))
    payload = F.to_json(F.struct(
        F.when(~third, F.struct((F.col("close") + 0.25).alias("p"), F.lit("2024-01-02T15:04:05Z").alias("t"))).alias("latestTrade"), F.struct((last - 0.01).alias("bp"), (last + 0.01).alias("ap")).alias("latestQuote"),
        F.struct(F.when(third & ~sixth, F.col("close") + 0.5).alias("c")).alias("minuteBar"), F.struct(F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v")).alias("dailyBar"), F.struct(F.col("before").alias("c")).alias("prevDailyBar"),
    ))
    q = P.quote(b.select("ticker", "session_no", payload.alias("payload")), ["ticker", "session_no"])
    return q.select("ticker", "session_no", "last", "bid", "ask", "prev_close", "change_pct", "day_volume")


@query("s05_price_snapshots", f"SELECT ticker, {r(price='price', change_pct='change_pct', short_ratio='short_ratio', short_pct_float='short_pct_float', beta='beta', target_price='target_price', analyst_mean_score='analyst_mean_score')}, CAST(1000 + ticker AS DOUBLE) AS volume, CASE WHEN ticker % 4 = 0 THEN NULL ELSE ROUND((1000 + ticker) / CAST(800 + ticker AS DOUBLE), 3) END AS volume_ratio FROM {{snapshots}}")
def _(get):
    names = {"price": "regularMarketPrice", "change_pct": "regularMarketChangePercent", "short_ratio": "shortRatio", "short_pct_float": "shortPercentOfFloat", "beta": "beta", "target_price": "targetMeanPrice", "analyst_mean_score": "recommendationMean"}
    mean = F.when(F.col("ticker") % 4 != 0, F.col("ticker") + 800)
    half = F.col("ticker") % 2 == 0
    s = get("snapshots").select("ticker", F.to_json(F.struct(*[F.col(c).alias(n) for c, n in names.items()], (F.col("ticker") + 1000).alias("regularMarketVolume"), F.when(half, mean).alias("averageDailyVolume30Day"), F.when(~half, mean).alias("averageVolume"))).alias("payload"))
    return P.prices(s, ["ticker"]).select("ticker", *names, "volume", "volume_ratio")


@query("s06_news", f"SELECT ticker, headline, COALESCE(body_snippet, '') AS snippet, COALESCE(url, '') AS url, {_AT} AS published FROM {{articles}} WHERE headline <> '' AND id % 20 <> 3")
def _(get):
    a = get("articles").withColumn("at", F.col("published_at").cast("timestamp"))
    title = F.when(F.col("id") % 20 == 3, "").otherwise(F.col("headline"))
    nested, flat = F.col("id") % 2 == 0, F.col("id") % 2 == 1
    content = F.when(nested, F.struct(title.alias("title"), F.struct(F.col("url")).alias("canonicalUrl"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate"), F.col("body_snippet").alias("summary")))
    item = F.struct(content.alias("content"), F.when(flat, title).alias("title"), F.when(flat, F.col("url")).alias("link"), F.when(flat, F.unix_timestamp("at")).alias("providerPublishTime"), F.when(flat, F.col("body_snippet")).alias("summary"))
    return P.news(sent(a, ["ticker"], item, ["id"]), ["ticker"]).select("ticker", "headline", "snippet", "url", _SHOW("published_at").alias("published"))


@query("s07_relevant_news", f"SELECT ticker, headline, {_AT} AS published, ROUND(CASE WHEN id % 7 = 0 THEN 0 ELSE (id % 20) / CAST(100 AS DOUBLE) END, 6) AS relevance FROM {{articles}} WHERE id % 7 <> 0 AND id % 20 >= 10")
def _(get):
    a = get("articles").withColumn("at", F.col("published_at").cast("timestamp"))
    one = lambda t, x: F.struct(t.cast("string").alias("ticker"), x.cast("string").alias("relevance_score"))
    named = F.when(F.col("id") % 7 == 0, F.array(one(F.lit("other"), F.lit(0.9)))).otherwise(F.array(one(F.lit("other"), F.lit(0.9)), one(F.col("ticker"), F.col("id") % 20 / 100), one(F.col("ticker"), F.lit(0.99))))
    item = F.struct(F.col("headline").alias("title"), F.col("body_snippet").alias("summary"), "url", F.date_format("at", "yyyyMMdd'T'HHmmss").alias("time_published"), named.alias("ticker_sentiment"))
    return P.relevant_news(sent(a, ["ticker"], item, ["id"], "feed"), ["ticker"]).select("ticker", "headline", _SHOW("published_at").alias("published"), "relevance")


@query("s08_teaser_news", "SELECT source, headline, SUBSTR(CASE WHEN id % 3 = 0 OR COALESCE(headline, '') = '' THEN CONCAT(COALESCE(body_snippet, ''), REPEAT('x', 400)) ELSE headline END, 1, 500) AS snippet, STRFTIME(CAST(published_at AS TIMESTAMP), '%Y-%m-%d 00:00:00') AS published FROM {articles}")
def _(get):
    a = get("articles").withColumn("page", F.floor(F.col("id") / 50))
    item = F.struct(F.col("headline").alias("title"), F.when(F.col("id") % 3 != 0, F.col("headline")).alias("teaser"), F.concat(F.coalesce("body_snippet", F.lit("")), F.repeat(F.lit("x"), F.lit(400))).alias("body"), "url", F.date_format(F.col("published_at").cast("timestamp"), "yyyy-MM-dd").alias("created"))
    plain = sent(a.where("source <> 'wsj'"), ["source", "page"], item, ["id"])
    wrapped = sent(a.where("source = 'wsj'"), ["source", "page"], item, ["id"], "data")
    return P.teaser_news(plain.unionByName(wrapped), ["source", "page"]).select("source", "headline", "snippet", _SHOW("published_at").alias("published"))


@query("s12_economics", "SELECT event_date, name, CONCAT(LPAD(CAST(event_hour AS VARCHAR), 2, '0'), ':00:00') AS time_text, CASE WHEN id % 5 >= 3 THEN 'High' WHEN id % 5 = 2 THEN 'Medium' ELSE 'Low' END AS importance, CASE WHEN id % 3 = 0 THEN '' ELSE CAST(id % 50 AS VARCHAR) END AS actual, CASE WHEN id % 2 = 0 THEN 'Economic' ELSE 'Rates' END AS category FROM {macro_events}")
def _(get):
    e = get("macro_events").withColumn("page", F.floor(F.col("id") / 1000))
    item = F.struct(F.col("event_date").cast("string").alias("date"), F.format_string("%02d:00:00", "event_hour").alias("time"), F.col("name").alias("event_name"), (F.col("id") % 5).alias("importance"), F.when(F.col("id") % 3 != 0, F.col("id") % 50).alias("actual"), F.when(F.col("id") % 2 == 0, "").otherwise("Rates").alias("event_category"))
    out = P.economics(sent(e, ["page"], item, ["id"], "economics"), ["page"])
    return out.select(F.to_date(F.from_utc_timestamp("event_at", "America/New_York")).alias("event_date"), "name", "time_text", "importance", "actual", "category")


_KIND = "ticker % 3"
_SURPRISE = "CASE WHEN ABS(eps_estimate) >= 0.01 AND eps_actual IS NOT NULL THEN ROUND(LEAST(GREATEST((eps_actual - eps_estimate) / ABS(eps_estimate) * 100, -200), 200), 4) END"


@query(
    "s13_earnings",
    f"""WITH e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY seq) AS k FROM {{earnings_events}})
    SELECT ticker, CASE WHEN {_KIND} = 2 THEN CONCAT('Q-', CAST(report_date AS VARCHAR)) ELSE period END AS period, report_date, {r(eps_estimate='eps_estimate', eps_actual='eps_actual')}, CASE {_KIND} WHEN 0 THEN 1.5 WHEN 1 THEN -2.5 ELSE {_SURPRISE} END AS surprise_pct FROM e WHERE {_KIND} <> 0 OR k <= 8""",
    4,
)
def _(get):
    """A third of the tickers in each of three layouts."""
    e = get("earnings_events")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    day = F.col("report_date").cast("string")
    q = F.struct(F.col("period").alias("fiscalDateEnding"), day.alias("reportedDate"), text("eps_actual").alias("reportedEPS"), text("eps_estimate").alias("estimatedEPS"), F.lit("1.5").alias("surprisePercentage"))
    c = F.struct(day.alias("date"), "period", F.col("eps_estimate").alias("eps_est"), F.col("eps_actual").alias("eps"), F.lit(-2.5).alias("eps_surprise_percent"))
    h = F.struct(day.alias("date"), F.lit(" ").alias("period"), F.col("eps_estimate").alias("epsEstimate"), F.col("eps_actual").alias("epsActual"))
    parts = [sent(e.where(F.col("ticker") % 3 == k), ["ticker"], item, ["seq"], wrap) for k, item, wrap in ((0, q, "quarterlyEarnings"), (1, c, "earnings"), (2, h, "history"))]
    out = P.earnings(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["ticker"])
    return out.select("ticker", "period", "report_date", "eps_estimate", "eps_actual", "surprise_pct")


@query("s14_ratings", "SELECT external_id, UPPER(CONCAT('t', ticker)) AS symbol, action_company, COALESCE(action_pt, '') AS action_pt, CASE WHEN external_id % 4 = 3 THEN STRFTIME(CAST(published_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') ELSE STRFTIME(CAST(published_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS published, CAST(external_id % 6 AS BIGINT) AS importance FROM {analyst_rating_events}")
def _(get):
    """Times in seconds, thousandths and millionths of them, or written."""
    e = get("analyst_rating_events").withColumn("at", F.col("published_at").cast("timestamp"))
    k, t = F.col("external_id") % 4, F.unix_timestamp("at")
    stamp = F.when(k == 0, t).when(k == 1, t * 1000).when(k == 2, t * 1000000)
    item = F.struct(F.col("external_id").alias("id"), F.concat(F.lit("t"), F.col("ticker").cast("string")).alias("ticker"), stamp.alias("updated"), F.date_format("at", "yyyy-MM-dd").alias("date"), F.date_format("at", "HH:mm:ss").alias("time"), "action_company", "action_pt", (F.col("external_id") % 6).alias("importance"))
    out = P.ratings(sent(e, ["ticker"], item, ["external_id"], "ratings"), ["ticker"])
    return out.select(F.col("external_id").cast("long").alias("external_id"), "symbol", "action_company", "action_pt", _SHOW("published_at").alias("published"), "importance")


@query("s18_strike_rows", f"SELECT ticker, trade_date, expiration, strike, opt_right, {r(bid='bid', ask='ask', iv='iv', delta='CASE opt_right WHEN $$C$$ THEN 0.5 ELSE -0.5 END')}, open_interest FROM {{contract_quotes}}".replace("$$", "'"), 4)
def _(get):
    """Call and put of a strike in one row, written and read back as two quotes."""
    c = get("contract_quotes")
    side = lambda x, col: F.max(F.when(F.col("opt_right") == x, F.col(col)))
    wide = c.groupBy("ticker", "trade_date", "expiration", "strike").agg(*[side(x, col).alias(f"{n}{k}") for x, n in (("C", "call"), ("P", "put")) for col, k in (("bid", "BidPrice"), ("ask", "AskPrice"), ("open_interest", "OpenInterest"))], F.max("iv").alias("smvVol"))
    item = F.struct(F.col("trade_date").cast("string").alias("tradeDate"), F.col("expiration").cast("string").alias("expirDate"), "strike", F.lit(0.5).alias("delta"), *[c for c in wide.columns if c.startswith(("call", "put", "smv"))])
    return P.strikes(sent(wide, ["ticker"], item, ["trade_date", "expiration", "strike"]), ["ticker"]).select("ticker", "trade_date", "expiration", "strike", "opt_right", "bid", "ask", "iv", "delta", "open_interest")


#: Grades are read as of this time.
GRADED = "2024-02-20 00:00:00"
_CODES = "CASE action_company WHEN 'Upgrades' THEN 'up' WHEN 'Downgrades' THEN ' Down' WHEN 'Initiates' THEN 'INIT' WHEN 'Maintains' THEN 'main' ELSE 'held' END"


@query(
    "s15_grades",
    f"""WITH g AS (SELECT UPPER(CONCAT('t', ticker)) AS ticker, CONCAT('t', ticker) AS symbol, STRFTIME(CAST(published_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS published, CONCAT('firm ', external_id % 40) AS firm, CASE WHEN action_company = 'Reiterates' THEN 'held' ELSE action_company END AS action_company, CASE WHEN external_id % 3 = 0 THEN '' ELSE 'Hold' END AS rating_prior, rating_current FROM {{analyst_rating_events}}
      WHERE external_id % 13 <> 0 AND CAST(published_at AS TIMESTAMP) >= TIMESTAMP '2024-01-06 00:00:00')
    SELECT SHA1(CONCAT_WS('|', 'yahoo', symbol, published, firm, action_company, rating_prior, rating_current)) AS external_id, ticker, published, firm, action_company, rating_prior, rating_current FROM g""",
)
def _(get):
    """Grades with codes in any case, unknown codes, missing grades and unreadable times."""
    e = get("analyst_rating_events")
    k = F.col("external_id")
    sent = e.select(F.concat(F.lit("t"), F.col("ticker").cast("string")).alias("ticker"), F.when(k % 13 == 0, "n/a").otherwise(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).alias("graded_at"), F.concat(F.lit("firm "), (k % 40).cast("string")).alias("firm"), F.expr(_CODES).alias("action"), F.when(k % 3 != 0, "Hold").alias("from_grade"), F.col("rating_current").alias("to_grade"))
    return P.grades(sent, GRADED).select("external_id", "ticker", _SHOW("published_at").alias("published"), "firm", "action_company", "rating_prior", "rating_current")


@query("s19_rates_text", f"SELECT trade_date, {r(two_year='two_year', ten_year='ten_year')} FROM {{rates}} WHERE two_year IS NOT NULL AND CAST(EXTRACT(day FROM trade_date) AS INT) <> 13")
def _(get):
    """Yields as text, with points for missing ones."""
    text = get("rates").select(F.col("trade_date").cast("string").alias("trade_date"), F.coalesce(F.col("two_year").cast("string"), F.lit(".")).alias("two_year"), F.when(F.dayofmonth("trade_date") == 13, "n/a").otherwise(F.concat(F.lit(" "), F.col("ten_year").cast("string"))).alias("ten_year"))
    return P.rates(text)
