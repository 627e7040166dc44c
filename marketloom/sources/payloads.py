"""Vendor payloads (JSON texts, one for each response) to typed rows.

Every reader takes a DataFrame with a ``payload`` column, and keeps the columns named by ``keys``.  Numbers are read as text and cast
without failing, so ``"1.5"``, ``1.5`` and ``"n/a"`` all have a defined value (null for the last).  Payloads that are no
JSON give no rows; ``bad_records`` tells them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def _double(c: str | Column) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _long(c: str | Column) -> Column:
    return F.floor(_double(c)).cast("long")


def _or(*values: Column) -> Column:
    """The first value that is there and not 0, else the last."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values[:-1]], values[-1])


def _text(*values: str) -> Column:
    """The first text that is not empty, else an empty one."""
    return F.coalesce(*[F.nullif(F.col(v), F.lit("")) for v in values], F.lit(""))


def _struct(fields: str) -> str:
    return "STRUCT<" + ", ".join(f"{f} STRING" for f in fields.split()) + ">"


def _parsed(df: DataFrame, keys: list[str], schema: str) -> DataFrame:
    return df.select(*keys, F.from_json("payload", schema).alias("p"))


def _once(df: DataFrame, keys: list[str], parsed: Column) -> DataFrame:
    """``keys`` and ``parsed`` as ``p`` where it is there.  It is made a row of its own by ``explode``, which no filter passes: a condition on what
    a reader takes from ``p`` would go below it with a further parse of the payload for each field that it names."""
    return df.select(*keys, F.explode(F.array(parsed)).alias("p")).where("p IS NOT NULL")


def bad_records(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose payload is no JSON object or array."""
    return df.where(F.try_parse_json("payload").isNull()).select(*keys)


def epoch(c: Column) -> Column:
    """Unix time in seconds, or in thousandths or millionths of them, told by its size."""
    x = _double(c)
    for _ in range(3):
        x = F.when(x > 1e10, x / 1000).otherwise(x)
    return F.timestamp_seconds(x)


def bars(df: DataFrame, keys: list[str]) -> DataFrame:
    """Intraday or daily bars of a page of results; bars without a time or one of the four prices go."""
    p = _parsed(df, keys, f"bars ARRAY<{_struct('t o h l c v n vw')}>")
    b = p.select(*keys, F.explode("p.bars").alias("b"))
    out = b.select(*keys, F.try_to_timestamp("b.t").alias("ts"), *[_double(f"b.{k}").alias(n) for k, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"), ("n", "trade_count"), ("vw", "vwap"))])
    return out.dropna(subset=["ts", "open", "high", "low", "close"])


def quote(df: DataFrame, keys: list[str]) -> DataFrame:
    """A snapshot quote: the last price is that of the trade, else the minute's close, else the day's."""
    p = _once(df, keys, F.from_json("payload", f"latestTrade {_struct('p t')}, latestQuote {_struct('bp ap t')}, minuteBar {_struct('c t')}, dailyBar {_struct('o h l c v')}, prevDailyBar {_struct('c')}"))
    last, before = F.coalesce(_double("p.latestTrade.p"), _double("p.minuteBar.c"), _double("p.dailyBar.c")), _double("p.prevDailyBar.c")
    return p.select(
        *keys, F.try_to_timestamp(F.coalesce("p.latestTrade.t", "p.latestQuote.t", "p.minuteBar.t")).alias("ts"), last.alias("last"), _double("p.latestQuote.bp").alias("bid"), _double("p.latestQuote.ap").alias("ask"),
        *[_double(f"p.dailyBar.{k}").alias(n) for k, n in (("o", "day_open"), ("h", "day_high"), ("l", "day_low"), ("c", "day_close"))], before.alias("prev_close"), _long("p.dailyBar.v").alias("day_volume"),
        F.when(before != 0, (last / before - 1) * 100).alias("change_pct"),
    ).where("last IS NOT NULL OR bid IS NOT NULL OR ask IS NOT NULL OR prev_close IS NOT NULL")


#: Names of a key-value snapshot and ours.
PRICE_KEYS = {
    "regularMarketChangePercent": "change_pct", "marketCap": "market_cap", "trailingPE": "pe_ratio", "fiftyTwoWeekHigh": "week_52_high", "fiftyTwoWeekLow": "week_52_low",
    "recommendationMean": "analyst_mean_score", "targetMeanPrice": "target_price", "shortRatio": "short_ratio", "shortPercentOfFloat": "short_pct_float", "beta": "beta",
}


def prices(df: DataFrame, keys: list[str]) -> DataFrame:
    """Price and fundamentals of a key-value snapshot, with today's volume against its mean (of 30 days, else another)."""
    at = lambda k: _double(F.col("m")[k])
    m = _once(df, keys, F.from_json("payload", "map<string,string>")).withColumnRenamed("p", "m")
    volume, mean = at("regularMarketVolume"), _or(at("averageDailyVolume30Day"), at("averageVolume"))
    return m.select(*keys, _or(at("regularMarketPrice"), at("currentPrice")).alias("price"), volume.alias("volume"), mean.alias("avg_volume_30d"), F.when((volume != 0) & (mean > 0), F.round(volume / mean, 3)).alias("volume_ratio"), F.col("m")["recommendationKey"].alias("analyst_rating"), *[at(k).alias(n) for k, n in PRICE_KEYS.items()])


def news(df: DataFrame, keys: list[str]) -> DataFrame:
    """Articles of either layout: under ``content`` with an address of its own and a written time, or flat with a Unix time."""
    flat = "title STRING, link STRING, providerPublishTime STRING, summary STRING"
    kind = f"ARRAY<STRUCT<content STRUCT<title STRING, canonicalUrl {_struct('url')}, pubDate STRING, displayTime STRING, summary STRING>, {flat}>>"
    i = _parsed(df, keys, kind).select(*keys, F.posexplode("p").alias("n", "i"))
    written, stamp = _text("i.content.pubDate", "i.content.displayTime"), F.col("i.providerPublishTime")
    at = F.when(written != "", F.coalesce(*[F.try_to_timestamp(written, F.lit(x)) for x in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd")])).when(stamp.rlike("^[0-9]+$"), F.timestamp_seconds(stamp.try_cast("double")))
    return i.select(*keys, "n", _text("i.content.title", "i.title").alias("headline"), _text("i.content.summary", "i.summary").alias("snippet"), _text("i.content.canonicalUrl.url", "i.link").alias("url"), at.alias("published_at")).where("headline <> ''")


def relevant_news(df: DataFrame, keys: list[str], ticker: str = "ticker", least: float = 0.1) -> DataFrame:
    """Articles whose relevance for the row's ticker (the first entry that names it; none: 0) is ``least`` at least."""
    kind = f"feed ARRAY<STRUCT<title STRING, summary STRING, url STRING, time_published STRING, ticker_sentiment ARRAY<{_struct('ticker relevance_score')}>>>"
    i = _parsed(df, keys, kind).select(*keys, F.posexplode("p.feed").alias("n", "i"))
    named = F.filter("i.ticker_sentiment", lambda s: s["ticker"] == F.col(ticker).cast("string"))
    relevance = F.coalesce(F.get(named, F.lit(0))["relevance_score"].try_cast("double"), F.lit(0.0))
    return i.where(relevance >= least).select(*keys, "n", _text("i.title").alias("headline"), _text("i.summary").alias("snippet"), _text("i.url").alias("url"), F.try_to_timestamp("i.time_published", F.lit("yyyyMMdd'T'HHmmss")).alias("published_at"), relevance.alias("relevance"))


def teaser_news(df: DataFrame, keys: list[str], most: int = 500) -> DataFrame:
    """Articles of a plain array, or of one under ``data``: the teaser, or the body where there is none, cut."""
    kind = _struct("title teaser body url created updated date")
    plain = F.from_json("payload", f"ARRAY<{kind}>")
    items = F.when(F.ltrim("payload").startswith("["), plain).otherwise(F.from_json("payload", f"data ARRAY<{kind}>")["data"])
    i = df.select(*keys, F.posexplode(items).alias("n", "i"))
    return i.select(*keys, "n", F.coalesce("i.title", F.lit("")).alias("headline"), F.substring(_text("i.teaser", "i.body"), 1, most).alias("snippet"), F.coalesce("i.url", F.lit("")).alias("url"), S.parse_time(_text("i.created", "i.updated", "i.date")).alias("published_at"))


def economics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Calendar events: New York times as UTC (the day's start where the time is none), importance 3 and over High, 2 Medium, else
    Low."""
    i = _parsed(df, keys, f"economics ARRAY<{_struct('date time event_name event_period consensus prior actual event_category importance')}>").select(*keys, F.posexplode("p.economics").alias("n", "i"))
    clock = F.coalesce("i.time", F.lit("00:00:00"))
    local = F.try_to_timestamp(F.concat_ws(" ", "i.date", clock), F.lit("yyyy-MM-dd HH:mm:ss"))
    at = F.coalesce(F.to_utc_timestamp(local, "America/New_York"), F.try_to_timestamp("i.date", F.lit("yyyy-MM-dd")))
    level = _or(_double("i.importance"), F.lit(1.0))
    return i.select(*keys, "n", at.alias("event_at"), clock.alias("time_text"), _text("i.event_name").alias("name"), _text("i.event_period").alias("period"), *[_text(f"i.{c}").alias(c) for c in ("consensus", "prior", "actual")], F.coalesce(F.nullif("i.event_category", F.lit("")), F.lit("Economic")).alias("category"), F.when(level >= 3, "High").when(level == 2, "Medium").otherwise("Low").alias("importance"))


def earnings(df: DataFrame, keys: list[str]) -> DataFrame:
    """Reports of three layouts, told by their keys: ``quarterlyEarnings`` (the eight newest), ``earnings`` (a calendar), and ``history``
    with an expected ``calendar`` date.  A history row without a period is named after its day."""
    p = _parsed(df, keys, f"quarterlyEarnings ARRAY<{_struct('fiscalDateEnding reportedDate reportedEPS estimatedEPS surprisePercentage')}>, earnings ARRAY<{_struct('date period eps_est eps eps_surprise_percent')}>, history ARRAY<{_struct('date period epsEstimate epsActual epsDifference')}>, calendar {_struct('date average')}")
    day = lambda c: F.try_to_date(F.substring(c, 1, 10))
    columns = lambda period, date, estimate, actual, surprise, upcoming: [*keys, period.alias("period"), date.alias("report_date"), estimate.alias("eps_estimate"), actual.alias("eps_actual"), surprise.alias("surprise_pct"), F.lit(upcoming).alias("is_upcoming")]
    q = p.select(*keys, F.explode(F.slice("p.quarterlyEarnings", 1, 8)).alias("i")).select(*columns(F.coalesce("i.fiscalDateEnding", F.lit("")), day("i.reportedDate"), _double("i.estimatedEPS"), _double("i.reportedEPS"), _double("i.surprisePercentage"), False))
    c = p.select(*keys, F.explode("p.earnings").alias("i")).select(*columns(F.coalesce("i.period", F.lit("")), day("i.date"), _double("i.eps_est"), _double("i.eps"), _double("i.eps_surprise_percent"), False))
    h = p.select(*keys, F.explode("p.history").alias("i"))
    estimate, difference = _double("i.epsEstimate"), _double("i.epsDifference")
    actual = F.coalesce(_double("i.epsActual"), F.when(estimate != 0, estimate + difference))
    period = F.coalesce(F.nullif(F.trim("i.period"), F.lit("")), F.concat(F.lit("Q-"), day("i.date").cast("string")))
    h = h.select(*columns(period, day("i.date"), estimate, _double("i.epsActual"), S.surprise_pct(actual, estimate), False)).where("period IS NOT NULL")
    due = day("p.calendar.date")
    n = p.where(due.isNotNull()).select(*columns(F.concat(F.lit("UPCOMING-"), due.cast("string")), due, _double("p.calendar.average"), F.lit(None).cast("double"), F.lit(None).cast("double"), True))
    return q.unionByName(c).unionByName(h).unionByName(n)


def ratings(df: DataFrame, keys: list[str]) -> DataFrame:
    """Analyst actions; their time is the Unix one, else the written date and time."""
    fields = "id ticker updated date time analyst action_company action_pt rating_prior rating_current pt_prior pt_current importance"
    i = _parsed(df, keys, f"ratings ARRAY<{_struct(fields)}>").select(*keys, F.explode("p.ratings").alias("i"))
    written = F.coalesce(S.parse_time(F.trim(F.concat_ws(" ", "i.date", "i.time"))), S.parse_time(F.col("i.date")))
    return i.select(*keys, F.coalesce("i.id", F.lit("")).alias("external_id"), F.upper("i.ticker").alias("symbol"), F.coalesce(epoch(F.col("i.updated")), written).alias("published_at"), _text("i.analyst").alias("firm"), *[_text(f"i.{c}").alias(c) for c in ("action_company", "action_pt", "rating_prior", "rating_current")], _double("i.pt_prior").alias("pt_prior"), _double("i.pt_current").alias("pt_current"), _long("i.importance").alias("importance"))


def strikes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Historical strike rows to two quotes each.  A put's delta is the call's less 1; a missing mid volatility is the smoothed one."""
    fields = "tradeDate expirDate strike spotPrice stockPrice delta gamma theta vega smvVol " + " ".join(f"{r}{c}" for r in ("call", "put") for c in ("BidPrice", "AskPrice", "Value", "Volume", "OpenInterest", "MidIv"))
    i = _parsed(df, keys, f"ARRAY<{_struct(fields)}>").select(*keys, F.explode("p").alias("i"))
    delta = _double("i.delta")

    def side(right: str, name: str, d: Column) -> Column:
        return F.struct(F.lit(right).alias("opt_right"), *[_double(f"i.{name}{k}").alias(n) for k, n in (("BidPrice", "bid"), ("AskPrice", "ask"), ("Value", "model_value"))], *[_long(f"i.{name}{k}").alias(n) for k, n in (("Volume", "volume"), ("OpenInterest", "open_interest"))], _or(_double(f"i.{name}MidIv"), _double("i.smvVol")).alias("iv"), d.alias("delta"))

    common = [F.try_to_date("i.tradeDate").alias("trade_date"), F.try_to_date("i.expirDate").alias("expiration"), _double("i.strike").alias("strike"), _or(_double("i.spotPrice"), _double("i.stockPrice")).alias("underlying_price"), *[_double(f"i.{g}").alias(g) for g in ("gamma", "theta", "vega")]]
    both = F.explode(F.array(side("C", "call", delta), side("P", "put", delta - 1)))
    return i.select(*keys, *common, both.alias("q")).where("trade_date IS NOT NULL AND expiration IS NOT NULL AND strike IS NOT NULL").select(*keys, "trade_date", "expiration", "strike", "underlying_price", "gamma", "theta", "vega", "q.*")


#: Codes of a grade's action, and their names; other codes stay as they are.
GRADE_ACTIONS = {"up": "Upgrades", "down": "Downgrades", "init": "Initiates", "reit": "Reiterates", "main": "Maintains"}


def grades(df: DataFrame, as_of: str, lookback_days: int = 45, source: str = "yahoo") -> DataFrame:
    """Rating events from rows of ``ticker``, ``graded_at`` (text), ``firm``, ``action``, ``from_grade`` and ``to_grade``, each of which may be
    null: those with a readable time in the days before ``as_of``, under a key that hashes all they say."""
    at = F.try_to_timestamp(F.trim("graded_at"))
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in GRADE_ACTIONS.items() for x in kv])
    action = F.coalesce(names[F.lower(F.trim(plain("action")))], plain("action"))
    g = df.select("ticker", at.alias("published_at"), plain("firm").alias("firm"), action.alias("action_company"), plain("from_grade").alias("rating_prior"), plain("to_grade").alias("rating_current"))
    g = g.where(F.col("published_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {lookback_days} DAYS"))
    key = F.sha1(F.concat_ws("|", F.lit(source), "ticker", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), "firm", "action_company", "rating_prior", "rating_current"))
    return g.select(key.alias("external_id"), F.upper("ticker").alias("ticker"), "published_at", "firm", "action_company", "rating_prior", "rating_current", F.lit(source).alias("source"))


def rates(df: DataFrame) -> DataFrame:
    """``trade_date``, ``two_year`` and ``ten_year`` from text columns of these names; rows in which a yield is no finite number, or the date
    no date, go."""
    out = df.select(F.try_to_date(F.trim("trade_date"), "yyyy-MM-dd").alias("trade_date"), *[_double(F.trim(c)).alias(c) for c in ("two_year", "ten_year")])
    return out.dropna()


def rates_csv(spark: SparkSession, path: str) -> DataFrame:
    return rates(spark.read.csv(path, schema="trade_date string, two_year string, ten_year string", header=True))
