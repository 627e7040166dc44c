"""Markup, feeds and recursive series on hand-made input."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import recursive as R
from marketloom.sources import markup as M

day = datetime.date


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def test_cells_of_untidy_markup(spark):
    html = """<!-- <table><tr><td>no</td></tr></table> --><script>if (a < b) "<td>no</td>"</script>
    <TABLE class='x y' id=t1><tr><th class="date">Head<td>one<td> two <b>bold</b> &amp; &lt;i&gt; &#233;&#x41; <a href="/u?a=1&amp;b=2" title="a > b">first</a><a href="/v">second</a>
    <tr><td>3 < 4</td></tr></TABLE><table><tr><td></td></tr></table>"""
    got = [(r.tab, r.tab_id, r.row, r.n, r.header, r.text, r.classes, r.href, r.label) for r in M.cells(pages(spark, html, None, "")).orderBy("row", "n").collect()]
    assert got == [
        (1, "t1", 1, 1, True, "Head", "date", None, ""), (1, "t1", 1, 2, False, "one", "", None, ""),
        (1, "t1", 1, 3, False, "twobold& <i> éAfirstsecond", "", "/u?a=1&b=2", "first"), (1, "t1", 2, 1, False, "3 < 4", "", None, ""), (2, None, 3, 1, False, "", "", None, ""),
    ]


def test_pages_with_one_id_and_long_pages_stay_apart(spark):
    row = "<tr><td>{0}</td><td>x</td></tr>"
    long = "<table>" + "".join(row.format(k) for k in range(20_000)) + "</table>"
    df = spark.createDataFrame([(1, long), (1, "<table>" + row.format("a") + "</table>"), (None, long)], "page_id long, html string")
    got = M.rows(M.cells(df)).groupBy("doc").agg(F.count("*").alias("n"), F.max("row").alias("last")).collect()
    assert sorted((r.n, r["last"]) for r in got) == [(1, 1), (20_000, 20_000), (20_000, 20_000)]


def test_news_dates_carry_forward(spark):
    html = """<table id="news-table"><tr><td>May-01-24 08:30AM</td><td><a href="/1">One</a></td></tr><tr><td>07:15PM</td><td><a href="/2">Two</a></td></tr>
    <tr><td>only</td></tr><tr><td></td><td><a href="/3">Three</a></td></tr><tr><td>Apr-30-24 11:00PM</td><td>no link</td></tr><tr><td>01:00AM</td><td><a href="/4"> Four </a></td></tr></table>"""
    got = [(r.headline, r.url, r.published_at) for r in M.news(pages(spark, html)).orderBy("row").collect()]
    at = datetime.datetime
    assert got == [("One", "/1", at(2024, 5, 1, 8, 30)), ("Two", "/2", at(2024, 5, 1, 19, 15)), ("Three", "/3", None), ("Four", "/4", at(2024, 4, 30, 1, 0))]


def test_calendar_layouts(spark):
    html = """<table><tr><td>other</td></tr></table><table class="economic-calendar"><tr><td>8:30 AM</td><td>before any date</td><td>x</td></tr>
    <tr><th class="date">Friday, Aug. 21</th></tr><tr><td>Time</td><td>Event</td><td>Period</td></tr>
    <tr><td>9:45 AM</td><td>US Flash Manufacturing PMI</td><td>Aug.</td><td>-</td><td>54</td><td>53.8</td></tr>
    <tr><td>8:30 AM ET</td><td>Consumer Price Index CPI</td><td>Aug.</td><td>0.3%</td><td>0.2%</td></tr>
    <tr><td>day</td></tr><tr><th class="date">Monday, January 4, 2027</th></tr><tr><td></td><td>Retail sales</td><td>1</td><td>2</td></tr><tr><td>Holiday</td><td>x</td><td>none</td></tr></table>"""
    got = [(r.event_date, r.event_at, r.time_text, r.name, r.period, r.actual, r.consensus, r.prior, r.importance) for r in M.calendar(pages(spark, html), "2026-08-01").orderBy("row").collect()]
    at = datetime.datetime
    assert got == [
        (day(2026, 8, 21), at(2026, 8, 21, 0, 0), "", "Time", "", "", "Period", "", "Low"),
        (day(2026, 8, 21), at(2026, 8, 21, 13, 45), "9:45 AM", "US Flash Manufacturing PMI", "Aug.", "-", "54", "53.8", "Medium"),
        (day(2026, 8, 21), at(2026, 8, 21, 12, 30), "8:30 AM ET", "Consumer Price Index CPI", "Aug.", "", "0.3%", "0.2%", "High"),
        (day(2027, 1, 4), at(2027, 1, 4, 0, 0), "", "Retail sales", "", "", "1", "2", "Medium"),
        (day(2027, 1, 4), at(2027, 1, 4, 0, 0), "", "Holiday", "", "", "none", "", "Low"),
    ]


def test_label_values_and_links(spark):
    html = '<a href=/x>X</a><table class="snapshot-table2"><tr><td>P/E</td><td><b>31.2</b></td><td>Beta</td><td>-</td></tr></table>'
    assert [tuple(r) for r in M.label_values(pages(spark, html)).collect()] == [(0, "P/E", "31.2")]
    assert [tuple(r) for r in M.links(pages(spark, html)).collect()] == [(0, 1, "/x", "X")]


def test_feeds(spark):
    rss = "<rss><channel><item><title> A &amp; B </title><link>u1</link><description>&lt;p&gt;x  y&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate><category>biz</category></item><item><title></title></item><item><title>C</title><link>u1</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>D</title><link href="u2"/><summary>s</summary><published>2020-01-01T00:00:00Z</published><updated>2024-01-02T03:04:05Z</updated></entry></feed>'
    df = spark.createDataFrame([(1, rss), (2, atom), (3, "<rss><channel><item>"), (4, None)], "feed_id long, xml string")
    got = M.feeds(df)
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert sorted((r.feed_id, r.n, r.headline, r.snippet, r.url, r.published_at, r.category) for r in got.where("feed_id < 3 AND n <> 2").collect()) == [(1, 0, "A & B", "x y", "u1", at, "biz"), (2, 0, "D", "s", "u2", at, "")]
    assert {r.feed_id for r in got.collect()} <= {1, 2} and sorted(r.headline for r in M.unique_articles(got).collect()) == ["A & B", "D"]


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, n in ((1, 700), (2, 3), (3, 64), (4, 65), (5, 1)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        rows += [(k, s, float(c * 1.01), float(c * 0.99), float(c)) for s, c in enumerate(close, 1)]
    return spark.createDataFrame(rows, "ticker long, session_no int, high double, low double, close double").repartition(7)


def test_split_history_equals_the_plain_recursion(spark, bars):
    got = R.ema(bars, (9, 50), block=16).toPandas().merge(R.wilder_rsi(bars).select("ticker", "session_no", "rsi").toPandas()).sort_values(["ticker", "session_no"])
    for _, g in got.groupby("ticker"):
        assert np.allclose(g["ema_9"], g["close"].ewm(span=9, adjust=False).mean()) and np.allclose(g["ema_50"], g["close"].ewm(span=50, adjust=False).mean())
        d = g["close"].diff().to_numpy()
        want = np.full(len(g), np.nan)
        if len(g) > 14:
            up, down = np.maximum(d[1:], 0), np.maximum(-d[1:], 0)
            a, b = up[:14].mean(), down[:14].mean()
            for k in range(14, len(g)):
                if k > 14:
                    a, b = (a * 13 + up[k - 1]) / 14, (b * 13 + down[k - 1]) / 14
                want[k] = 100 - 100 / (1 + a / b)
        assert np.allclose(g["rsi"].astype(float), want, equal_nan=True)


def test_one_ticker_lies_in_many_tasks(spark, bars):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        parts = R.ema(bars.where("ticker = 1"), (9,)).select(F.spark_partition_id().alias("part")).distinct().count()
    finally:
        spark.conf.unset(key)
    assert parts > 1


def test_carried_and_sql(spark, bars):
    whole = R.ema(bars, (9, 20)).select("ticker", "session_no", "ema_9", "ema_20").toPandas()
    old = R.ema(bars.where("session_no <= 60"), (9, 20)).groupBy("ticker").agg(*[F.max_by(c, "session_no").alias(c) for c in ("ema_9", "ema_20")]).where("ticker <> 4")
    new = R.carried(old, bars.where("session_no > 60 AND ticker <> 4")).select("ticker", "session_no", "ema_9", "ema_20").toPandas()
    both = whole.merge(new, on=["ticker", "session_no"])
    assert len(both) == 640 + 4 and np.allclose(both["ema_9_x"], both["ema_9_y"]) and np.allclose(both["ema_20_x"], both["ema_20_y"])
    R.register(spark)
    s = pd.Series([1.0, 2.0, None, 4.0])
    r = spark.sql("SELECT ema_last(array(1D, 2D, NULL, 4D), 3) AS e, wilder_last(array(1D, 2D, 3D, 7D), 3) AS w, wilder_last(array(1D), 3) AS n").first()
    assert r.e == pytest.approx(s.dropna().ewm(span=3, adjust=False).mean().iloc[-1]) and r.w == pytest.approx((2 * 2 + 7) / 3) and r.n is None
