"""What a plan reads, moves and holds, where tables are larger than these tests can make them."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import options as O
from marketloom.functions.scoring import WordScorer, score_texts
from marketloom.operators import aggregates as A
from marketloom.operators import basket as K
from marketloom.operators import contracts as B
from marketloom.operators import joins as J
from marketloom.operators import signals as S
from marketloom.operators import structures as X
from marketloom.operators import technical as T
from marketloom.operators import windows as W
from marketloom.plans import registry
from marketloom.plans.contracts import opportunities
from marketloom.sources import fixtures
from marketloom.sources import markup as M

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@tables
@pytest.mark.parametrize(("name", "times"), [("t04_entry_legs", 1), ("o15_debit_spreads", 2), ("o16_enriched", 2)])
def test_chains_are_made_once_for_each_look_at_them(spark, name, times):
    text = plan(registry.queries()[name](spark, DATA))
    assert "MapInArrow" not in text
    assert text.count("BroadcastNestedLoopJoin BuildRight, Cross\n") == times  # the last join of a chain, by right


def test_delta_alone_is_that_of_all_greeks(spark):
    rows = [(100.0, k, d, v, r) for k in (60.0, 95.0, 100.0, 140.0) for d in (-3, 0, 1, 35) for v in (None, 0.0, 0.2, 1.5) for r in "CP"]
    chain = spark.createDataFrame(rows, "underlying_price double, strike double, dte int, iv double, opt_right string")
    both = O.with_delta(O.with_greeks(chain).withColumnRenamed("delta", "known"))
    assert both.where("(known IS NULL) <> (delta IS NULL) OR abs(known - delta) > 1e-12").isEmpty()
    assert both.where("delta IS NOT NULL").count() == 32


def test_an_expiry_without_liquid_quotes_is_chosen_all_the_same(spark):
    """The expiry is the nearest of all that are quoted; where none of its contracts is liquid, or only those of the other right, the
    next expiry does not step in."""
    q = [(1, 35, "C", k, 0.0, 1.0, 100, 0.45) for k in (100.0, 105.0)] + [(1, 40, r, k, 1.0, 1.1, 100, s * d) for r, s in (("C", 1), ("P", -1)) for k, d in ((100.0, 0.45), (105.0, 0.25))]
    q += [(2, 40, "P", k, 1.0, 1.1, 100, -d) for k, d in ((100.0, 0.45), (95.0, 0.25))]
    chain = spark.createDataFrame(q, "ticker long, dte int, opt_right string, strike double, bid double, ask double, open_interest long, delta double").withColumn("trade_date", F.lit("2020-03-02").cast("date")).withColumn("expiration", F.date_add("trade_date", F.col("dte")))
    seen = spark.createDataFrame([(1, 0.5), (2, 0.5), (2, -0.5)], "ticker long, score double").withColumn("obs_date", F.lit("2020-03-02").cast("date"))
    assert [(r.ticker, r.score) for r in B.entry_legs(seen, chain).collect()] == [(2, -0.5)]


def test_ends_of_trends_are_those_of_the_series(spark):
    """Tickers of any length, gaps, flat prices, and blocks that end inside a ticker."""
    rows = [(t, n, 10.0 + (n * (t + 3)) % 7, 8.0 - (n * t) % 3, None if t == 3 and n in (4, 5) else 9.0 + (n * n * t) % 4) for t, size in ((0, 1), (1, 40), (2, 300), (3, 12), (5, 2)) for n in range(size)]
    rows += [(4, n, 5.0, 5.0, 5.0) for n in range(30)] + [(6, n, 5.0 + (n > 9), 5.0, 5.0) for n in range(20)]
    bars = spark.createDataFrame(rows, "ticker long, session_no int, high double, low double, close double").repartition(3)
    series = T.trend_series(bars).toPandas().sort_values("session_no").groupby("ticker").tail(1).drop(columns="session_no")
    for block, most in ((1 << 16, 1 << 20), (16, 1 << 20), (1 << 16, 64)):
        ends = T.trend_ends(bars, block=block, most=most).toPandas()
        pd.testing.assert_frame_equal(ends.sort_values("ticker").reset_index(drop=True), series.sort_values("ticker").reset_index(drop=True), rtol=1e-12)


def test_ends_of_windows_are_those_of_the_windows(spark):
    rows = [(t, n, None if t == 2 and n == 25 else 0.0 if t == 1 and n == 24 else 5.0 + (n * t) % 9, float(n % 5 + t)) for t, size in ((1, 30), (2, 30), (3, 10), (4, 6)) for n in range(size)]
    bars = spark.createDataFrame(rows, "ticker long, session_no int, close double, volume double")
    known = bars.select("ticker", "session_no", "close", W.ret(5).alias("ret_5"), W.sma(10).alias("sma_10"), W.rvol(20).alias("rvol"), F.row_number().over(W.order()).alias("n"))
    known = known.toPandas().sort_values("session_no").groupby("ticker").tail(1).sort_values("ticker").reset_index(drop=True)
    ends = W.ends(bars, returns=(5,), averages=(10,), volumes=20).toPandas().sort_values("ticker").reset_index(drop=True)
    pd.testing.assert_frame_equal(ends[known.columns], known, check_dtype=False, rtol=1e-12)


@tables
@pytest.mark.parametrize("name", ["t07_ranked_opportunities", "m19_conviction", "m20_agreement", "m23_decision"])
def test_last_rows_take_no_window_over_frames_and_no_pass_for_each_ticker(spark, name):
    text = plan(registry.queries()[name](spark, DATA))
    assert "FlatMapGroupsInPandas" not in text and "-199" not in text


@tables
@pytest.mark.parametrize("name", ["s04_quotes", "s05_price_snapshots"])
def test_a_payload_is_parsed_once(spark, name):
    assert plan(registry.queries()[name](spark, DATA)).count("from_json(") == 1


def test_market_side_is_that_of_the_windows(spark):
    rows = [(t, n, 9.0 + (n * t) % 11, 7.0 - (n * t) % 5, None if t == 3 and n in (290, 296) else 8.0 + (n * n * t) % 7 / 2, 100.0 + n % 9) for t, size in ((1, 300), (2, 20), (3, 300), (4, 5), (5, 1)) for n in range(size)]
    bars = spark.createDataFrame(rows, "ticker long, session_no int, high double, low double, close double, volume double")
    b = bars.withColumn("ret", F.round(W.ret(1) * 100, 4)).withColumns({"volume_ratio": W.volume_ratio(30), "slope": W.slope(), "accel": W.acceleration(), "vol": W.annual_vol()})
    known = W.run_features(b, extremes=252).toPandas().sort_values("session_no").groupby("ticker").tail(1)
    known = known.rename(columns={"close": "price", "high_n": "week_52_high", "low_n": "week_52_low", "ret": "change_pct"}).sort_values("ticker").reset_index(drop=True)
    side = K.market_side(bars)
    pd.testing.assert_frame_equal(side.toPandas().sort_values("ticker").reset_index(drop=True), known[side.columns], check_dtype=False, rtol=1e-9, atol=1e-9)
    text = plan(K.market_side(bars))
    assert text.count("Sort [") == 1 and "rangebetween" not in text.lower() and "RowFrame, -" not in text


def test_a_scorer_gets_a_few_texts_and_what_is_not_kept_stays_behind(spark):
    df = spark.createDataFrame([(k, f"gain {k}" if k % 3 else "") for k in range(100)], "id long, text string").coalesce(1)
    out = score_texts(df, WordScorer(), keep=["id"], batch=7)
    assert out.columns == ["id", "score", "score_error"]
    assert {(r.id, r.score) for r in out.collect()} == {(k, 1.0 if k % 3 else 0.0) for k in range(100)}


def test_structures_are_repriced_where_they_stand(spark):
    """No leg becomes a row and nothing is shuffled; legs without a value do not count, rows without any have null."""
    one = lambda action, k, right, iv=0.3: (action, (k, right, iv))
    given = [[one("BUY", 100.0, "C"), one("SELL", 105.0, "C", None)], [one("BUY", 100.0, "C"), ("SELL", None)], [one("BUY", None, "C")], [None], [], None, [one("SELL", 95.0, "P"), one("BUY", 90.0, "P"), one("SELL", 105.0, "C"), one("BUY", 115.0, "C")]]
    kind = "legs array<struct<action: string, leg: struct<strike: double, right: string, iv: double>>>"
    df = spark.createDataFrame([(i, legs, dte) for i, legs in enumerate(given) for dte in (10, 35)], f"id int, {kind}, dte int").withColumns({"up": F.lit(108.0), "days": F.lit(20)})
    out = X.reprice(df, {"worth": "up"}, "days")
    assert "Exchange" not in plan(out) and "Generate" not in plan(out) and out.columns == [*df.columns, "worth"]
    flat = df.select("id", "dte", "up", F.explode("legs").alias("x")).where("x.leg.strike IS NOT NULL").select("*", "x.leg.*", F.coalesce("x.leg.iv", F.lit(0.3)).alias("v"), ((F.greatest(F.lit(0), F.col("dte") - 20)) / 365.0).alias("t"))
    known = {}
    for r in O.with_values(flat, "p", "up", "strike", "t", "v", "right").collect():
        known[r.id, r.dte] = known.get((r.id, r.dte), 0.0) + (r.p if r.x.action == "BUY" else -r.p)
    assert {(r.id, r.dte): r.worth for r in out.collect()} == {(i, d): pytest.approx(known[i, d]) if i in (0, 1, 6) else None for i in range(7) for d in (10, 35)}


def test_cells_are_cut_where_the_page_stands(spark):
    """Tokens are not moved, sorted or gathered again; a table that begins inside a row goes on with its numbers, an anchor ends with its cell."""
    html = '<td>0<table id="a"><td>1<tr><td><a href="/p">x<td>y<!-- <td> --><a href="/q">z</a>w<table class="c"><th>2<td>&lt;3<tr></tr>4'
    pages = spark.createDataFrame([(7, html), (7, None), (8, "")], "page_id int, html string")
    for df in (M.cells(pages), M.calendar(pages, "2020-06-01"), M.news(pages)):
        text = plan(df)
        assert "Aggregate" not in text and text.count("Exchange") == 1
    assert "Exchange" not in plan(M.links(pages))
    got = [(r.tab, r.tab_id, r.tab_class, r.row, r.n, r.header, r.text, r.href, r.label) for r in M.cells(pages).orderBy("row", "n").collect()]
    assert got == [
        (0, None, None, 0, 1, False, "0", None, ""), (1, "a", None, 0, 2, False, "1", None, ""), (1, "a", None, 1, 1, False, "x", "/p", "x"),
        (1, "a", None, 1, 2, False, "yzw", "/q", "z"), (2, None, "c", 1, 3, True, "2", None, ""), (2, None, "c", 1, 4, False, "<3", None, ""),
    ]


@tables
def test_setups_read_the_chain_no_more_than_they_must(spark):
    """For the keys, for what is asked and for the contracts: three readings of three joins; all opportunities at a date with a chain have a row."""
    text = plan(registry.queries()["o09_o10_setups"](spark, DATA))
    assert text.count("BroadcastNestedLoopJoin BuildRight, Cross\n") == 9
    get = lambda name: fixtures.table(spark, DATA, name)
    dates = get("option_chain").select("ticker", "trade_date").distinct()
    known = opportunities(get).join(dates, ["ticker", "trade_date"], "left_semi")
    some = opportunities(get, X.listed(get("option_chain")))
    assert some.drop("listed").exceptAll(known).isEmpty() and known.exceptAll(some.drop("listed")).isEmpty() and not known.isEmpty()


@tables
def test_articles_move_no_more_of_a_text_than_they_show(spark):
    """Keywords are looked for without the joins that give articles their labels and times; where these are made, whole texts stay behind."""
    text = plan(registry.queries()["j08_keyword_tickers"](spark, DATA))
    assert "labels.parquet" not in text and "events.parquet" not in text
    articles, shown = fixtures.table(spark, DATA, "articles"), fixtures.table(spark, DATA, "article_texts")
    moved = articles._jdf.queryExecution().optimizedPlan().toString().split("LeftOuter")[-1]
    assert "substr" in moved and "1, 380)" in moved
    known = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id AS id", "substr(text, 1, 80) AS headline", "substr(text, 81, 300) AS body_snippet")
    for df in (articles.select("id", "headline", "body_snippet").distinct(), shown):
        assert df.exceptAll(known).isEmpty() and known.exceptAll(df).isEmpty()


def test_a_join_beside_moves_the_small_side_alone(spark):
    big = spark.createDataFrame([(t, d, e, 10 * (t or 0) + k) for t in (1, 2, None) for d in (1, 2, None) for e in (5, None) for k in (0, 1)], "ticker long, day int, other int, x long").repartition("ticker")
    small = spark.createDataFrame([(1, 1, 5, [("a", 0.5)]), (1, 2, None, [("b", 0.5)]), (2, 2, 5, None), (2, 9, 5, [("c", 0.5)]), (3, 1, 5, []), (None, 1, 5, [])], "ticker long, day long, other int, legs array<struct<n: string, d: double>>")
    known = big.join(small, ["ticker", "day", "other"]).select("ticker", "day", "other", "x", "legs")
    got = J.join_beside(big, small, "ticker", ["day", "other"])
    assert got.columns == known.columns and sorted(got.collect(), key=str) == sorted(known.collect(), key=str) and got.count() == 4
    text = plan(J.join_beside(big, small, "ticker", ["day", "other"]))
    assert text.count("Exchange") == 2 and "SortMergeJoin" not in text
    assert J.join_beside(big, small.select("ticker", "day", "other"), "ticker", ["day", "other"]).columns == big.columns


@tables
def test_bars_are_moved_once_and_contracts_not_at_all(spark):
    """Only opportunities and the legs found meet by ticker, date and expiry; the day's bar is looked up where the bars lie."""
    assert plan(fixtures.table(spark, DATA, "bars")).count("Exchange") == 1
    moved = [x for x in plan(registry.queries()["o09_o10_setups"](spark, DATA)).splitlines() if "Exchange hashpartitioning(" in x]
    assert sum("expiration" in x for x in moved) == 2
    assert sum("trade_date" in x or "prediction_date" in x for x in moved if "expiration" not in x) <= 4


def test_values_in_lists_are_those_of_rows(spark):
    rows = [(i, 100.0, k, d, v, r, p) for i, d in ((1, 35), (2, 0)) for k in (95.0, 105.0) for r in "CP" for v, p in ((0.3, 5.0), (None, 6.5), (4.0, 12.0), (None, 0.0))]
    flat = spark.createDataFrame(rows, "id int, underlying_price double, strike double, dte int, iv double, opt_right string, mid double")
    usable = (F.col("iv") > 0.01) & (F.col("iv") <= 3.0)
    known = O.with_implied_vol(flat.withColumns({"t": F.col("dte") / 365.0, "asked": F.when(~F.coalesce(usable, F.lit(False)), F.col("mid"))}), "asked").withColumn("iv", F.when(usable, F.col("iv")).otherwise(F.col("found")))
    known = O.with_greeks(known).select("id", "strike", "opt_right", "mid", "iv", "delta", "theta", "vega")
    lists = flat.groupBy("id").agg(F.collect_list(F.struct(*flat.columns[1:])).alias("xs")).union(spark.createDataFrame([(3, [])], "id int, xs array<struct<underlying_price: double, strike: double, dte: int, iv: double, opt_right: string, mid: double>>"))
    got = O.with_list_greeks(lists, "xs", "mid", (0.01, 3.0), block=1)
    assert got.count() == 3
    got = got.select("id", F.explode("xs").alias("x")).select("id", "x.strike", "x.opt_right", "x.mid", "x.iv", "x.delta", "x.theta", "x.vega")
    assert sorted(got.collect(), key=str) == sorted(known.collect(), key=str) and known.where("iv IS NULL").count() > 0 and known.where("delta IS NOT NULL").count() > 8


def test_medians_of_groups_of_any_size(spark):
    """Ties, zeros, both signs, infinite values, NaN, few and no values: as Spark's own, whose groups stand whole in memory."""
    inf, nan = float("inf"), float("nan")
    groups = {
        "ties": [0.5] * 7 + [0.25] * 7, "even": [-3.0, 4.0, 1e-300, 2.0], "odd": [k * 0.37 - 5 for k in range(101)], "zeros": [0.0, -0.0, 0.0, 1.0], "signs": [-1e-9, 1e-9], "one": [7.0],
        "none": [None, None], "ends": [-inf, inf, 1.0, inf, nan], "last": [nan, inf], "near": [1.0 + k * 1e-12 for k in range(1000)], None: [1.0, None, 5.0],
    }
    df = spark.createDataFrame([(g, h, None if x is None else x * h) for g, xs in groups.items() for x in xs for h in (1, 2)], "label string, h int, r double").repartition(5)
    known = df.groupBy("label", "h").agg(F.median("r").alias("m")).where("m IS NOT NULL")
    got = A.medians(df, ["label", "h"], "r", "m")
    assert sorted(map(str, got.collect())) == sorted(map(str, known.collect())) and got.count() == 20  # text: NaN is not NaN


@tables
def test_a_backtest_holds_no_group_whole(spark):
    text = plan(registry.queries()["v04_backtest_summary"](spark, DATA))
    assert "median(" not in text and "percentile" not in text


@tables
def test_rows_that_are_moved_slim_give_the_same_signals(spark):
    bars = fixtures.table(spark, DATA, "bars")
    signals = ["technical", "momentum", "momentum_conf", "volume_signal", "volume_conf"]
    known = S.volume(S.momentum(S.technical(S.ranked(S.panel(bars, (5,)))))).select("ticker", "session_no", "fwd_5", *signals).toPandas().sort_values(["ticker", "session_no"]).reset_index(drop=True)
    wanted = S.score_panel(bars, (5,), F.col("session_no") > 100).select(*known.columns).toPandas().sort_values(["ticker", "session_no"]).reset_index(drop=True)
    every = S.score_panel(bars, (5,)).select(*known.columns).toPandas().sort_values(["ticker", "session_no"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(every, known)
    pd.testing.assert_frame_equal(wanted, known[known["session_no"] > 100].reset_index(drop=True))
    assert len(wanted) and set(S.slim(S.panel(bars), None).columns).isdisjoint({"volume_ratio", "rsi", "vol", "streak"})


@tables
def test_no_step_of_setups_is_written_out_of_what_stands_below_it(spark):
    """A filter on quotes, or a long expression used a dozen times, would copy all the chain's expressions into one step."""
    text = registry.queries()["o09_o10_setups"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert max(map(len, text.splitlines())) < 20_000
