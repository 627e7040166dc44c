"""The basket pipeline on hand-made rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import basket as B
from marketloom.operators import signals as M
from marketloom.operators import windows as W

DAY = "2024-01-09 00:00:00"
#: Columns of a gathered row.
ROW = (
    "ticker int, as_of date, price double, week_52_high double, week_52_low double, change_pct double, volume_ratio double, slope double, accel double, vol double, rsi double, n_returns int, streak int, "
    "pe_ratio double, analyst_rating string, analyst_mean_score double, target_price double, short_ratio double, short_pct_float double, beta double, iv_rank double, iv double, iv_rank_confidence double, iv_basis string, "
    "sentiment double, n_articles long, outlets int, recency double, momentum double, next_report date, last_surprise double, n_surprises int, mean_surprise double, beat_share double, n long, accuracy double, significant boolean"
)
NAMES = [c.split()[0] for c in ROW.split(", ")]


def rows(spark, *given):
    return spark.createDataFrame([tuple({"as_of": dt.date(2024, 1, 9), **g}.get(n) for n in NAMES) for g in given], ROW)


def one(df):
    return df.collect()[0].asDict()


def test_ranks_in_one_pass_equal_the_windows(spark):
    rng = random.Random(3)
    data = [(d, k, rng.choice([None, 0.0, 1.0, 2.5, rng.random()]), 1.0 if d else None) for d in range(4) for k in range(9 if d < 3 else 5)]
    df = spark.createDataFrame(data, "day int, ticker int, a double, b double")
    both = W.percentile_scores(df, {"up": ("a", True), "down": ("a", False), "flat": ("b", True)}, ["day"])
    both = both.withColumns({"w_up": W.percentile_score(F.col("a"), ["day"]), "w_down": W.percentile_score(F.col("a"), ["day"], higher=False), "w_flat": W.percentile_score(F.col("b"), ["day"])})
    got = both.collect()
    assert len(got) == len(data)
    assert all((r.up, r.down, r.flat) == (r.w_up, r.w_down, r.w_flat) for r in got)
    assert any(r.up is not None for r in got) and all(r.up is None for r in got if r.day == 3)


def test_a_ticker_without_data_is_neutral_and_uncovered(spark):
    r = one(B.basket_tradeability(rows(spark, {"ticker": 1})))
    assert (r["score"], r["coverage"], r["label"], r["structure"], r["would_be"]) == (0.0, 0.0, "NEUTRAL", "none", None)
    assert r["skipped"] == list(M.WEIGHTS)


def test_technical_event_and_fundamental_by_hand(spark):
    r = one(B.review(rows(spark, {
        "ticker": 1, "price": 100.0, "week_52_high": 100.0, "week_52_low": 50.0, "change_pct": 5.0, "analyst_rating": "B_uy", "next_report": dt.date(2024, 1, 9), "last_surprise": 30.0,
        "pe_ratio": 20.0, "n_surprises": 4, "mean_surprise": 5.0, "beat_share": 0.75,
    })))
    assert r["technical"] == round((1 * 1.2 + 1 * 0.6 + 0.6 * 1.0 + 0.5 * 0.8) / 3.6, 4) and r["technical_conf"] == 1.0
    assert r["event"] == round((-0.6 * 1.2 + 1 * 1.0 + 0.7 * 0.6) / 2.8, 4) and r["event_conf"] == 1.0 and r["days_to_earnings"] == 0
    assert r["fundamental"] == round((0.2 * 1.0 + 0.5 * 1.2 + 0.5 * 0.8) / 3.0, 4)
    assert r["structure"] == "none" and r["reason"] == "earnings_too_close"
    top = sum(M.WEIGHTS[k] * r[k] for k in ("technical", "event", "fundamental"))
    assert r["score"] == pytest.approx(top / sum(M.WEIGHTS[k] for k in ("technical", "event", "fundamental")), abs=1e-4)
    assert r["coverage"] == round(0.13 + 0.14 + 0.08, 3)


def test_ranks_need_six_tickers_and_move_the_score(spark):
    given = [{"ticker": k, "analyst_rating": "buy" if k else "hold", "target_price": 100.0 + k, "price": 100.0} for k in range(6)]
    few = B.ranked(B.features(rows(spark, *given[:5]))).collect()
    assert all(r.xs_upside is None and r.xs_rating is None for r in few)
    got = {r.ticker: r for r in B.basket_tradeability(rows(spark, *given)).collect()}
    assert [got[k].xs_upside for k in range(6)] == [None, -1.0, -0.5, 0.0, 0.5, 1.0] or [got[k].xs_upside for k in range(6)] == [-1.0, -0.6, -0.2, 0.2, 0.6, 1.0]
    assert got[0].xs_rating == -1.0 and got[1].xs_rating == round((1 + 4 / 2) / 5 * 2 - 1, 4)
    assert got[5].analyst == round(0.65 * 1.0 + 0.35 * 5 / 20, 4)


def test_the_scores_momentum_is_not_that_of_prices(spark):
    r = one(B.review(rows(spark, {"ticker": 1, "momentum": 0.2, "rsi": 85.0, "n_returns": 60})))
    assert r["sentiment_signal"] == 0.5 and r["momentum"] == 0.1


def test_feedback_counts_only_where_it_is_asked_for(spark):
    given = {"ticker": 1, "price": 100.0, "week_52_high": 100.0, "week_52_low": 50.0, "change_pct": 5.0, "n": 60, "accuracy": 0.8, "significant": True}
    plain, moved = one(B.review(rows(spark, given))), one(B.basket_tradeability(rows(spark, given), feedback=True))
    assert plain["score"] == plain["score_raw"] and moved["score"] == moved["would_be"] == round(plain["score"] * 1.09, 4)


def test_weights(spark):
    assert set(B.normalised({}).values()) == {round(1 / 9, 4)}
    w = B.normalised({"technical": 3.0, "event": 1.0})
    assert (w["technical"], w["event"], w["volume"]) == (0.75, 0.25, 0.0)
    r = one(B.basket_tradeability(rows(spark, {"ticker": 1, "price": 100.0, "week_52_high": 100.0, "week_52_low": 50.0, "next_report": dt.date(2024, 1, 10)}), {"event": 1.0}))
    assert r["score"] == r["event"] and r["coverage"] == 1.0


def test_articles_fresh_newest_and_dated(spark):
    at = lambda h: dt.datetime(2024, 1, 9) - dt.timedelta(hours=h)
    data = [(1, 1, "wsj", 1.0, at(0)), (2, 1, None, -1.0, at(48)), (3, 1, "yahoo", None, at(1)), (4, 1, "old", 1.0, at(24 * 7 + 1)), (5, 1, "none", 1.0, None), (6, 2, "a", 0.5, at(-100)), (7, 3, "b", 1.0, at(24 * 8))]
    data += [(100 + k, 4, f"s{k}", 1.0 if k < 50 else -1.0, at(k)) for k in range(60)]
    got = {r.ticker: (r.outlets, r.recency) for r in B.article_side(spark.createDataFrame(data, "id long, ticker int, source string, sentiment double, published_at timestamp"), DAY).collect()}
    assert set(got) == {1, 2, 4}
    e = 2.718281828459045**-1
    assert got[1] == (3, pytest.approx((1 - e) / (1 + e), abs=1e-6)) and got[2] == (1, 0.5) and got[4] == (50, 1.0)


def test_scores_of_a_fortnight(spark):
    d = lambda k: dt.date(2024, 1, k)
    data = [(1, d(1), 0.1), (1, d(2), 0.2), (1, d(3), 0.4), (1, d(4), 0.7), (2, d(1), 0.3), (3, d(1), 0.1), (3, d(28), 0.9), (4, d(1), 0.1), (4, d(20), 0.5), (4, d(28), 0.9)]
    got = {r.ticker: r.momentum for r in B.score_side(spark.createDataFrame(data, "ticker int, prediction_date date, score double")).collect()}
    assert got[1] == pytest.approx(0.5) and got[2] is None and got[3] is None and got[4] == pytest.approx(0.4)


def test_reports(spark):
    d = lambda y, m: dt.date(y, m, 1)
    data = [
        (1, d(2024, 2), 1.0, None, 1), (1, d(2024, 3), 1.0, None, 2), (1, d(2023, 12), 0.001, 2.0, 3), (1, d(2023, 9), 1.0, 1.1, 4), (1, d(2023, 6), 1.0, 0.9, 5), (1, d(2023, 3), 1.0, 1.2, 6), (1, d(2022, 12), 1.0, 1.3, 7), (1, d(2022, 9), 1.0, 3.0, 8), (1, d(2022, 6), 1.0, 9.0, 9),
        (2, d(2023, 1), 1.0, None, 1), (3, None, 1.0, 2.0, 1),
    ]
    got = {r.ticker: r for r in B.earnings_side(spark.createDataFrame(data, "ticker int, report_date date, eps_estimate double, eps_actual double, seq int"), DAY).collect()}
    assert set(got) == {1, 2}
    r = got[1]
    assert (r.next_report, r.last_surprise, r.n_surprises) == (d(2024, 2), None, 4)  # the newest result has no surprise; older ones don't stand for it
    assert r.mean_surprise == pytest.approx((10 - 10 + 20 + 30) / 4) and r.beat_share == 0.75
    assert (got[2].next_report, got[2].last_surprise, got[2].n_surprises, got[2].mean_surprise) == (None, None, 0, None)


def test_market_side_needs_only_the_last_sessions(spark):
    rng = random.Random(5)
    data, close = [], 100.0
    for n in range(1, 401):
        close *= 1 + rng.uniform(-0.03, 0.03)
        data.append((1, n, close, close * 1.01, close * 0.99, rng.randint(1000, 9000)))
    bars = spark.createDataFrame(data, "ticker int, session_no int, close double, high double, low double, volume long")
    short, whole = one(B.market_side(bars)), one(B.market_side(bars, 10_000))
    assert short.keys() == whole.keys() and all(short[k] == pytest.approx(whole[k], rel=1e-9) for k in short)
    assert short["week_52_high"] == max(r[3] for r in data[-252:]) and short["n_returns"] == 120


def test_gather_keeps_every_ticker_once(spark):
    basket = spark.createDataFrame([(1,), (2,), (2,)], "ticker int")
    got = {r.ticker: r.x for r in B.gather(basket, DAY, spark.createDataFrame([(2, 5), (3, 6)], "ticker int, x int")).collect()}
    assert got == {1: None, 2: 5}
