"""Rules of the scalar functions, joins and windows on small tables, and golden values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marketloom.functions import options as O
from marketloom.functions import scalars as S
from marketloom.operators import aggregates as A
from marketloom.operators import joins as J
from marketloom.operators import signals as M
from marketloom.operators import windows as W


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_clamp_keeps_null(spark):
    assert one(spark, S.clamp(F.lit(None).cast("double"), -1.0, 1.0)) is None
    assert one(spark, S.clamp(F.lit(3.0), -1.0, 1.0)) == 1.0


def test_labels_differ_at_their_limit(spark):
    assert one(spark, S.tradeability_label(F.lit(0.20))) == "NEUTRAL"
    assert one(spark, S.sentiment_label(F.lit(0.20))) == "BULLISH"


@pytest.mark.parametrize("x", [-6.0, -1.5, -0.1, 0.0, 0.7, 2.0, 5.0])
def test_norm_cdf(spark, x):
    assert one(spark, S.norm_cdf(F.lit(x))) == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=2e-7)


def test_put_call_parity_and_iv_round_trip(spark):
    s, k, t, v = F.lit(100.0), F.lit(105.0), F.lit(0.25), F.lit(0.3)
    call, put = one(spark, O.price(s, k, t, v, F.lit("C"))), one(spark, O.price(s, k, t, v, F.lit("P")))
    assert call - put == pytest.approx(100 - 105 * math.exp(-0.042 * 0.25), abs=1e-9)
    chain = spark.createDataFrame([(1, call, "C"), (2, put, "P"), (3, 0.0, "C"), (4, 200.0, "C")], "id int, p double, opt_right string").withColumns({"underlying_price": s, "strike": k, "t": t})
    found = {r.id: r.found for r in O.with_implied_vol(chain, "p").collect()}
    assert found[1] == pytest.approx(0.3, abs=1e-5) and found[2] == pytest.approx(0.3, abs=1e-5) and found[3] is None and found[4] is None


def test_weekdays_between(spark):
    day = dt.date(2024, 1, 1)
    for a in range(9):
        for n in (-8, -1, 0, 1, 5, 13):
            x, y = day + dt.timedelta(a), day + dt.timedelta(a + n)
            lo, hi = min(x, y), max(x, y)
            want = sum((lo + dt.timedelta(k)).weekday() < 5 for k in range(1, (hi - lo).days + 1)) * (1 if n >= 0 else -1)
            assert one(spark, S.weekdays_between(F.lit(x), F.lit(y))) == want


def test_asof_join_is_inclusive_and_sees_no_future(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 6, "y"), ("a", 2, "z")], "k string, at int, v string")
    got = {(r.k, r.t): r.v for r in J.asof_join(left, right, ["k"], "t", "at").collect()}
    assert got == {("a", 5): "x", ("a", 1): None, ("b", 9): None}
    got = {(r.k, r.t): r.v for r in J.asof_join(left, right, ["k"], "t", "at", allow_exact=False).collect()}
    assert got[("a", 5)] == "z"


def test_interval_join_has_both_ends(spark):
    left = spark.createDataFrame([(1, "a", dt.date(2024, 3, 31))], "id int, k string, at date")
    right = spark.createDataFrame([("a", dt.date(2024, 3, 1), 1), ("a", dt.date(2024, 2, 29), 2), ("a", dt.date(2024, 3, 31), 3), ("a", dt.date(2024, 4, 1), 4)], "k string, on date, v int")
    assert sorted(r.v for r in J.interval_join(left, right, ["k"], "at", "on", 30).collect()) == [1, 3]


def test_percentile_score_ties_and_small_groups(spark):
    rows = [("d", i, float(v)) for i, v in enumerate([1, 2, 2, 3, 4, 5])] + [("e", i, 1.0) for i in range(6)] + [("f", i, float(i)) for i in range(5)]
    got = spark.createDataFrame(rows, "g string, i int, v double").withColumn("s", W.percentile_score(F.col("v"), ["g"])).collect()
    d = {r.i: r.s for r in got if r.g == "d"}
    assert d[0] == -1 and d[5] == 1 and d[1] == d[2] == pytest.approx(-0.4)
    assert {r.s for r in got if r.g == "e"} == {0.0} and {r.s for r in got if r.g == "f"} == {None}


def test_wilder_rsi_ends(spark):
    def f(values):
        bars = spark.createDataFrame([("a", k, v) for k, v in enumerate([None, *values])], "ticker string, session_no int, ret double")
        return {r.session_no: (r.rsi, r.n_returns, r.streak) for r in W.run_features(bars).collect()}[len(values)]

    assert f([1.0] * 20) == (100, 20, 14) and f([-1.0] * 20) == (0, 20, -14) and f([1.0] * 14)[0] is None
    assert f([-1.0, 1.0, 0.0])[2] == 2
    values, g, drop = [math.sin(k) for k in range(130)], 0.0, 0.0
    seen = values[-120:]
    g, drop = sum(max(v, 0) for v in seen[:14]) / 14, sum(max(-v, 0) for v in seen[:14]) / 14
    for v in seen[14:]:
        g, drop = (g * 13 + max(v, 0)) / 14, (drop * 13 + max(-v, 0)) / 14
    assert f(values)[0] == pytest.approx(100 - 100 / (1 + g / drop)) and f(values)[1] == 120


def test_headline_keys_golden(spark):
    import hashlib

    key = lambda t: hashlib.sha1(t.encode()).hexdigest()
    for text in ("Fed holds rates", "UPDATE 2-Fed holds rates", "CORRECTED: Fed holds rates!", "correct 3 - Fed holds rates", "Reuters – Fed holds rates", "dow jones st.  — Fed  holds, rates"):
        assert one(spark, S.headline_key(F.lit(text))) == key("fed holds rates"), text
    assert one(spark, S.headline_key(F.lit(""))) == ""


@pytest.mark.parametrize(("name", "category", "importance"), [("FOMC minutes", "Fed / Rates", "High"), ("Consumer price index", "Inflation", "Low"), ("Core CPI", "Inflation", "High"), ("ADP employment", "Labour", "Medium"), ("GDP", "GDP", "High"), ("ISM services", "Manufacturing", "Medium"), ("Housing starts", "Housing", "Medium"), ("Trade balance", "Trade", "Low"), ("10-year auction", "Treasury", "Low"), ("Parade", "Other", "Low")])
def test_macro_names_golden(spark, name, category, importance):
    assert (one(spark, S.macro_category(F.lit(name))), one(spark, S.macro_importance(F.lit(name)))) == (category, importance)


@pytest.mark.parametrize(("rating", "value"), [("Strong Buy", 1.0), ("buy", 0.6), ("Outperform", 0.5), ("market_perform", 0.0), ("Underweight", -0.5), ("SELL", -0.8), ("odd", None)])
def test_rating_values_golden(spark, rating, value):
    assert one(spark, S.rating_value(F.lit(rating))) == value


def test_analyst_events_golden(spark):
    rows = [("Upgrades", "Increases", None, 3.0), ("downgrade", "Decreases", None, -3.0), ("Reinstated", "", "Strong Buy", 1.5), ("Initiates", "Cuts", "Underweight", -2.5), (None, None, None, 0.0)]
    df = spark.createDataFrame(rows, "a string, p string, r string, want double")
    assert df.where(A.analyst_event_score(F.col("a"), F.col("p"), F.col("r")) != F.col("want")).isEmpty()
    assert one(spark, A.momentum_state(F.lit(4.0))) == "STRONGLY POSITIVE" and one(spark, A.momentum_state(F.lit(-1.5))) == "NEGATIVE"


def test_composite_covers_the_full_weight_and_may_be_null(spark):
    df = spark.createDataFrame([(0.5, 1.0, None, 0.0, 0.2, 0.1), (0.5, 0.1, None, 0.0, 0.2, 0.1)], "technical double, technical_conf double, momentum double, momentum_conf double, volume_signal double, volume_conf double")
    a, b = M.composite(df).collect()
    assert (a.score, a.coverage, a.possible) == (0.5, 0.13, 0.39) and b.score is None and b.label is None


def test_past_scores_ignore_the_future(spark):
    rows = [(t, n, dt.date(2020, 1, 1) + dt.timedelta(n), *(3 * [100 + math.sin(n * (t + 1)) * 5 + 0.01 * n * t]), 1000 + (n * 7 * (t + 3)) % 91) for t in range(7) for n in range(1, 90)]
    rows = [(t, n, d, o, h + 1, lo - 1, lo, v) for t, n, d, o, h, lo, v in rows]
    bars = spark.createDataFrame(rows, "ticker int, session_no int, trade_date date, open double, high double, low double, close double, volume long")
    keep = ["ticker", "session_no", "score", "label"]
    whole = M.score_panel(bars).where("session_no <= 60").select(keep)
    cut = M.score_panel(bars.where("session_no <= 60")).select(keep)
    assert whole.exceptAll(cut).isEmpty() and cut.count() == 7 * 60
    assert M.score_panel(bars).where("abs(score) > 1").isEmpty()


def test_trade_metrics_golden(spark):
    t = spark.createDataFrame([("DEBIT", "OPTION", "BULLISH", 2.0, 4.0, 1, 100, None), ("CREDIT", "OPTION", "BULLISH", 2.0, 0.5, 1, 100, 300.0)], "entry_type string, instrument_type string, direction string, entry_value double, exit_value double, quantity int, multiplier int, planned_max_loss double")
    assert [(r.pnl, r.risk, r.return_on_risk) for r in A.trade_metrics(t).collect()] == [(200.0, 200.0, 100.0), (150.0, 300.0, 50.0)]


def test_run_features_over_block_ends(spark):
    """Tickers that begin, end and go on anywhere in a block, with gaps, as each by itself."""
    rows = [(f"t{k}", n, None if (n * k) % 11 == 3 else float((n * 37 + k * 11) % 17 - 8), 100.0 + (n * 53 + k) % 29, 90.0 - (n * 31 + k) % 23) for k in range(1, 6) for n in range(1, 60 * k % 97 + 2)]
    df = spark.createDataFrame(rows, "ticker string, session_no int, ret double, high double, low double")
    found = {b: {(r.ticker, r.session_no): r for r in W.run_features(df.coalesce(1), bars_seen=20, block=b, extremes=25).collect()} for b in (7, 4096)}
    assert found[7] == found[4096] and len(found[7]) == len(rows)
    for k in range(1, 6):
        alone = W.run_features(df.where(f"ticker = 't{k}'"), bars_seen=20, extremes=25).collect()
        assert all(found[7][r.ticker, r.session_no] == r for r in alone)
    for (t, n), r in found[7].items():
        near = [x for x in rows if x[0] == t and n - 25 < x[1] <= n]
        assert (r.high_n, r.low_n) == (max(x[3] for x in near), min(x[4] for x in near))


def test_signals_are_compiled(spark):
    """The JVM compiles no method of more than 8,000 bytes of code."""
    names = ["position", "from_high", "ret", "slope", "accel", "vol", "rsi", "volume_ratio", "xs_position", "xs_from_high", "xs_slope", "xs_accel", "xs_signed_ratio"]
    df = spark.range(10).select(*[(F.col("id") / (k + 2)).alias(n) for k, n in enumerate(names)], F.col("id").cast("int").alias("streak"), F.col("id").cast("int").alias("n_returns"))
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    for d, out in ((M.technical(df), "technical"), (M.momentum(df), "momentum"), (M.volume(df), "volume_signal")):
        code = debug.codegenStringSeq(d.select(out)._jdf.queryExecution().executedPlan())
        assert code.size() and max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000
