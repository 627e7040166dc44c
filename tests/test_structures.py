"""Strategies, structures and contract back-tests: golden values, and set-ups against plain Python."""

import datetime
import math
import os

import pytest
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions import scoring
from marketloom.operators import contracts as B
from marketloom.operators import keywords as K
from marketloom.operators import panels as P
from marketloom.operators import structures as X
from marketloom.operators import terminal as D
from marketloom.plans import contracts as plans
from marketloom.sources.fixtures import table

DATA = "/root/testdata/sf0.001"
LEG = "struct<action:string,leg:struct<strike:double,right:string,bid:double,ask:double,mid:double,iv:double>>"


def legs(spark, structure, *given):
    rows = [(a, (float(k), r, bid, ask, (bid + ask) / 2, 0.3)) for a, r, k, bid, ask in given]
    return spark.createDataFrame([(structure, rows, 35)], f"structure string, legs array<{LEG}>, dte int")


def test_economics_of_debit_and_credit(spark):
    debit = X.with_economics(legs(spark, "bull_call_spread", ("BUY", "C", 100, 3.9, 4.1), ("SELL", "C", 105, 1.9, 2.1))).first()
    assert (debit.net_debit, debit.max_loss, debit.max_profit, debit.breakevens[0]) == pytest.approx((2.2, 2.2, 2.8, 102.2)) and not debit.is_credit and debit.net_debit > debit.net_debit_mid
    credit = X.with_economics(legs(spark, "bull_put_spread", ("SELL", "P", 95, 2.0, 2.2), ("BUY", "P", 90, 0.9, 1.1))).first()
    assert (credit.net_debit, credit.max_loss, credit.max_profit, credit.breakevens[0]) == pytest.approx((-0.9, 4.1, 0.9, 94.1)) and credit.is_credit
    condor = X.with_economics(legs(spark, "iron_condor", ("SELL", "P", 95, 2.0, 2.2), ("BUY", "P", 90, 0.9, 1.1), ("SELL", "C", 105, 1.9, 2.1), ("BUY", "C", 115, 0.5, 0.7))).first()
    assert condor.breakevens == pytest.approx([95 - 2.1, 105 + 2.1]) and (condor.max_profit, condor.max_loss, condor.width) == pytest.approx((2.1, 7.9, 10))
    call = X.with_economics(legs(spark, "long_call", ("BUY", "C", 100, 3.9, 4.1))).first()
    assert call.max_profit is None and call.max_loss == pytest.approx(4.1) and call.breakevens == pytest.approx([104.1])
    short = X.with_economics(legs(spark, "other", ("SELL", "C", 100, 3.9, 4.1), ("BUY", "P", 90, 1.0, 1.1))).first()
    assert short.max_loss is None and short.max_profit == pytest.approx(90 + 2.8)


def test_one_sign_for_debit_and_credit(spark):
    for given, good, bad in (((("BUY", "C", 100, 3.9, 4.1), ("SELL", "C", 105, 1.9, 2.1)), 112.0, 92.0), ((("SELL", "P", 95, 2.0, 2.2), ("BUY", "P", 90, 0.9, 1.1)), 110.0, 88.0)):
        df = X.with_economics(legs(spark, "s", *given)).withColumns({"up": F.lit(good), "down": F.lit(bad), "days": F.lit(17)})
        r = X.reprice(df, {"at_up": "up", "at_down": "down"}, "days").first()
        assert r.at_up - r.net_debit > 0 > r.at_down - r.net_debit


def test_strategy_grid(spark):
    rows = [(0.6, 85.0, "chain", None, 1.0), (0.6, 15.0, "chain", None, 1.0), (0.9, 10.0, "chain", 3, 1.0), (0.0, 50.0, "chain", None, 1.0), (0.6, 85.0, "proxy", None, 1.0), (0.6, None, "chain", None, 1.0), (0.6, 15.0, "chain", 20, 1.0), (-0.2, 70.0, "chain", None, 1.0), (0.0, 90.0, "chain", None, 0.3), (-0.6, 30.0, "chain", 8, None), (None, None, None, None, None)]
    got = [(r.structure, r.sizing, r.reason, r.target_dte, r.min_dte, r.max_dte) for r in X.choose(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, score double, iv_rank double, iv_basis string, days_to_earnings int, coverage double")).orderBy("i").collect()]
    assert got == [
        ("bull_put_spread", "full", None, 35, 21, 60), ("bull_call_spread", "full", None, 35, 21, 60), ("none", "avoid", "earnings_too_close", 35, 21, 60), ("none", "avoid", "no_edge", 35, 21, 60),
        ("bull_call_spread", "half", None, 35, 21, 60), ("bull_call_spread", "half", None, 35, 21, 60), ("bull_call_spread", "full", None, 35, 25, 60), ("bear_call_spread", "half", None, 35, 21, 60),
        ("iron_condor", "quarter", None, 35, 21, 60), ("bear_put_spread", "half", None, 35, 21, 60), ("none", "avoid", "no_edge", 35, 21, 60),
    ]


def normal(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def value(s, k, t, v, right):
    if t <= 0:
        return max(s - k, 0) if right == "C" else max(k - s, 0)
    d1 = (math.log(s / k) + (0.042 + v * v / 2) * t) / (v * math.sqrt(t))
    call = s * normal(d1) - k * math.exp(-0.042 * t) * normal(d1 - v * math.sqrt(t))
    return call if right == "C" else call - s + k * math.exp(-0.042 * t)


def implied(p, s, k, t, right):
    if p <= 0 or p < (max(s - k, 0) if right == "C" else max(k - s, 0)) - 1e-6 or value(s, k, t, 5.0, right) < p:
        return None
    lo, hi = 1e-4, 5.0
    for _ in range(100):
        mid = (lo + hi) / 2
        x = value(s, k, t, mid, right)
        if abs(x - p) < 1e-6:
            return mid
        lo, hi = (lo, mid) if x > p else (mid, hi)
    return (lo + hi) / 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_setups_against_plain_python(spark):
    get = lambda t: table(spark, DATA, t)
    got = plans.basket_setups(get).collect()
    chains = {}
    for q in get("option_chain").collect():
        chains.setdefault((q.ticker, q.trade_date), []).append(q)
    seen = set()
    assert len({(r.ticker, r.trade_date) for r in got}) == len(got) > 100
    for r in got:
        seen.add(r.reason or r.structure)
        if r.reason in ("earnings_too_close", "no_edge"):
            assert r.legs is None and r.structure == "none"
            continue
        chain = chains[r.ticker, r.trade_date]
        dates = {(q.dte, q.expiration) for q in chain}
        inside = [d for d in dates if r.min_dte <= d[0] <= r.max_dte] or [d for d in dates if d[0] >= 7]
        dte, expiry = min(inside, key=lambda d: (abs(d[0] - r.target_dte), d))
        assert (r.dte, r.expiration) == (dte, expiry)
        taken = []
        for action, right, target in X.LEGS[r.structure]:
            best = None
            for q in sorted((q for q in chain if q.expiration == expiry and q.opt_right == right), key=lambda q: q.strike):
                mid = (q.bid + q.ask) / 2 if q.bid > 0 and q.ask > 0 else q.ask or q.bid
                spread = (q.ask - q.bid) / mid if q.bid > 0 and q.ask > 0 else None
                if q.strike in [t[1].strike for t in taken] or q.bid < 0.05 or q.open_interest < 100 or (spread is not None and spread > 0.20):
                    continue
                strict = q.volume >= 10 and spread is not None and spread <= 0.10
                t = q.dte / 365
                v = q.iv if q.iv and 0.01 < q.iv <= 3 else implied(mid, q.underlying_price, q.strike, t, right)
                if not v:
                    continue
                d1 = (math.log(q.underlying_price / q.strike) + (0.042 + v * v / 2) * t) / (v * math.sqrt(t))
                delta = normal(d1) - (right == "P")
                away = abs(abs(delta) - target) + (0 if strict else 0.15)
                if best is None or away < best[0]:
                    best = (away, q, v)
            if best is None:
                break
            taken.append((action, best[1], best[2]))
        if len(taken) < len(X.LEGS[r.structure]):
            assert r.reason == "illiquid"
            continue
        assert r.reason is None and [x.leg.strike for x in r.legs] == [q.strike for _, q, _ in taken]
        sign = lambda a: 1 if a == "BUY" else -1
        debit = sum(sign(a) * (q.ask if a == "BUY" else q.bid) for a, q, _ in taken)
        worth = lambda s: sum(sign(a) * value(s, q.strike, (dte - max(1, dte // 2)) / 365, v, q.opt_right) for a, q, v in taken)
        gain, loss = worth(r.price_target) - debit, worth(r.price_stop) - debit
        assert r.net_debit == pytest.approx(debit) and r.pnl_at_target == pytest.approx(min(gain, r.max_profit), abs=1e-4) and r.pnl_at_stop == pytest.approx(max(loss, -abs(r.max_loss)), abs=1e-4)
    assert {"no_edge", "bull_call_spread"} <= seen and len(seen) >= 5


def test_a_chain_without_liquid_or_any_quotes(spark):
    o = spark.createDataFrame([("A", 1, 100.0), ("B", 1, 100.0), ("C", 1, None)], "ticker string, trade_date int, spot double").withColumns({"score": F.lit(0.6), "coverage": F.lit(0.8), "iv_rank": F.lit(10.0), "iv_basis": F.lit("chain"), "days_to_earnings": F.lit(None).cast("int"), "atr": F.lit(None).cast("double"), "support": F.lit(None).cast("double"), "resistance": F.lit(None).cast("double")})
    chain = spark.createDataFrame([("A", 1, 36, 35, "C", 100.0, 100.0, 0.01, 0.02, 0.3, 5, 1)], "ticker string, trade_date int, expiration int, dte int, opt_right string, strike double, underlying_price double, bid double, ask double, iv double, open_interest long, volume long")
    assert {r.ticker: r.reason for r in X.setups(o, chain).collect()} == {"A": "illiquid", "B": "no_chain", "C": "no_price"}


def test_entry_legs_keep_their_orientation(spark):
    day = datetime.date
    quote = lambda k, d, r="C": ("XYZ", day(2024, 1, 2), day(2024, 2, 9), 38, r, float(k), 2.0, 2.1, 1000, d)
    rows = [quote(100, 0.46), quote(105, 0.34), quote(110, 0.24), quote(95, 0.65), quote(100, -0.46, "P"), quote(95, -0.32, "P"), quote(90, -0.24, "P"), quote(105, -0.62, "P")]
    chain = spark.createDataFrame(rows, "ticker string, trade_date date, expiration date, dte int, opt_right string, strike double, bid double, ask double, open_interest long, delta double")
    seen = spark.createDataFrame([("XYZ", day(2024, 1, 2), 0.6), ("XYZ", day(2024, 1, 2), -0.6), ("XYZ", day(2024, 1, 2), 0.1), ("NONE", day(2024, 1, 2), 0.9)], "ticker string, obs_date date, score double")
    got = {r.score: (r.long.strike, r.short.strike) for r in B.entry_legs(seen, chain).collect()}
    assert got == {0.6: (100, 110), -0.6: (100, 90)}
    wrong = chain.withColumn("delta", F.when(F.col("strike") == 95, 0.25).when(F.col("strike") == 110, 0.1).otherwise(F.col("delta"))).where("opt_right = 'C'")
    assert [(r.long.strike, r.short.strike) for r in B.entry_legs(seen, wrong).collect()] == [(100, 105)]


def test_scorers_that_fail(spark):
    # classes of a test module are not on the workers' path, so they are local and travel with the task
    class Fails:
        def score_batch(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [0.5] * len(texts)

    class Few:
        def score_batch(self, texts):
            return [0.25] * (len(texts) - 1 if len(texts) > 1 else 1)

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["fine", "<b>bad</b> one", None, "  ", "fine too"])], "id int, text string").coalesce(1)
    got = {r.id: (r.score, r.score_error) for r in scoring.score_texts(df, Fails()).collect()}
    assert got == {0: (0.5, None), 1: (None, "RuntimeError: no"), 2: (0.0, None), 3: (0.0, None), 4: (0.5, None)}
    assert sorted(r.score for r in scoring.score_texts(df, Few()).collect()) == [0.0, 0.0, 0.25, 0.25, 0.25]
    assert isinstance(scoring.build_scorer({"model": "words"}), scoring.WordScorer)
    scoring.register_scorer("broken", lambda: 1 / 0)
    assert isinstance(scoring.build_scorer({"model": "broken"}), scoring.WordScorer)
    with pytest.raises(ValueError):
        scoring.build_scorer({"model": "none"})


def test_many_keywords(spark):
    texts = spark.createDataFrame([(1, "Renewing York: term77 and TERM99999"), (2, "xx"), (3, None), (4, "a%b_c [d]")], "id long, text string")
    terms = spark.range(100_000).select(F.concat(F.lit("term"), F.col("id").cast("string")).alias("term")).union(spark.createDataFrame([("w",), ("xx",), ("xxx",), ("%b_",), ("[d]",), ("",), (None,), ("ing Y",)], "term string"))
    got = {tuple(r) for r in K.containment_join(texts, terms).collect()}
    assert got == {(1, t) for t in ("term7", "term77", "term9", "term99", "term999", "term9999", "term99999", "w", "ing y")} | {(2, "xx"), (4, "%b_"), (4, "[d]")}
    assert K.containment_join(texts, terms.limit(0)).isEmpty()


def test_keywords_of_tickers_in_parts(spark, monkeypatch):
    """Many blocks and chunks, several texts of an id, and nothing moved after the match."""
    for name, value in {"BLOCK": 40, "CHUNK": 300, "LEAST": 200, "STEP": 64, "ROWS": 8}.items():
        monkeypatch.setattr(K, name, value)
    words = [f"{a}{b}" * k for a in "ab\u00e9\U0001f600" for b in "bc " for k in (1, 2, 4)]
    texts = [(k % 40, "".join(words[(k * 7 + j * j) % len(words)] for j in range(k % 6))) for k in range(60)] + [(None, "abab"), (None, "bcbc"), (99, None)]
    terms = [(k % 17 or None, w) for k, w in enumerate(words)] + [(3, "abab"), (3, "AB"), (4, ""), (5, None)]
    got = K.match_tickers(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "ticker int, term string"))
    want = {(i, t) for i, text in texts for t, w in terms if text and w and w.lower() in text.lower()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 1)
    assert "Exchange" not in plan[0] and "Join" not in plan[0]


def test_tickers_beyond_ascii(spark):
    given = [" brk.b ", "scha\u00df", "\ufb01x", "AB\u0085", "\u000bAB", "a-b\n", ""]
    df = spark.createDataFrame([(t,) for t in given], "t string").select(S.normalize_ticker(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == ["BRK.B", None, None, None, None, "A-B", None]


def test_long_panel_layouts(spark):
    wide = spark.createDataFrame([("d", "1.5", 2.0, "n/a", float("nan"), "z")], "day string, `Close|A` string, `B|Close` double, `A|Volume` string, `Volume|B` double, other string")
    assert sorted((r.ticker, r.close, r.volume) for r in P.long_panel(wide, ["day"], ("Close", "Volume")).collect()) == [("A", 1.5, None), ("B", 2.0, None)]
    one = spark.createDataFrame([("d", 3.0)], "day string, Close double")
    assert [(r.ticker, r.close) for r in P.long_panel(one, ["day"], ("Close",), ticker="X").collect()] == [("X", 3.0)]


def case(spark, **change):
    row = {"score": 0.62, "coverage": 0.85, "regime": "STRONG_RISK_ON", "trend_state": "STRONG BULL", "momentum_state": "ACCELERATING BULLISH", "strength_state": "STRONG", "volume_state": "CONFIRMED", "analyst_state": "POSITIVE", "options_bias": "Bullish debit structure", "rsi": 64.0, "iv_percentile": None, "put_skew": None} | change
    kinds = ", ".join(f"{k} {'double' if k in ('score', 'coverage', 'rsi', 'iv_percentile', 'put_skew') else 'string'}" for k in row)
    return D.divergences(D.agreement(D.conviction(spark.createDataFrame([tuple(row.values())], kinds)))).first()


def test_conviction_and_contradictions(spark):
    r = case(spark)
    assert "BULL" in r.direction and r.conviction >= 60 and r.agreement in ("HIGH", "MODERATE") and r.opposing == 0 and not r.divergences
    r = case(spark, score=0.55, coverage=0.8, regime="RISK_ON", strength_state="LAGGING", volume_state="WEAK", analyst_state="NEGATIVE", options_bias=None, iv_percentile=90.0)
    assert {"Relative-strength divergence", "Analyst divergence", "Volatility pricing risk"} <= {d.title for d in r.divergences}
    r = case(spark, trend_state=None, momentum_state=None, strength_state=None, volume_state=None, score=None, regime=None, analyst_state=None, options_bias=None)
    assert (r.direction, r.conviction, len(r.families), r.agreement) == ("NEUTRAL", 0, 4, "LOW")
