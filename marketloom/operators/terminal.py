"""The market as a whole and one ticker's case: regime, conviction of signal families, agreement, contradictions, reading of the
options market, decision.  All are expressions of a row; wording and limits are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import context as C

#: Weights of the regime's pieces and of the signal families.
REGIME_WEIGHTS = {"trend": 0.45, "volatility": 0.20, "breadth": 0.25, "rates": 0.10}
FAMILIES = {"MktScan": 0.30, "Macro": 0.20, "Trend": 0.18, "Momentum": 0.14, "Participation": 0.10, "Catalyst": 0.05, "Options": 0.03}
TECHNICAL = ("Trend", "Momentum", "Participation")


def regime(df: DataFrame) -> DataFrame:
    """``df`` with ``score``, ``confidence``, ``coverage``, ``trend_score`` and ``label``, from score and confidence of two indices (``spy_``, ``qqq_``), of
    ``volatility_``, ``breadth_`` and ``rates_``, and from ``risk`` and ``volatility_state``.  Pieces without a score or confidence do not count."""
    spy, qqq = F.col("spy_score"), F.col("qqq_score")
    n = spy.isNotNull().cast("int") + qqq.isNotNull().cast("int")
    conf = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    trend = F.when(n > 0, (F.coalesce(spy, F.lit(0.0)) + F.coalesce(qqq, F.lit(0.0))) / n)
    d = df.withColumn("trend_score", trend).withColumn("trend_confidence", (conf("spy_confidence") + conf("qqq_confidence")) / 2)
    used = {k: F.col(f"{k}_score").isNotNull() & (conf(f"{k}_confidence") > 0) for k in REGIME_WEIGHTS}
    low = sum((F.when(used[k], w * conf(f"{k}_confidence")).otherwise(0.0) for k, w in REGIME_WEIGHTS.items()), F.lit(0.0))
    top = sum((F.when(used[k], w * conf(f"{k}_confidence") * F.col(f"{k}_score")).otherwise(0.0) for k, w in REGIME_WEIGHTS.items()), F.lit(0.0))
    cover = sum((F.when(used[k], F.lit(w)).otherwise(0.0) for k, w in REGIME_WEIGHTS.items()), F.lit(0.0))
    d = d.withColumns({"score": S.clamp(F.when(low > 0, top / low).otherwise(0.0), -1.0, 1.0), "confidence": F.least(F.lit(1.0), low), "coverage": cover})
    return d.withColumn("label", C.regime_label(F.col("score"), F.coalesce("risk", F.lit(0.0)), F.coalesce("volatility_state", F.lit("UNKNOWN"))))


def equity_state(spy_score: Column, qqq_score: Column, spy_return: Column, qqq_return: Column, breadth: Column, vix: Column) -> dict[str, Column]:
    """Four words on the market: trend, breadth (mean share above the 50-day average), volatility and momentum (20-day returns in
    percent)."""

    def mean(a: Column, b: Column) -> Column:
        n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
        return F.when(n > 0, (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))) / n).otherwise(0.0)

    trend, move = mean(spy_score, qqq_score), mean(spy_return, qqq_return)
    return {
        "trend": F.when(trend >= 0.20, "BULLISH").when(trend <= -0.20, "BEARISH").otherwise("NEUTRAL"),
        "breadth": F.when(breadth >= 60, "HEALTHY").when(breadth < 40, "WEAK").when(breadth.isNotNull(), "MIXED").otherwise("UNAVAILABLE"),
        "vix_structure": F.when(vix >= 30, "STRESS").when(vix >= 22, "ELEVATED").otherwise("NORMAL"),
        "momentum": F.when(move >= 2.0, "STRONG").when(move <= -2.0, "WEAK").otherwise("MIXED"),
    }


def _side(bull: Column, bear: Column) -> Column:
    return F.when(F.coalesce(bull, F.lit(False)), 1).when(F.coalesce(bear, F.lit(False)), -1).otherwise(0)


def vote(state: Column) -> Column:
    """+1 or -1 where the words of a state are all on one side."""
    s = F.upper(F.coalesce(state, F.lit("")))
    bull, bear = s.rlike("BULL|POSITIVE|STRONG|CONFIRMED|RISK_ON|HEALTHY"), s.rlike("BEAR|NEGATIVE|LAGGING|WEAK|RISK_OFF|STRESS")
    return _side(bull & ~bear, bear & ~bull)


def conviction(df: DataFrame) -> DataFrame:
    """``df`` with ``direction``, ``conviction`` (0 to 100), ``weighted`` and ``families`` (name, vote, strength, weight, state), from ``score``, ``coverage``,
    ``regime``, ``trend_state``, ``momentum_state``, ``strength_state``, ``volume_state`` (the technical families stand where trend_state is not
    null), ``analyst_state`` and ``options_bias``.  Correlated indicators share one vote of their family."""
    signal = S.semantic_signal(F.col("score"))
    base = _side(signal.contains("BULL"), signal.contains("BEAR"))
    macro = _side(F.col("regime").contains("RISK_ON"), F.col("regime").contains("RISK_OFF"))
    trend_state, momentum_state, strength_state, volume_state = (F.col(f"{c}_state") for c in ("trend", "momentum", "strength", "volume"))
    trend = _side(trend_state.contains("BULL"), trend_state.contains("BEAR"))
    momentum = _side(momentum_state.contains("BULL") | (momentum_state == "POSITIVE"), momentum_state.contains("BEAR") | (momentum_state == "NEGATIVE"))
    confirmed = volume_state == "CONFIRMED"
    joined = _side(strength_state.isin("STRONG", "POSITIVE"), strength_state.isin("WEAK", "LAGGING")) + F.when(confirmed, F.when(base >= 0, 1).otherwise(-1)).otherwise(0)
    analyst = _side(F.col("analyst_state").contains("POSITIVE"), F.col("analyst_state").contains("NEGATIVE"))
    options = vote(F.col("options_bias"))
    given = {
        "MktScan": (base, F.least(F.lit(1.0), F.abs(F.coalesce("score", F.lit(0.0))) / 0.65), signal),
        "Macro": (macro, F.when(macro != 0, 0.8).otherwise(0.35), F.coalesce("regime", F.lit("UNKNOWN"))),
        "Trend": (trend, F.when(trend_state.contains("STRONG"), 1.0).when(trend != 0, 0.7).otherwise(0.35), trend_state),
        "Momentum": (momentum, F.when(momentum_state.contains("ACCELERATING"), 1.0).when(momentum != 0, 0.7).otherwise(0.35), momentum_state),
        "Participation": (F.signum(joined.cast("double")).cast("int"), F.when(confirmed, 0.9).otherwise(0.65), F.concat_ws(" / ", strength_state, volume_state)),
        "Catalyst": (analyst, F.when(analyst != 0, 0.75).otherwise(0.3), F.coalesce("analyst_state", F.lit("NEUTRAL"))),
        "Options": (options, F.when(options != 0, 0.5).otherwise(0.25), F.coalesce("options_bias", F.lit("NEUTRAL"))),
    }
    one = lambda k: F.struct(F.lit(k).alias("name"), given[k][0].alias("vote"), given[k][1].alias("strength"), F.lit(FAMILIES[k]).alias("weight"), given[k][2].alias("state"))
    every = F.array(*[F.when(trend_state.isNotNull(), one(k)) if k in TECHNICAL else one(k) for k in FAMILIES])
    d = df.withColumn("families", F.filter(every, lambda f: f.isNotNull()))
    total = F.aggregate("families", F.lit(0.0), lambda s, f: s + f["weight"])
    weighted = F.aggregate("families", F.lit(0.0), lambda s, f: s + f["vote"] * f["strength"] * f["weight"]) / total
    d = d.withColumn("__w", weighted)
    held = 0.65 + 0.35 * S.clamp(F.coalesce("coverage", F.lit(0.5)), 0.0, 1.0)
    d = d.withColumn("conviction", F.bround(F.least(F.lit(100.0), F.abs("__w") * 100 * held)).cast("int")).withColumn("weighted", F.col("__w"))
    firm = F.col("conviction") >= 80
    return d.withColumn("direction", F.when(F.col("__w") >= 0.12, F.when(firm, "STRONG BULL").otherwise("BULLISH")).when(F.col("__w") <= -0.12, F.when(firm, "STRONG BEAR").otherwise("BEARISH")).otherwise("NEUTRAL")).drop("__w")


def agreement(df: DataFrame) -> DataFrame:
    """``df`` (of ``conviction``) with ``agreement``, ``agreeing``, ``opposing``, ``directional`` and ``ratio`` of the families that vote."""
    target = _side(F.col("direction").contains("BULL"), F.col("direction").contains("BEAR"))
    count = lambda f: F.size(F.filter("families", f))
    d = df.withColumns({"directional": count(lambda f: f["vote"] != 0), "agreeing": F.when(target != 0, count(lambda f: f["vote"] == target)).otherwise(0), "opposing": F.when(target != 0, count(lambda f: f["vote"] == -target)).otherwise(0)})
    d = d.withColumn("ratio", F.when(F.col("directional") > 0, F.col("agreeing") / F.col("directional")).otherwise(0.0))
    return d.withColumn("agreement", F.when((F.col("ratio") >= 0.75) & (F.col("directional") >= 4), "HIGH").when(F.col("ratio") >= 0.55, "MODERATE").otherwise("LOW"))


def divergences(df: DataFrame, most: int = 6) -> DataFrame:
    """``df`` (of ``conviction``, with ``rsi``, ``iv_percentile`` and ``put_skew``) with ``divergences``: (severity, title, detail) of what speaks against
    the direction, in this order, ``most`` of them."""
    bull, bear = F.col("direction").contains("BULL"), F.col("direction").contains("BEAR")
    strength, momentum, analyst, rsi = F.col("strength_state"), F.col("momentum_state"), F.col("analyst_state"), F.col("rsi")
    against = F.transform(F.filter("families", lambda f: f["vote"] == F.when(bull, -1).when(bear, 1)), lambda f: f["name"])
    say = lambda when, severity, title, *detail: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(title).alias("title"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in detail]).alias("detail")))
    whole = lambda c: F.bround(c).cast("int").cast("string")
    lagging, leading = strength.isin("LAGGING", "WEAK"), strength.isin("STRONG", "POSITIVE")
    found = [
        say(bull & lagging, "HIGH", "Relative-strength divergence", "Bullish directional thesis, but the ticker is lagging SPY/QQQ."),
        say(bear & leading, "HIGH", "Relative-strength divergence", "Bearish directional thesis, but the ticker is outperforming its benchmarks."),
        say(bull & momentum.isin("NEGATIVE", "ACCELERATING BEARISH"), "HIGH", "Momentum divergence", "Bullish thesis conflicts with deteriorating price momentum."),
        say(bear & momentum.isin("POSITIVE", "ACCELERATING BULLISH"), "HIGH", "Momentum divergence", "Bearish thesis conflicts with improving price momentum."),
        say((F.col("volume_state") == "WEAK") & (F.col("direction").contains("STRONG") | F.col("trend_state").startswith("STRONG")), "MEDIUM", "Participation divergence", "Strong directional move lacks volume confirmation."),
        say(bull & (rsi >= 75), "MEDIUM", "Extension risk", "RSI ", whole(rsi), " is extended despite the bullish thesis."),
        say(bear & (rsi <= 25), "MEDIUM", "Oversold risk", "RSI ", whole(rsi), " is deeply oversold despite the bearish thesis."),
        say(bull & analyst.contains("NEGATIVE"), "MEDIUM", "Analyst divergence", "MktScan is bullish while 30D analyst momentum is ", F.lower(analyst), "."),
        say(bear & analyst.contains("POSITIVE"), "MEDIUM", "Analyst divergence", "MktScan is bearish while 30D analyst momentum is ", F.lower(analyst), "."),
        say(F.col("iv_percentile") >= 85, "MEDIUM", "Volatility pricing risk", "IV is in the ", whole(F.col("iv_percentile")), "th percentile; long premium is historically expensive."),
        say(bull & (F.col("put_skew") >= 8), "MEDIUM", "Options downside hedge demand", "Put skew is elevated (", F.format_string("%+.1f", F.col("put_skew")), "), indicating relatively expensive downside protection."),
        say((bull | bear) & (F.size(against) >= 2), "HIGH", "Cross-signal disagreement", "Opposing signal families: ", F.array_join(against, ", "), "."),
    ]
    return df.withColumn("divergences", F.slice(F.filter(F.array(*found), lambda x: x.isNotNull()), 1, most))


def options_reading(df: DataFrame) -> DataFrame:
    """``df`` (``iv_rank``, ``iv_percentile``, ``term_state``, ``put_skew``, ``call_skew`` in decimals, ``confidence``, ``score``, ``label``) with ``iv_state``, ``skew_state``,
    ``structure_bias`` and ``cautions``.  The score is never altered."""
    level = F.coalesce("iv_percentile", "iv_rank")
    state = F.coalesce(S.iv_state(level), F.lit("UNKNOWN"))
    label = F.upper(F.coalesce("label", F.lit("")))
    bull = F.coalesce(F.col("score") >= 0.20, F.lit(False)) | label.startswith("BULL")
    bear = F.coalesce(F.col("score") <= -0.20, F.lit(False)) | label.startswith("BEAR")
    high, low = state.isin("HIGH", "VERY HIGH"), state.isin("LOW", "VERY LOW")
    way = lambda side: F.when(low, f"{side} debit structure").when(high, f"{side} credit structure").otherwise(f"{side} — structure neutral")
    neutral = F.when(high, "Neutral / premium-selling candidate").when(low, "No clear options edge").otherwise("No strong structure preference")
    p, c = F.col("put_skew") * 100, F.col("call_skew") * 100
    skew = F.when(p.isNull() & c.isNull(), "UNAVAILABLE").when((p >= 4) & (c.isNull() | (p - c >= 3)), "PUT RICH").when((c >= 4) & (p.isNull() | (c - p >= 3)), "CALL RICH").when(p.isNotNull() & c.isNotNull(), "BALANCED").otherwise("INCOMPLETE")
    cautions = [
        F.when(F.col("term_state") == "BACKWARDATION", "Front-end IV is elevated; verify whether earnings or another event sits inside the intended holding period."),
        F.when(level.isNull(), "IV Rank/Percentile is unknown; avoid treating the volatility regime as confirmed."),
        F.when(F.col("confidence") < 0.70, F.concat(F.lit("Options-market data coverage is only "), F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%; interpretation is lower confidence."))),
    ]
    return df.withColumns({"iv_state": state, "skew_state": skew, "structure_bias": F.when(bull, way("Bullish")).when(bear, way("Bearish")).otherwise(neutral), "cautions": F.filter(F.array(*cautions), lambda x: x.isNotNull())})


def decision(df: DataFrame) -> DataFrame:
    """``df`` (of ``technical.setup_quality``, with ``term_state``) with ``status``: READY for a high quality without event risk, AVOID for a low one, else
    WATCH; ``risks`` with that of the term structure, four of them."""
    more = F.when(F.col("term_state") == "BACKWARDATION", F.array(F.lit("Near-term IV is elevated"))).otherwise(F.array().cast("array<string>"))
    every = F.concat("risks", more)
    event = F.exists(every, lambda r: F.lower(r).contains("risk in"))
    status = F.when((F.col("label") == "HIGH") & ~event, "READY").when(F.col("label") != "LOW", "WATCH").otherwise("AVOID")
    return df.withColumn("status", status).withColumn("risks", F.slice(every, 1, 4))
