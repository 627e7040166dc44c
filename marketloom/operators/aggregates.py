"""Aggregations over articles, analyst events, outcomes and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Weights of news sources; others count 1.
SOURCE_WEIGHTS = {"wsj": 1.5, "reuters": 1.3, "benzinga": 1.2, "finnhub": 1.2, "marketwatch": 1.1, "yahoo": 1.0, "alphav": 1.0, "finviz": 0.9}


def source_weight(source: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv])[source], F.lit(1.0))


def unique_stories(articles: DataFrame) -> DataFrame:
    """One representative of each headline and ticker: the heaviest source, then the first; empty headlines stay."""
    keyed = articles.withColumn("story", S.headline_key(F.col("headline"))).withColumn("story", F.when(F.col("story") == "", F.concat(F.lit("#"), F.col("id"))).otherwise(F.col("story")))
    w = Window.partitionBy("ticker", "story").orderBy(F.desc(source_weight(F.col("source"))), "id")
    return keyed.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def weighted_sentiment(articles: DataFrame) -> DataFrame:
    w = source_weight(F.col("source"))
    s = F.col("sentiment")
    return unique_stories(articles).where(s.isNotNull()).groupBy("ticker").agg((F.sum(s * w) / F.sum(w)).alias("sentiment"), F.count("*").alias("stories"))


def source_breakdown(articles: DataFrame) -> DataFrame:
    """Articles of each source as a map, with outlets and the duplicates that stories collapse."""
    counted = articles.groupBy("ticker", "source").agg(F.count("*").alias("n"))
    return counted.groupBy("ticker").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"), F.count("*").alias("outlets"), F.sum("n").alias("articles"))


def recency_sentiment(articles: DataFrame, as_of: str, tau_hours: float = 48.0) -> DataFrame:
    """Mean weighted by exp(-age / tau); a missing time counts as now."""
    now = F.lit(as_of).cast("timestamp")
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("published_at", now))) / 3600.0
    w = F.exp(-age / tau_hours)
    return articles.where("sentiment is not null").groupBy("ticker").agg(S.clamp(F.sum(F.col("sentiment") * w) / F.sum(w), -1.0, 1.0).alias("recency"))


def _has(text: Column, *words: str) -> Column:
    """Does one of the words stand in the text, in either case?"""
    up = F.upper(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | up.contains(w)
    return out


def analyst_flags(action: Column, target: Column) -> dict[str, Column]:
    return {"upgrades": _has(action, "UPGRADE"), "downgrades": _has(action, "DOWNGRADE"), "raises": _has(target, "RAISE", "INCREASE"), "cuts": _has(target, "LOWER", "DECREASE", "CUT")}


def analyst_event_score(action: Column, target: Column, rating: Column) -> Column:
    f = analyst_flags(action, target)
    base = F.when(f["upgrades"], 2.0).when(f["downgrades"], -2.0).when(_has(action, "INITIAT", "REINST"), 1.5 * S.rating_bias(rating)).otherwise(0.0)
    return base + F.when(f["raises"], 1.0).when(f["cuts"], -1.0).otherwise(0.0)


def momentum_state(score: Column) -> Column:
    return F.when(score >= 4, "STRONGLY POSITIVE").when(score >= 1.5, "POSITIVE").when(score <= -4, "STRONGLY NEGATIVE").when(score <= -1.5, "NEGATIVE").otherwise("NEUTRAL")


def analyst_momentum(events: DataFrame) -> DataFrame:
    flags = analyst_flags(F.col("action_company"), F.col("action_pt"))
    scored = events.withColumn("event_score", analyst_event_score(F.col("action_company"), F.col("action_pt"), F.col("rating_current")))
    return scored.groupBy("ticker").agg(F.sum("event_score").alias("momentum"), *[F.count_if(c).alias(k) for k, c in flags.items()]).withColumn("state", momentum_state(F.col("momentum")))


def resolved(outcomes: DataFrame) -> DataFrame:
    """Return in percent and whether the direction was right (a zero on either side is not)."""
    r = F.round((F.col("outcome_close") / F.col("base_close") - 1) * 100, 4)
    return outcomes.withColumn("actual_return", r).withColumn("direction_correct", F.coalesce(F.signum("score") * F.signum(r) > 0, F.lit(False))).withColumn("magnitude_error", F.abs(r - 3 * F.col("score")))


def accuracy(outcomes: DataFrame) -> DataFrame:
    """Accuracy of each ticker and of all (null ticker) in one pass."""
    o = outcomes.where("actual_return is not null")
    hit, n = F.avg(F.col("direction_correct").cast("double")), F.count("*")
    return o.groupingSets([["ticker"], []], "ticker").agg(
        n.alias("n"), hit.alias("accuracy"), F.sqrt(0.25 / n).alias("standard_error"), (F.abs(hit - 0.5) > 2 * F.sqrt(0.25 / n)).alias("significant"),
        F.avg(F.when(F.col("score") > 0.05, F.col("actual_return"))).alias("bull_return"), F.avg(F.when(F.col("score") < -0.05, F.col("actual_return"))).alias("bear_return"), F.avg("magnitude_error").alias("mean_error"),
    )


def calibration(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("actual_return is not null").withColumn("bucket", S.score_bucket(F.col("score"))).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.avg("actual_return").alias("mean_return"), (F.avg(F.col("direction_correct").cast("double")) * 100).alias("accuracy_pct"))


def trade_metrics(trades: DataFrame) -> DataFrame:
    """Profit, its share of the risk taken; the risk falls back to what was paid."""
    sign = F.when(F.col("entry_type") == "CREDIT", -1).when((F.col("instrument_type") == "STOCK") & (F.col("direction") == "BEARISH"), -1).otherwise(1)
    pnl = (F.col("exit_value") - F.col("entry_value")) * sign * F.col("quantity") * F.col("multiplier")
    risk = F.coalesce("planned_max_loss", F.abs(F.col("entry_value") * F.col("quantity") * F.col("multiplier")))
    return trades.withColumn("pnl", pnl).withColumn("risk", risk).withColumn("return_on_risk", F.when(risk != 0, pnl / risk * 100))


def performance(trades: DataFrame) -> DataFrame:
    """Net, win rate, profit factor (null without losses) and expectancy of closed trades."""
    win, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    return trades.where("status = 'CLOSED'").agg(F.count("*").alias("n"), F.sum("pnl").alias("net"), F.count_if(F.col("pnl") > 0).alias("wins"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.when(loss > 0, win / loss).alias("profit_factor"), F.avg("pnl").alias("expectancy"))


def pnl_curve(trades: DataFrame) -> DataFrame:
    """``id`` and cumulative profit over all closed trades in order of closing day and id; no profit counts as 0.  A
    running sum over the days (one row for each) is added to one within each day; decimals make it exact."""
    day = F.date_add("opened_date", F.col("holding_days").cast("int"))
    closed = trades.where("status = 'CLOSED'").select("id", day.alias("day"), F.coalesce("pnl", F.lit(0.0)).cast("decimal(28,8)").alias("pnl"))
    days = closed.groupBy("day").agg(F.sum("pnl").alias("made"))
    before = days.select("day", (F.sum("made").over(Window.orderBy(F.asc_nulls_last("day")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("made")).alias("before"))
    w = Window.partitionBy("day").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    here = closed.withColumn("within", F.sum("pnl").over(w))
    return here.join(before, here.day.eqNullSafe(before.day)).select("id", (F.col("before") + F.col("within")).cast("double").alias("cumulative"))


def attribution(trades: DataFrame, by: list[str]) -> DataFrame:
    """Trades, profit and mean return on risk by each of several labels, in one pass of grouping sets."""
    named = trades.where("status = 'CLOSED'").withColumns({b: F.coalesce(F.col(b).cast("string"), F.lit("Unknown")) for b in by})
    kind = F.coalesce(*[F.when(F.grouping(b) == 0, F.lit(b)) for b in by])
    label = F.coalesce(*[F.when(F.grouping(b) == 0, F.col(b)) for b in by])
    return named.groupingSets([[b] for b in by], *by).agg(kind.alias("dimension"), label.alias("label"), F.count("*").alias("n"), F.sum("pnl").alias("pnl_sum"), F.avg("return_on_risk").alias("mean_ror")).select("dimension", "label", "n", "pnl_sum", "mean_ror")


def portfolio_risk(trades: DataFrame, threshold: float = 35.0) -> DataFrame:
    risk = trades.where("status = 'OPEN'").groupBy("ticker").agg(F.sum("risk").alias("at_risk"))
    share = F.col("at_risk") / F.sum("at_risk").over(Window.partitionBy()) * 100  # one row for each ticker
    return risk.withColumn("share_pct", share).withColumn("flagged", share >= threshold)


def breadth(panel: DataFrame) -> DataFrame:
    """Share of tickers above their averages and up over 5 and 20 days, by date; each with its own denominator."""
    pct = lambda c: F.avg(c.cast("double")) * 100
    out = panel.groupBy("trade_date").agg(*[pct(F.col("close") > F.col(f"sma_{n}")).alias(f"above_{n}") for n in (20, 50, 200)], *[pct(F.col(f"ret_{n}") > 0).alias(f"up_{n}") for n in (5, 20)], F.count("*").alias("total"), F.count("sma_20").alias("usable"))
    parts = [F.col(c) / 50 - 1 for c in ("above_20", "above_50", "above_200", "up_5", "up_20")]
    n = S.present(parts)
    return out.withColumn("score", F.when(n > 0, sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / n)).withColumn("confidence", F.col("usable") / F.col("total"))


def medians(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``by`` and the exact median (as Spark's) of the known values of each group, of any size: values are counted in bins, 256 for each factor
    e of their size, and only those of the bins in the middle are gathered, equal ones as one.  ``df`` is read twice."""
    v = F.col(value)
    size = F.floor(F.least(F.log(F.abs(v)), F.lit(710.0)) * 256) + 200_000  # over 0 for all but 0; infinite values and NaN come last
    d = df.where(v.isNotNull()).select(*by, value).withColumn("__bin", F.when(v > 0, size).when(v < 0, -size).otherwise(0))
    upto = lambda n, *cols: F.sum(n).over(Window.partitionBy(*by, *cols[:-1]).orderBy(cols[-1]))
    inside = "__upto > (__all - 1) DIV 2 AND __upto - __n <= __all DIV 2"  # the one or two places in the middle
    counts = d.groupBy(*by, "__bin").agg(F.count("*").alias("__n")).withColumns({"__upto": upto("__n", "__bin"), "__all": F.sum("__n").over(Window.partitionBy(*by))})
    middle = counts.where(inside).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__bin").alias("__middle"), (F.col("__upto") - F.col("__n")).alias("__before"), "__all")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("__bin") == F.col("__middle")]
    known = d.join(F.broadcast(middle), same).groupBy(*by, "__bin", value).agg(F.count("*").alias("__n"), F.first("__before").alias("__before"), F.first("__all").alias("__all"))
    known = known.withColumn("__upto", F.col("__before") + upto("__n", "__bin", value)).where(inside)
    return known.groupBy(*by).agg((0.5 * F.min(value) + 0.5 * F.max(value)).alias(name))


def backtest_summary(observations: DataFrame, horizons: tuple[int, ...] = (5, 10, 21, 63)) -> DataFrame:
    """Forward returns by label and holding period, against the mean of all rows of the period.  What is summed up is moved once by itself, as it
    is read three times."""
    given, by = [f"fwd_{h}" for h in horizons], ["label", "holding_days"]
    o = observations.select("label", *given).where(F.coalesce(*given).isNotNull()).repartition(*given)
    long = o.select("label", F.explode(F.array(*[F.struct(F.lit(h).alias("holding_days"), F.col(f"fwd_{h}").alias("r")) for h in horizons])).alias("x")).select("label", "x.*").where("r is not null")
    g = long.groupBy(*by).agg(F.count("*").alias("n"), F.avg("r").alias("mean_return"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.coalesce(F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0)) * F.sqrt(F.lit(252.0) / F.first("holding_days")), F.lit(0.0)).alias("sharpe"), F.max("r").alias("best"), F.min("r").alias("worst"))
    m = medians(long, by, "r", "median_return").select(*[F.col(c).alias(f"__{c}") for c in by], "median_return")
    g = g.join(F.broadcast(m), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]).select(*by, "n", "mean_return", "median_return", "win_rate", "sharpe", "best", "worst")
    every = Window.partitionBy("holding_days")  # one row for each label: the means of all rows follow from theirs
    mean = lambda c: F.sum(F.col(c) * F.col("n")).over(every) / F.sum("n").over(every)
    return g.withColumns({"benchmark_mean": mean("mean_return"), "benchmark_win_rate": mean("win_rate")}).withColumn("excess", F.col("mean_return") - F.col("benchmark_mean"))
