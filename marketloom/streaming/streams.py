"""Incremental forms.  Each takes and returns a streaming DataFrame; on a batch DataFrame it gives the final result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, grain: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and volume of tumbling windows."""
    order = F.struct("ts", "event_id")
    out = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", grain)).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
    return out.select("ticker", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def sentiment(articles: DataFrame, span: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Mean sentiment over sliding windows."""
    out = articles.where("sentiment is not null").withWatermark("published_at", span).groupBy("ticker", F.window("published_at", span, slide)).agg(F.avg("sentiment").alias("sentiment"), F.count("*").alias("n"))
    return out.select("ticker", F.col("window.start").alias("start"), "sentiment", "n")


def activity(events: DataFrame, gap: str = "30 minutes", key: str = "ticker", late: str = "1 hour") -> DataFrame:
    """Bursts separated by gaps."""
    out = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def dedupe(articles: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """One row of each key while its watermark lasts; join the stored table with ``insert_new`` for older ones."""
    return articles.withWatermark("published_at", late).dropDuplicatesWithinWatermark(keys)


def alerts(scores: DataFrame, session: str = "1 day", bull: float = 0.6, bear: float = -0.3) -> DataFrame:
    """One alert for a ticker, direction and session, at the first score that fires."""
    direction = F.when(F.col("score") >= bull, "BULLISH").when(F.col("score") <= bear, "BEARISH")
    fired = scores.withColumn("direction", direction).where("direction is not null").withWatermark("at", session)
    return fired.groupBy("ticker", "direction", F.window("at", session)).agg(F.min("at").alias("first_at"), F.count("*").alias("fired")).select("ticker", "direction", F.col("window.start").alias("session"), "first_at", "fired")
