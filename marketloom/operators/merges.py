"""Keyed merges of a batch of events into a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source", "name"]


def merge_calendar(stored: DataFrame, new: DataFrame, values: list[str]) -> DataFrame:
    """``stored`` after ``new`` (``source``, ``name``, ``event_at``, ``seq`` and ``values``; the last ``seq`` of a key and time counts) is merged in: a new event
    overwrites the stored one of its source, name and time; what then is left over of both is matched by source,
    name and day, in the order of their times, each row once, and moves the stored one's time; the rest is added.
    Events without a name or time are passed over.  ``id`` is null for rows that were added."""
    usable = new.where("trim(name) <> '' AND event_at IS NOT NULL").withColumn("name", F.trim("name")).withColumn("source", F.coalesce("source", F.lit("marketwatch")))
    last = usable.groupBy(*KEY, "event_at").agg(F.max_by(F.struct(*values), "seq").alias("v"))
    old = stored.select("id", *KEY, "event_at", F.struct(*values).alias("v"))
    # exact keys: one pass over both sides, the stored row of a key and time with the least id takes the update
    rank = F.row_number().over(Window.partitionBy(*KEY, "event_at").orderBy("id"))
    exact = old.withColumn("k", rank).join(last.select(*KEY, "event_at", F.col("v").alias("w")).withColumn("k", F.lit(1)), [*KEY, "event_at", "k"], "full")
    done = exact.where("id IS NOT NULL AND w IS NOT NULL").select("id", *KEY, "event_at", F.col("w").alias("v"))
    # the rest: the n-th stored row of a day with the n-th new one
    day = F.to_date("event_at").alias("day")
    nth = F.row_number().over(Window.partitionBy(*KEY, "day").orderBy("event_at", "k", "id"))
    kept = exact.where("w IS NULL").select("id", *KEY, "event_at", "v", "k", day).withColumn("n", nth)
    came = exact.where("id IS NULL").select("id", *KEY, F.col("event_at").alias("new_at"), F.col("w"), "event_at", "k", day).withColumn("n", nth).select(*KEY, "day", "n", "new_at", "w")
    rest = kept.select("id", *KEY, "day", "n", "event_at", "v").join(came, [*KEY, "day", "n"], "full")
    moved = rest.select("id", *KEY, F.coalesce("new_at", "event_at").alias("event_at"), F.coalesce("w", "v").alias("v"))
    return done.unionByName(moved).select("id", *KEY, "event_at", "v.*")


def merge_companies(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` (``ticker``, ``name``, ``sector``, ``keywords``) after the rows of ``new`` in the order of their ``seq``: the last name counts, and the last
    sector and keywords that are not empty; where none is, what is stored stays.  Companies that are not stored are added.
    A ticker's new rows are put together before they meet the stored ones, so one that is listed often does not weigh."""
    last = lambda c: F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("seq")))
    n = new.groupBy("ticker").agg(F.max_by("name", "seq").alias("new_name"), last("sector").alias("new_sector"), last("keywords").alias("new_keywords"), F.lit(True).alias("came"))
    both = stored.join(n, "ticker", "full")
    filled = lambda c: F.coalesce(f"new_{c}", c, F.lit("")).alias(c)
    return both.select("ticker", F.when(F.col("came"), F.col("new_name")).otherwise(F.col("name")).alias("name"), filled("sector"), filled("keywords"))
