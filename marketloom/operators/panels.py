"""Panels: wide downloads to long ones, and the dates of many tickers laid side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a download.
FIELDS = ("Open", "High", "Low", "Close", "Volume")


def long_panel(wide: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS, separator: str = "|", ticker: str | None = None) -> DataFrame:
    """``keys``, ``ticker`` and a column for each field (lower case) from a wide table whose columns are named ``field|ticker`` or
    ``ticker|field``, mixed or not, or by a field alone (then of ``ticker``).  Values that are no finite numbers are null; rows
    with no value at all go, as do columns that name no field."""
    names = {f.lower(): f for f in fields}
    parsed = {}
    for column in wide.columns:
        if column in keys:
            continue
        parts = column.split(separator)
        if len(parts) == 1 and parts[0].lower() in names and ticker is not None:
            parsed[column] = (parts[0].lower(), ticker)
        elif len(parts) == 2:
            a, b = parts
            if a.lower() in names:
                parsed[column] = (a.lower(), b)
            elif b.lower() in names:
                parsed[column] = (b.lower(), a)
    seen: dict[str, dict[str, str]] = {}
    for column, (field, name) in parsed.items():
        seen.setdefault(name, {})[field] = column

    def number(column: str | None):
        if column is None:
            return F.lit(None).cast("double")
        x = F.col(f"`{column}`").cast("string").try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

    one = lambda name: F.struct(F.lit(name).alias("ticker"), *[number(seen[name].get(f)).alias(f) for f in names])
    if not seen:
        return wide.select(*keys, F.lit("").alias("ticker"), *[F.lit(None).cast("double").alias(f) for f in names]).limit(0)
    # one pass: each row becomes a row for each ticker, no shuffle
    long = wide.select(*keys, F.explode(F.array(*[one(n) for n in seen])).alias("x")).select(*keys, "x.*")
    return long.where(" OR ".join(f"`{f}` IS NOT NULL" for f in names))


def aligned(bars: DataFrame, date: str = "trade_date") -> DataFrame:
    """A calendar of all dates (numbered from 0) and, for every ticker and every date from its first to its last, ``place``: the number
    of the ticker's own bar there (from 0), null in its gaps."""
    dates = bars.select(date).distinct()
    calendar = dates.withColumn("date_no", F.row_number().over(Window.orderBy(date)) - 1)  # one ordered series: a row for each day
    own = bars.select("ticker", date).join(calendar, date).withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy("date_no")) - 1)
    spans = own.groupBy("ticker").agg(F.min("date_no").alias("lo"), F.max("date_no").alias("hi")).select("ticker", F.explode(F.sequence("lo", "hi")).alias("date_no"))
    return spans.join(own.select("ticker", "date_no", "place"), ["ticker", "date_no"], "left").join(calendar, "date_no").select("date_no", date, "ticker", "place")
