"""Streams with state of their own, and replays of stored rows as streams."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Expected move in percent of a score of 1.
IMPLIED_MOVE = 3.0
_STATE = "dates array<bigint>, closes array<double>, asked array<bigint>, scores array<double>, horizons array<int>"
_OUT = "ticker {kind}, prediction_date date, score double, outcome_date date, actual_return_pct double, direction_correct boolean, magnitude_error double"
DAY = 86_400_000


def resolve_pending(predictions: DataFrame, closes: DataFrame, late: str = "3 days") -> DataFrame:
    """Streams of predictions (``ticker``, ``prediction_date``, ``score``, ``horizon_days``) and of closes (``ticker``, ``trade_date``, ``close``) to outcomes: the
    return from the last close at or before the prediction to the ``horizon_days``-th close after it.

    A prediction is resolved once, when the watermark has passed that close, so closes that come out of order (by less
    than ``late``) count in their place, and later ones never rewrite an outcome.  A ticker's state holds its open
    predictions and the closes that they may need, so it is bounded by horizon and lateness."""
    kind = predictions.schema["ticker"].dataType.simpleString()
    at = lambda c: F.col(c).cast("timestamp").alias("at")
    p = predictions.select("ticker", at("prediction_date"), F.lit(0).alias("what"), F.col("score").cast("double").alias("value"), F.col("horizon_days").cast("int").alias("horizon"))
    c = closes.select("ticker", at("trade_date"), F.lit(1).alias("what"), F.col("close").cast("double").alias("value"), F.lit(0).alias("horizon"))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dates, prices, asked, scores, horizons = (list(x) for x in state.get) if state.exists else ([], [], [], [], [])
        price = dict(zip(dates, prices, strict=True))
        waiting = list(zip(asked, scores, horizons, strict=True))
        for part in parts:
            for t, what, value, horizon in zip(part["at"].astype("datetime64[ms]").astype("int64"), part["what"], part["value"], part["horizon"], strict=True):
                if what:
                    price.setdefault(int(t), float(value))  # what came first stays
                else:
                    waiting.append((int(t), float(value), int(horizon)))
        mark = state.getCurrentWatermarkMs()
        days, out, left, due = sorted(price), [], [], []
        for t, score, horizon in waiting:
            here = bisect_right(days, t)
            base, ahead = days[max(0, here - 1) : here], days[here : here + horizon]
            if not base and mark > t:
                continue  # no earlier close can come any more
            if base and len(ahead) == horizon and ahead[-1] <= mark:
                move = (price[ahead[-1]] / price[base[-1]] - 1) * 100 if price[base[-1]] > 0 else None
                if move is not None:
                    out.append((key[0], pd.Timestamp(t, unit="ms").date(), score, pd.Timestamp(ahead[-1], unit="ms").date(), round(move, 4), score * move > 0, round(abs(score * IMPLIED_MOVE - move), 4)))
                continue
            left.append((t, score, horizon))
            if base and len(ahead) == horizon:
                due.append(ahead[-1])
        # closes from the last one before whatever may still be asked for
        oldest = min([t for t, _, _ in left] + [mark])
        first = max([d for d in days if d <= oldest], default=0)
        kept = [d for d in days if d >= first]
        state.update((kept, [price[d] for d in kept], [x[0] for x in left], [x[1] for x in left], [x[2] for x in left]))
        if due:
            state.setTimeoutTimestamp(max(min(due), mark + 1))
        if out:
            yield pd.DataFrame(out, columns=["ticker", "prediction_date", "score", "outcome_date", "actual_return_pct", "direction_correct", "magnitude_error"])

    both = p.unionByName(c).withWatermark("at", late)
    return both.groupBy("ticker").applyInPandasWithState(run, _OUT.format(kind=kind), _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def in_session(ts: Column, holidays: tuple[str, ...] = ()) -> Column:
    """Whether a UTC time is in a New York session: a weekday, no holiday, from 9:30 up to 16:00."""
    local = F.from_utc_timestamp(ts, "America/New_York")
    minute = F.hour(local) * 60 + F.minute(local)
    closed = F.to_date(local).isin([F.lit(h).cast("date") for h in holidays]) if holidays else F.lit(False)
    return (F.weekday(local) < 5) & (minute >= 570) & (minute < 960) & ~closed


def with_daily_context(live: DataFrame, daily: DataFrame) -> DataFrame:
    """Live rows with what is known of their ticker from the last daily bar (``prev_close``, ``avg_volume``) and the change since; a
    stream is joined with the table as it stands at each batch."""
    return live.join(daily, "ticker", "left").withColumn("change_pct", F.when(F.col("prev_close") != 0, (F.col("price") / F.col("prev_close") - 1) * 100))


def split_late(mark_path: str, out_path: str, late_path: str, at: str, lookback: str):
    """A ``foreachBatch`` sink: rows older than ``lookback`` before the newest time seen in earlier batches go to ``late_path``, the others to
    ``out_path``; each batch writes its own folders, so one that is run again replaces what it wrote."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = spark.read.schema("number bigint, newest timestamp").parquet(mark_path) if number else None
        newest = marks.where(F.col("number") < number).agg(F.max("newest")).first()[0] if marks is not None else None
        late = F.lit(False) if newest is None else F.coalesce(F.col(at) < F.lit(newest) - F.expr(f"INTERVAL {lookback}"), F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        batch.where(late).write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        batch.agg(F.lit(number).cast("bigint").alias("number"), F.max(at).cast("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{mark_path}/batch={number}")

    return sink


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares (``spark.checkpoint.dir``); a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{named}/stream-{uuid.uuid4().hex}"


#: Rows of a file of a stream, at least, where a part has several.
FILE_ROWS = 250_000


def as_stream(df: DataFrame, at: str, path: str, files: int = 4) -> DataFrame:
    """``df`` as a file stream: its rows in ``files`` parts of time, one part a batch.  ``df`` is worked out once, over all tasks, and
    parted as it lies there; large parts have several files, as many in each, so that a batch is a part."""
    spark = df.sparkSession
    df.write.parquet(f"{path}-whole")
    whole = spark.read.schema(df.schema).parquet(f"{path}-whole")
    number = F.unix_timestamp(F.col(at).cast("timestamp"))
    cuts = whole.select(number.cast("double").alias("n")).approxQuantile("n", [k / files for k in range(1, files)], 0.001)
    part = sum(((number > c).cast("int") for c in cuts), F.lit(0))
    sizes = dict(whole.groupBy(part.alias("part")).count().collect())  # a number a part
    each = max(1, min(sizes.get(k, 0) for k in range(files)) // FILE_ROWS)
    for k in range(files):
        rows = whole.where(part == k)
        (rows.repartition(each) if each > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """What a stream gives once all its input is read, as a table."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
