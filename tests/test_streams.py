"""The streaming forms on a file stream, against the same forms on the whole table."""

import os

import pytest
from pyspark.sql import functions as F

from marketloom.sources.fixtures import table
from marketloom.streaming import pending
from marketloom.streaming import streams as X

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def stream(spark, df, path, order):
    """``df`` as three files, the rows of one after those of the other, read one at a time."""
    cuts = df.approxQuantile("__n", [0.33, 0.66], 0.0)
    part = F.when(F.col("__n") <= cuts[0], 0).when(F.col("__n") <= cuts[1], 1).otherwise(2)
    df = df.withColumn("__part", part)
    for k in range(3):
        df.where(F.col("__part") == k).drop("__n", "__part").orderBy(order).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("__n", "__part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df, name, path, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return sorted(tuple(r) for r in df.sparkSession.table(name).collect())


def numbered(df, at):
    return df.withColumn("__n", F.unix_timestamp(at).cast("double")).where("__n IS NOT NULL")


@pytest.mark.parametrize("name", ["bars", "activity", "alerts"])
def test_stream_gives_the_batch_result(spark, tmp_path, name):
    ticks = table(spark, DATA, "ticks").withColumn("ts", F.col("ts").cast("timestamp"))
    if name == "alerts":
        ticks = ticks.select("ticker", F.col("ts").alias("at"), ((F.col("event_id") % 201 - 100) / 100.0).alias("score"))
    at, form = ("at", X.alerts) if name == "alerts" else ("ts", getattr(X, name))
    source = stream(spark, numbered(ticks, at), str(tmp_path / "in"), at)
    assert drained(form(source), f"s_{name}", str(tmp_path / "state"), "complete") == sorted(tuple(r) for r in form(ticks).collect())


def test_rolling_sentiment(spark, tmp_path):
    articles = table(spark, DATA, "articles").select("id", "ticker", "sentiment", F.col("published_at").cast("timestamp").alias("published_at")).where("published_at IS NOT NULL")
    source = stream(spark, numbered(articles, "published_at"), str(tmp_path / "in"), "published_at")
    got = drained(X.sentiment(source), "s_sentiment", str(tmp_path / "state"), "complete")
    want = sorted(tuple(r) for r in X.sentiment(articles).collect())
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_story_dedup_across_batches(spark, tmp_path):
    articles = table(spark, DATA, "articles").select("id", "ticker", "url", F.col("published_at").cast("timestamp").alias("published_at")).where("url IS NOT NULL AND published_at IS NOT NULL")
    twice = articles.unionByName(articles.withColumn("id", F.col("id") + 100_000).withColumn("published_at", F.expr("published_at + INTERVAL 1 HOUR")))
    source = stream(spark, numbered(twice, "published_at"), str(tmp_path / "in"), "published_at")
    got = drained(X.dedupe(source, ["ticker", "url"], "3650 days").select("ticker", "url"), "s_dedupe", str(tmp_path / "state"), "append")
    assert got == sorted(tuple(r) for r in articles.select("ticker", "url").distinct().collect())


def test_late_rows_go_aside(spark, tmp_path):
    """Rows older than a day before the newest of the batches before; a batch that is run again replaces what it wrote."""
    files = [[(1, "2024-01-10 00:00:00")], [(2, "2024-01-12 00:00:00"), (3, "2024-01-08 23:59:59"), (4, "2024-01-09 00:00:00")], [(5, "2024-01-10 12:00:00"), (6, None), (7, "2024-01-11 00:00:00")]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "id int, at string").select("id", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # one file at a time, in the order in which they came
    source = spark.readStream.schema("id int, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = pending.split_late(f"{tmp_path}/mark", f"{tmp_path}/out", f"{tmp_path}/late", "at", "1 DAY")
    q = source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    ids = lambda name: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
    assert ids("late") == [3, 5] and ids("out") == [1, 2, 4, 6, 7]
    sink(spark.createDataFrame([(9, "2024-01-01 00:00:00")], "id int, at string").select("id", F.col("at").cast("timestamp").alias("at")), 2)
    assert ids("late") == [3, 9] and ids("out") == [1, 2, 4]


def test_large_parts_lie_in_several_files(spark, tmp_path, monkeypatch):
    """A part is a batch whatever its number of files, and its rows are worked out over many tasks."""
    monkeypatch.setattr(pending, "FILE_ROWS", 60)
    df = spark.range(0, 1000, 1, 4).select("id", F.timestamp_seconds("id").alias("at"))
    s = pending.as_stream(df, "at", f"{tmp_path}/in")
    assert len([f for f in os.listdir(f"{tmp_path}/in") if f.endswith(".parquet")]) == 16
    batches = []
    q = s.writeStream.foreachBatch(lambda b, n: batches.append(sorted(r.id for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert len(batches) == 4 and [x for b in batches for x in b] == list(range(1000))
