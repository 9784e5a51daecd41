"""Streams over Parquet files, run to their end."""

import datetime as dt

from pyspark.sql import functions as F

from matchloom.operators import ratings
from matchloom.streaming import feeds


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def stream(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_trades_arrive_within_the_window(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, 1, t(1), 1, 5), (1, 1, t(4), 5, 2), (1, 1, t(30), 2, 6), (1, 1, t(40), 6, 3)]
    df = spark.createDataFrame(rows, "game int, round int, at timestamp, victim int, killer int")
    got = run(feeds.trade_candidates(stream(spark, df, f"{tmp_path}/d")), "trades")
    assert [(r.victim_a, r.killer_a, r.avenger) for r in got] == [(1, 5, 2)]


def test_windowed_counts(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "click", 1.0) for m in (1, 2, 7, 8, 9)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    got = run(feeds.activity(stream(spark, df, f"{tmp_path}/e")), "activity", "complete")
    assert sorted((r.start.minute, r.n, r.total) for r in got) == [(0, 2, 2.0), (5, 3, 3.0)]


def test_stateful_ratings_agree_with_the_batch(spark, tmp_path):
    rows = [("x", i, i, i % 3, (i + 1) % 3, i % 2 == 0) for i in range(30)]
    df = spark.createDataFrame(rows, "pool string, series long, at long, a long, b long, a_won boolean")
    got = run(feeds.online_elo(stream(spark, df, f"{tmp_path}/s")), "elo")
    want = {r.series: round(r.p, 9) for r in ratings.elo(df).select("series", F.col("p")).collect()}
    assert {r.series: round(r.p, 9) for r in got} == want
