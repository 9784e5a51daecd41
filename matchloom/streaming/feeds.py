"""Structured Streaming forms of the feed operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.ratings import ELO_K, ELO_START, elo_expected


def trade_candidates(deaths: DataFrame, window_ms: int = 5000, late: str = "1 minute") -> DataFrame:
    """Deaths joined with the deaths of their killers in the same round within the window, as both arrive.

    deaths: a stream of game, round, at (timestamp), victim, killer. Both sides carry a watermark and the join bounds
    their difference, so Spark drops state once no match can follow.
    """
    a = deaths.withWatermark("at", late).select("game", "round", F.col("at").alias("at_a"), F.col("victim").alias("victim_a"), F.col("killer").alias("killer_a"))
    b = deaths.withWatermark("at", late).select(F.col("game").alias("game_b"), F.col("round").alias("round_b"), F.col("at").alias("at_b"), F.col("victim").alias("victim_b"), F.col("killer").alias("avenger"))
    near = F.expr(f"game = game_b and round = round_b and killer_a = victim_b and at_b > at_a and at_b <= at_a + interval {window_ms} milliseconds")
    return a.join(b, near).select("game", "round", "at_a", "victim_a", "killer_a", "at_b", "avenger")


def activity(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of value by event type in tumbling windows of ts; rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def online_elo(series: DataFrame, k: float = ELO_K) -> DataFrame:
    """pool, series, p of a stream of series (pool, series, at, a, b, a_won), ratings carried in the state of each pool.

    A micro-batch's series are rated in the order of at and series; the batches themselves must come in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        ratings = dict(zip(*state.get)) if state.exists else {}
        out = []
        for a, b, won, name in pd.concat(list(batches)).sort_values(["at", "series"])[["a", "b", "a_won", "series"]].itertuples(index=False):
            ra, rb = ratings.get(a, ELO_START), ratings.get(b, ELO_START)
            p = elo_expected(ra, rb)
            ratings[a], ratings[b] = ra + k * (won - p), rb - k * (won - p)
            out.append((key[0], name, p))
        state.update((list(ratings), list(ratings.values())))
        yield pd.DataFrame(out, columns=["pool", "series", "p"])

    return series.groupBy("pool").applyInPandasWithState(step, "pool string, series long, p double", "sides array<long>, ratings array<double>", "append", "NoTimeout")
