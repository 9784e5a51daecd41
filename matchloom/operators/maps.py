"""Series dynamics, segment states and map-level ratings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.ratings import ELO_START, elo_expected, folded_in_order

#: Fixed values of the map-level rating: its K, and the maps at which a mode's own rating weighs one half.
MAP_K, MODE_MAPS = 16.0, 40.0


def paths(maps: DataFrame, target: int = 3) -> DataFrame:
    """series, path: the results (1 or 0 for the first side) of a series' maps in order, up to where a side has target wins.

    maps: series, ordinal, won. Series that no side has decided are left out.
    """
    w = Window.partitionBy("series").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c.cast("int")).over(w), F.lit(0))
    live = maps.withColumns({"__w": before(F.col("won")), "__l": before(~F.col("won"))}).filter((F.col("__w") < target) & (F.col("__l") < target))
    g = live.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("ordinal", "won"))).alias("m"))
    path = F.array_join(F.transform("m", lambda x: x["won"].cast("int").cast("string")), "")
    wins = F.size(F.filter("m", lambda x: x["won"]))
    return g.filter((wins == target) | (F.size("m") - wins == target)).select("series", path.alias("path"))


def dynamics(series_paths: DataFrame, target: int = 3) -> DataFrame:
    """n, sweeps, deciders, reverse_sweeps and first_map (series won by the winner of the first map)."""
    p, n = F.col("path"), F.length("path")
    won = F.substring(p, -1, 1)
    reverse = (n == 2 * target - 1) & (F.length(F.regexp_replace(F.substring(p, 1, target - 1), won, "")) == target - 1)
    return series_paths.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(n == target).alias("sweeps"), F.count_if(n == 2 * target - 1).alias("deciders"), F.count_if(reverse).alias("reverse_sweeps"),
        F.count_if(F.substring(p, 1, 1) == won).alias("first_map"),
    )


def series_probability(maps_p: list[Column], target: int = 3) -> Column:
    """The probability that the first side is first to target wins, from its probability on each of 2 * target - 1 maps.

    Maps are independent; the series is carried as the probabilities of 0, 1, ... wins so far, as if all maps were played.
    """
    wins = [F.lit(1.0)]
    for p in maps_p:
        wins = [(wins[n] * (1 - p) if n < len(wins) else F.lit(0.0)) + (wins[n - 1] * p if n else F.lit(0.0)) for n in range(len(wins) + 1)]
    return sum(wins[target + 1 :], wins[target])


def hill_cell(own: Column, other: Column) -> tuple[Column, Column]:
    """A coarse state of a hill map: the own score in quarters of a hundred up to 10, and the lead in steps of 20, half even."""
    lead = F.least(F.greatest(own - other, F.lit(-100)), F.lit(100))
    return F.least(F.floor(own / 25), F.lit(10)).cast("int"), F.bround(lead / 20, 0).cast("int")


def map_elo(maps: DataFrame) -> DataFrame:
    """pool, map, p_all, p_mode, p: forecasts by one rating, by the mode's own, and blended by the mode's maps so far.

    maps: pool, map, at, mode, a, b, a_won. Both ratings move by their own error.
    """

    def step(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for pool, key, mode, a, b, won in rows[["pool", "map", "mode", "a", "b", "a_won"]].itertuples(index=False):
            get = lambda *k: state.get(k, ELO_START)
            p_all, p_mode = elo_expected(get(a), get(b)), elo_expected(get(a, mode), get(b, mode))
            seen = min(state.get(("n", a, mode), 0), state.get(("n", b, mode), 0))
            share = seen / (seen + MODE_MAPS)
            out.append((pool, key, p_all, p_mode, share * p_mode + (1 - share) * p_all))
            for keys, p in (((a,), (b,)), p_all), (((a, mode), (b, mode)), p_mode):
                shift = MAP_K * (float(won) - p)
                state[keys[0]], state[keys[1]] = get(*keys[0]) + shift, get(*keys[1]) - shift
            for side in (a, b):
                state[("n", side, mode)] = state.get(("n", side, mode), 0) + 1
        return pd.DataFrame(out, columns=["pool", "map", "p_all", "p_mode", "p"])

    kinds = dict(maps.dtypes)
    return folded_in_order(maps.filter("a_won is not null"), "pool", ["at", "map"], step, f"pool {kinds['pool']}, map {kinds['map']}, p_all double, p_mode double, p double")
