"""Skills of players by the maps their sides won, and whether sides are better at some modes than chance would make them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.maps import MAP_K
from matchloom.operators.ratings import ELO_START, elo_expected, folded_in_order
from matchloom.operators.resample import draw, draws, unit_number

#: Fixed values of the Plackett-Luce rating: first mean and deviation, spread of a map's result, growth of a deviation
#: before a map, and the least share of a variance that a map leaves.
SKILL_MEAN, SKILL_DEVIATION = 25.0, 25.0 / 3
RESULT_SPREAD, DRIFT, LEAST_LEFT = 25.0 / 6, 25.0 / 300, 0.0001
#: Maps from which a player's season is reported.
SEASON_MAPS = 8
#: Maps from which a side's mode counts, cells a draw must have, and draws of the null.
MODE_MAPS, LEAST_CELLS, PERMUTATIONS = 25, 10, 300
#: Draws of the null that are folded together.
BLOCK = 101


def plackett_luce(winners: list[tuple[float, float]], losers: list[tuple[float, float]]) -> tuple[list[tuple[float, float]], list[tuple[float, float]], float]:
    """The (mean, deviation) of both sides' players after a map, and the chance that the winners had before it.

    A side is the sum of its players. Each player's mean moves by their share of their side's variance, their deviation shrinks by it.
    """
    chance = _chance(winners, losers)
    grown = [[(m, math.sqrt(s * s + DRIFT * DRIFT)) for m, s in side] for side in (winners, losers)]
    mean, variance = [sum(m for m, _ in side) for side in grown], [sum(s * s for _, s in side) for side in grown]
    scale = math.sqrt(sum(variance) + 2 * RESULT_SPREAD**2)
    won = 1 / (1 + math.exp((mean[1] - mean[0]) / scale))
    out = []
    for side, v, push in zip(grown, variance, (1 - won, won - 1)):
        shrink = math.sqrt(v) / scale * v / scale**2 * won * (1 - won)
        out.append([(m + s * s / v * (v / scale) * push, s * math.sqrt(max(1 - s * s / v * shrink, LEAST_LEFT))) for m, s in side])
    return out[0], out[1], chance


def _chance(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """The chance that side a wins: the normal distribution of the sides' difference and all players' result spread."""
    variance = (len(a) + len(b)) * RESULT_SPREAD**2 + sum(s * s for _, s in (*a, *b))
    return 0.5 * (1 + math.erf((sum(m for m, _ in a) - sum(m for m, _ in b)) / math.sqrt(2 * variance)))


def skill_ratings(maps: DataFrame) -> DataFrame:
    """pool, map, season, p, a_won, player, mean, deviation: every player's skill after each map, and side a's chance before it.

    maps: pool, map, at, season, a_players, b_players, a_won (null: left out), folded in the order of at and map within each pool; a map updates all of its
    players at once, from the skills that earlier maps left.
    """

    def step(skills: dict, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for pool, key, season, a, b, won in rows[["pool", "map", "season", "a_players", "b_players", "a_won"]].itertuples(index=False):
            a, b = sorted(set(a)), sorted(set(b))
            sides = [[skills.get(p, (SKILL_MEAN, SKILL_DEVIATION)) for p in side] for side in (a, b)]
            if won:
                one, two, p = plackett_luce(sides[0], sides[1])
            else:
                two, one, q = plackett_luce(sides[1], sides[0])
                p = 1 - q
            for player, skill in zip((*a, *b), (*one, *two)):
                skills[player] = skill
                out.append((pool, key, season, p, bool(won), player, *skill))
        return pd.DataFrame(out, columns=["pool", "map", "season", "p", "a_won", "player", "mean", "deviation"])

    kinds = dict(maps.dtypes)
    schema = f"pool {kinds['pool']}, map {kinds['map']}, season {kinds['season']}, p double, a_won boolean, player {kinds['a_players'][6:-1]}, mean double, deviation double"
    usable = maps.filter("a_won is not null and size(a_players) > 0 and size(b_players) > 0")
    return folded_in_order(usable, "pool", ["at", "map"], step, schema)


def season_skills(rated: DataFrame, order: DataFrame) -> DataFrame:
    """pool, player, season, maps, ordinal: the mean less three deviations after a season's last map, for seasons of at least SEASON_MAPS maps.

    order: map, at.
    """
    met = rated.join(order.select("map", "at"), "map")
    last = F.max_by(F.col("mean") - 3 * F.col("deviation"), F.struct("at", "map"))
    return met.groupBy("pool", "player", "season").agg(F.count(F.lit(1)).alias("maps"), last.alias("ordinal")).filter(F.col("maps") >= SEASON_MAPS)


def permuted_modes(maps: DataFrame, event: str, permutations: int = PERMUTATIONS) -> DataFrame:
    """The maps once for each replicate (0: as played), with the modes of an event's maps dealt anew among them.

    A replicate's order is that of draws from the map's key and the replicate's number, so it depends on contents alone: the mode of the map
    that is nth as played goes to the map that is nth as drawn.
    """
    draws = maps.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    group = Window.partitionBy("pool", event, "replicate")
    digest = F.when(F.col("replicate") == 0, 0).otherwise(draw(unit_number(F.col("map")), F.col("replicate").cast("long")))
    placed = draws.withColumns({"played": F.row_number().over(group.orderBy("at", "map")), "drawn": F.row_number().over(group.orderBy(digest, "at", "map"))})
    dealt = placed.select("pool", event, "replicate", F.col("played").alias("drawn"), F.col("mode").alias("dealt"))
    return placed.join(dealt, ["pool", event, "replicate", "drawn"]).select(*maps.columns, "replicate", "dealt")


def dealt_modes(maps: DataFrame, event: str, kinds: list, permutations: int = PERMUTATIONS) -> DataFrame:
    """pool, block, at, map, a, b, a_won, modes: the modes that permuted_modes() gives a map in the BLOCK replicates of a block, as places in kinds of two bytes each.

    A task deals an event's modes in the replicates of one block, so a map is a row a block and not one a replicate. kinds: the different modes.
    """

    def deal(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("played")
        codes = pc.index_in(rows["mode"].combine_chunks(), pa.array(kinds, rows["mode"].type)).to_numpy(zero_copy_only=False).astype(np.uint16)
        numbers, first = rows["number"].to_numpy(), rows["block"][0].as_py() * BLOCK
        dealt = np.empty((len(codes), min(BLOCK, permutations + 1 - first)), np.uint16)
        for d in range(dealt.shape[1]):
            order = np.argsort(draws(numbers, np.array([first + d]))[:, 0], kind="stable") if first + d else np.arange(len(codes))
            dealt[order, d] = codes
        return rows.select(["pool", "block", "at", "map", "a", "b", "a_won"]).append_column("modes", pa.array([row.tobytes() for row in dealt], pa.binary()))

    types = dict(maps.dtypes)
    played = F.row_number().over(Window.partitionBy("pool", event).orderBy("at", "map")).alias("played")
    rows = maps.filter(F.col("pool").isNotNull() & F.col(event).isNotNull()).select("pool", F.col(event).alias("event"), "at", "map", "mode", "a", "b", "a_won", played, unit_number(F.col("map")).alias("number"))
    each = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(permutations // BLOCK))))
    return each.groupBy("pool", "event", "block").applyInArrow(deal, f"pool {types['pool']}, block int, at {types['at']}, map {types['map']}, a {types['a']}, b {types['b']}, a_won {types['a_won']}, modes binary")


def mode_cells(dealt: DataFrame, kinds: list, kind: str, parts: int) -> DataFrame:
    """pool, block, draw, side, mode, n, lead: by replicate, the maps of each side and mode, and how far its own rating there ends above its rating over all modes.

    dealt: dealt_modes(); kind: the type of a mode; parts: the tasks over which pools and blocks are dealt. A pool and block is folded in its order, all of its replicates at
    once; the ratings are those of map_elo(), of which the one over all modes is the same in each.
    """

    def ended(pool: object, block: int, plain: dict, own: dict) -> pd.DataFrame:
        rows = []
        for side, (ratings, counts) in own.items():
            for at in np.flatnonzero(counts):
                rows.append((pool, block, int(at // len(kinds)), side, kinds[at % len(kinds)], int(counts[at]), float(ratings[at] - plain[side])))
        return pd.DataFrame(rows, columns=["pool", "block", "draw", "side", "mode", "n", "lead"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, plain, own, started = None, {}, {}, False
        for batch in batches:
            for pool, block, modes, a, b, won in batch[["pool", "block", "modes", "a", "b", "a_won"]].itertuples(index=False):
                if not started or (pool, block) != key:
                    if started:
                        yield ended(*key, plain, own)
                    key, plain, own, started = (pool, block), {}, {}, True
                    starts = np.arange(len(modes) // 2) * len(kinds)
                at = starts + np.frombuffer(modes, np.uint16)
                for side in (a, b):
                    if side not in own:
                        own[side] = np.full(len(starts) * len(kinds), ELO_START), np.zeros(len(starts) * len(kinds), dtype=np.int64)
                shift = MAP_K * (float(won) - elo_expected(plain.get(a, ELO_START), plain.get(b, ELO_START)))
                plain[a], plain[b] = plain.get(a, ELO_START) + shift, plain.get(b, ELO_START) - shift
                (ra, na), (rb, nb) = own[a], own[b]
                own_a, own_b = ra[at], rb[at]
                shifts = MAP_K * (float(won) - elo_expected(own_a, own_b))
                if ra is not rb:
                    ra[at], rb[at] = own_a + shifts, own_b - shifts
                na[at] += 1
                nb[at] += 1
        if started:
            yield ended(*key, plain, own)

    types = dict(dealt.dtypes)
    rated = dealt.repartition(parts, "pool", "block").sortWithinPartitions("pool", "block", "at", "map")
    return rated.select("pool", "block", "modes", "a", "b", "a_won").mapInPandas(fold, f"pool {types['pool']}, block int, draw int, side {types['a']}, mode {kind}, n long, lead double")


def mode_null(maps: DataFrame, event: str, permutations: int = PERMUTATIONS, least: int = MODE_MAPS) -> DataFrame:
    """pool, cells, observed, draws, null_mean, null_low, null_high, p_value, exceeds: whether sides differ by mode beyond chance.

    The statistic is the sample deviation, over sides and modes of at least so many maps, of the mode's rating less the side's own. The null deals the modes of each
    event's maps anew, which keeps sides, opponents, results, dates and the event's mix; each draw qualifies its own cells, and one of fewer than
    LEAST_CELLS has no say. A block of BLOCK draws is a key beside the pool, so draws are folded side by side. p_value counts the observed value among its draws.
    Pools whose own maps have too few cells, or no usable draw, are left out.
    """
    rated = maps.filter("a_won is not null")
    kinds = [r["mode"] for r in rated.select("mode").distinct().orderBy("mode").collect()]  # a catalogue
    groups = rated.select("pool").distinct().count() * (permutations // BLOCK + 1)
    folded = mode_cells(dealt_modes(rated, event, kinds, permutations), kinds, dict(maps.dtypes)["mode"], min(4 * groups + 1, 1000))
    cells = folded.filter(F.col("n") >= least).withColumn("replicate", F.col("block") * BLOCK + F.col("draw"))
    spread = cells.groupBy("pool", "replicate").agg(F.count(F.lit(1)).alias("cells"), F.stddev_samp("lead").alias("sd")).filter(F.col("cells") >= LEAST_CELLS)
    own = spread.filter("replicate = 0").select("pool", "cells", F.col("sd").alias("observed"))
    null = spread.filter("replicate > 0").select("pool", "sd").join(own, "pool")
    pct = lambda q: F.percentile("sd", q)
    out = null.groupBy("pool", "cells", "observed").agg(
        F.count(F.lit(1)).alias("draws"), F.avg("sd").alias("null_mean"), pct(0.025).alias("null_low"), pct(0.975).alias("null_high"), ((F.count_if(F.col("sd") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value")
    )
    return out.withColumn("exceeds", F.col("observed") > F.col("null_high"))
