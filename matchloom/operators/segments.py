"""Maps as sequences of segments: rounds, or hills with running scores; what a state is worth beside a race without memory."""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.maps import hill_cell

#: Kinds of segments, the rounds that win a map of a kind, the points that win a hill map, and the points by which gains are binned.
ROUNDS, HILL = {"snd_round": 6, "control_round": 3}, "hill"
HILL_TARGET, GAIN = 250, 5
#: What is added to a cell's wins, and twice to its number.
LAPLACE = 0.5


def target(kind: Column) -> Column:
    """The rounds or points that win a map."""
    out = F.lit(HILL_TARGET)
    for name, rounds in ROUNDS.items():
        out = F.when(kind == name, rounds).otherwise(out)
    return out


def loaded(segments: DataFrame, maps: DataFrame) -> DataFrame:
    """game, kind, reason, season, event, won, dropped, steps: a row per map of segments, whether it can be used or why not.

    segments: game, kind, ordinal, team, score, won, win_type, a row per side and segment; maps: game, season, event, winner, team1, team2,
    score1, score2. steps: own, other (the state after a segment, from the side of the smaller team), own_won, win_type.

    A round counts if both sides have a row and exactly one says it won. What follows one that does not is unknown: the
    map keeps the rounds before it, and dropped is the number of the others. A hill map is used whole or not at all. Reasons,
    in their order: no_winner, one_team, for hills the first of missing_side, no_score, score_falls, score_too_high, then
    other_winner, score_differs (from a recorded map score), nothing_left.
    """
    sides = segments.groupBy("game", "kind").agg(F.array_sort(F.collect_set("team")).alias("teams"), F.max("ordinal").alias("last"))
    sides = sides.withColumns({"a": F.get("teams", F.lit(0)), "b": F.get("teams", F.lit(1)), "n_teams": F.size("teams")})
    of = lambda side, column: F.max(F.when(F.col("team") == F.col(side), F.col(column)))
    each = segments.join(sides, ["game", "kind"]).groupBy("game", "kind", "ordinal").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("won").alias("claims"), of("a", "score").alias("sa"), of("b", "score").alias("sb"), F.count("score").alias("scores"),
        F.max(F.when(F.col("won"), (F.col("team") == F.col("a")).cast("int"))).alias("own_won"), F.max(F.when(F.col("won"), F.col("win_type"))).alias("win_type"),
    )
    w = Window.partitionBy("game", "kind").orderBy("ordinal")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    hill = F.col("kind") == HILL
    gap = F.col("ordinal") != F.row_number().over(w)
    falls = (F.col("sa") < F.coalesce(F.lag("sa").over(w), F.lit(0))) | (F.col("sb") < F.coalesce(F.lag("sb").over(w), F.lit(0)))
    fault = (
        F.when(gap | (F.col("rows") != 2), "missing_side").when(hill & (F.col("scores") < 2), "no_score").when(hill & falls, "score_falls")
        .when(hill & ((F.col("sa") > HILL_TARGET) | (F.col("sb") > HILL_TARGET)), "score_too_high").when(~hill & (F.col("claims") != 1), "unclaimed")
    )
    each = each.withColumn("fault", fault).withColumn("known", F.max(F.col("fault").isNotNull()).over(upto) == F.lit(False))
    running = lambda value, score: F.when(hill, F.col(score)).otherwise(F.sum((F.col("own_won") == value).cast("int")).over(upto)).cast("int")
    each = each.withColumns({"own": running(1, "sa"), "other": running(0, "sb")})
    step = F.struct("ordinal", "own", "other", "own_won", "win_type")
    built = each.groupBy("game", "kind").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("known"), step))), lambda s: s.dropFields("ordinal")).alias("steps"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("ordinal"))).alias("fault"),
        F.count_if("known").alias("good"), F.max_by(F.struct("sa", "sb"), "ordinal").alias("end"),
    )
    met = built.join(sides, ["game", "kind"]).join(maps, "game")
    recorded = lambda side: F.when(F.col("team1") == F.col(side), F.col("score1")).when(F.col("team2") == F.col(side), F.col("score2"))
    differs = lambda side, end: F.coalesce(recorded(side) != F.col(f"end.{end}"), F.lit(False))
    reason = (
        F.when(F.col("winner").isNull(), "no_winner").when(F.col("n_teams") != 2, "one_team").when(hill, F.col("fault"))
    )
    later = (
        F.when((F.col("winner") != F.col("a")) & (F.col("winner") != F.col("b")), "other_winner").when(hill & (differs("a", "sa") | differs("b", "sb")), "score_differs").when(F.size("steps") == 0, "nothing_left")
    )
    return met.select("game", "kind", F.coalesce(reason, later).alias("reason"), "season", "event", (F.col("winner") == F.col("a")).alias("won"), F.when(hill, 0).otherwise(F.col("last") - F.col("good")).cast("int").alias("dropped"), "steps")


def report(maps: DataFrame) -> DataFrame:
    """kind, reason, maps, truncated, dropped: how many maps of loaded() are used (reason null) or not, by reason."""
    return maps.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("maps"), F.count_if(F.col("reason").isNull() & (F.col("dropped") > 0)).alias("truncated"), F.sum(F.when(F.col("reason").isNull(), F.col("dropped")).otherwise(0)).cast("long").alias("dropped"))


def states(maps: DataFrame) -> DataFrame:
    """game, kind, season, event, own, other, cell_own, cell_other, won: every state of the used maps that is not an end, from both sides.

    A state of rounds is its own cell; one of points is the cell of hill_cell().
    """
    steps = maps.filter("reason is null").select("game", "kind", "season", "event", "won", F.inline("steps")).filter((F.col("own") < target(F.col("kind"))) & (F.col("other") < target(F.col("kind"))))
    view = lambda a, b, won: F.struct(F.col(a).alias("own"), F.col(b).alias("other"), won.alias("won"))
    both = steps.select("game", "kind", "season", "event", F.inline(F.array(view("own", "other", F.col("won")), view("other", "own", ~F.col("won")))))
    own, lead = hill_cell(F.col("own"), F.col("other"))
    hill = F.col("kind") == HILL
    return both.withColumns({"cell_own": F.when(hill, own).otherwise(F.col("own")), "cell_other": F.when(hill, lead).otherwise(F.col("other"))})


def state_table(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, kind, cell_own, cell_other, n, wins, p: the share of a cell's states whose side won, LAPLACE added."""
    n, wins = F.count(F.lit(1)), F.count_if("won")
    return rows.groupBy(*keys, "kind", "cell_own", "cell_other").agg(n.alias("n"), wins.alias("wins"), ((wins + LAPLACE) / (n + 2 * LAPLACE)).alias("p"))


def race_grid(rounds: int) -> np.ndarray:
    """The chance to be first to so many rounds, from every state, if each is a fair coin: of the rounds left at most, enough must be won."""
    grid = np.zeros((rounds + 1, rounds + 1))
    grid[rounds] = 1.0
    grid[rounds, rounds] = 0.5
    for own in range(rounds):
        for other in range(rounds):
            left = 2 * rounds - 1 - own - other
            grid[own, other] = sum(comb(left, k) for k in range(rounds - own, left + 1)) / 2**left
    return grid


def gains(maps: DataFrame) -> list[tuple[int, int, float]]:
    """(own, other, share) of the points that hills bring both sides, in bins of GAIN, seen from both sides; hills that bring none are left out.

    At most (HILL_TARGET / GAIN + 1) ** 2 rows reach the driver.
    """
    hills = maps.filter((F.col("reason").isNull()) & (F.col("kind") == HILL)).select("game", F.posexplode("steps").alias("place", "s"))
    w = Window.partitionBy("game").orderBy("place")
    gain = lambda c: (F.floor((F.col(f"s.{c}") - F.coalesce(F.lag(f"s.{c}").over(w), F.lit(0))) / GAIN) * GAIN).cast("int")
    each = hills.select(gain("own").alias("a"), gain("other").alias("b")).filter("a > 0 or b > 0")
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    counts = each.select(F.inline(F.array(pair("a", "b"), pair("b", "a")))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).orderBy("a", "b").collect()
    total = sum(r["n"] for r in counts)
    return [(r["a"], r["b"], r["n"] / total) for r in counts]


def hill_grid(shares: list[tuple[int, int, float]], points: int = HILL_TARGET) -> np.ndarray:
    """The chance to be first to so many points from every pair of scores, if hills are drawn anew from the shares.

    Scores beyond the target count as the target, and one half goes to hills that take both there. Rows are solved from the highest own
    score down: hills with own points lead to rows that are known, and those without lead to higher scores of the other side in the same row.
    """
    grid = np.full((points + 1, points + 1), 0.5)
    if not shares:
        grid[points], grid[:, points], grid[points, points] = 1.0, 0.0, 0.5
        return grid
    grid[points], grid[:, points], grid[points, points] = 1.0, 0.0, 0.5
    others = np.arange(points)
    for own in range(points - 1, -1, -1):
        known = np.zeros(points)
        for a, b, share in shares:
            if a > 0:
                known += share * grid[min(own + a, points), np.minimum(others + b, points)]
        still = [(b, share) for a, b, share in shares if a <= 0]
        for other in range(points - 1, -1, -1):
            grid[own, other] = known[other] + sum(share * grid[own, min(other + b, points)] for b, share in still)
    return grid


def baseline(maps: DataFrame) -> DataFrame:
    """kind, own, other, baseline: races without memory from every state, a table of fixed size."""
    spark = maps.sparkSession
    rows = [(kind, own, other, float(p)) for kind, rounds in ROUNDS.items() for (own, other), p in np.ndenumerate(race_grid(rounds))]
    rows += [(HILL, own, other, float(p)) for (own, other), p in np.ndenumerate(hill_grid(gains(maps)))]
    return spark.createDataFrame(rows, "kind string, own int, other int, baseline double")


def compared(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """kind, states, table_brier, baseline_brier: the state table, fitted on all rows, beside the race without memory."""
    table = state_table(rows).select("kind", "cell_own", "cell_other", "p")
    met = rows.join(F.broadcast(grid), ["kind", "own", "other"]).join(table, ["kind", "cell_own", "cell_other"])
    y = F.col("won").cast("double")
    error = lambda p: F.avg((F.col(p) - y) * (F.col(p) - y))
    return met.groupBy("kind").agg(F.count(F.lit(1)).alias("states"), error("p").alias("table_brier"), error("baseline").alias("baseline_brier"))


def feed_maps(rounds: DataFrame, kind: str = "snd_round") -> DataFrame:
    """Maps like those of loaded(), of rounds of a kill feed: game, season, event, round, side (1 or 2, the winner).

    A map whose leading side does not have exactly the rounds that win a map of the kind was played to another length: its reason is other_race.
    """
    w = Window.partitionBy("game").orderBy("round")
    won = lambda side: F.sum((F.col("side") == side).cast("int")).over(w).cast("int")
    step = F.struct("round", won(1).alias("own"), won(2).alias("other"), (F.col("side") == 1).cast("int").alias("own_won"), F.lit(None).cast("string").alias("win_type"))
    built = rounds.select("game", "season", "event", "round", step.alias("step")).groupBy("game").agg(F.min("season").alias("season"), F.min("event").alias("event"), F.array_sort(F.collect_list("step")).alias("steps"))
    end = F.element_at("steps", -1)
    reason = F.when(F.greatest(end["own"], end["other"]) != ROUNDS[kind], "other_race")
    return built.select("game", F.lit(kind).alias("kind"), reason.alias("reason"), "season", "event", (end["own"] > end["other"]).alias("won"), F.lit(0).alias("dropped"), F.transform("steps", lambda s: s.dropFields("round")).alias("steps"))


def two_eras(one: DataFrame, other: DataFrame) -> DataFrame:
    """kind, cell_own, cell_other, n_one, p_one, n_other, p_other, delta, z of the cells that both tables of states() have.

    A map is in a cell from both sides, so counts are twice the maps', and the variances of the shares are doubled.
    """
    share = lambda rows, name: state_table(rows).select("kind", "cell_own", "cell_other", F.col("n").alias(f"n_{name}"), (F.col("wins") / F.col("n")).alias(f"p_{name}"))
    met = share(one, "one").join(share(other, "other"), ["kind", "cell_own", "cell_other"])
    variance = sum((2 * F.col(f"p_{e}") * (1 - F.col(f"p_{e}")) / F.col(f"n_{e}") for e in ("one", "other")), F.lit(0.0))
    delta = F.col("p_one") - F.col("p_other")
    return met.withColumns({"delta": delta, "z": F.when(variance > 0, delta / F.sqrt(variance))})
