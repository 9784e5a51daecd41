"""Findings: rules over metric and season rows, capped per subject and corrected for multiplicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outliers(seasons: DataFrame, least_maps: int = 30, least_z: float = 2.0) -> DataFrame:
    """subject, season, kind, score: the players furthest from their season's mean (player, season, z, maps)."""
    far = seasons.filter((F.abs("z") >= least_z) & (F.col("maps") >= least_maps))
    return far.select(F.col("player").alias("subject"), "season", F.lit("outlier").alias("kind"), F.least(F.abs("z") / 3.5, F.lit(1.0)).alias("score"))


def trends(seasons: DataFrame, least_seasons: int = 3, least_move: float = 0.15) -> DataFrame:
    """subject, kind, score: percentiles that only rise or only fall over at least three seasons (player, season, pctl)."""
    d = seasons.filter("pctl is not null").withColumn("before", F.lag("pctl").over(Window.partitionBy("player").orderBy("season")))
    step = F.col("pctl") - F.col("before")
    g = d.groupBy("player").agg(F.count(F.lit(1)).alias("n"), F.min(step).alias("lo"), F.max(step).alias("hi"), F.sum(step).alias("move"))
    return g.filter((F.col("n") >= least_seasons) & ((F.col("lo") > 0) | (F.col("hi") < 0)) & (F.abs("move") >= least_move)).select(F.col("player").alias("subject"), F.lit("trend").alias("kind"), F.least(F.abs("move"), F.lit(1.0)).alias("score"))


def shifts(shares: DataFrame, key: str, at: str, least: float) -> DataFrame:
    """Changes of a share between consecutive points of at least the given size; a share missing on one side is 0."""
    points = shares.select(at).distinct()
    nxt = points.withColumn("next", F.lead(at).over(Window.orderBy(at))).filter("next is not null")  # one row per event
    a = shares.select(F.col(at).alias("from"), key, F.col("share").alias("s0")).join(nxt.withColumnRenamed(at, "from"), "from")
    b = shares.select(F.col(at).alias("next"), key, F.col("share").alias("s1")).join(nxt.withColumnRenamed(at, "from"), "next")
    both = a.join(b, ["from", "next", key], "full_outer")
    moved = F.coalesce("s1", F.lit(0.0)) - F.coalesce("s0", F.lit(0.0))
    return both.select("from", "next", key, moved.alias("moved")).filter(F.abs("moved") >= least)


def best(findings: DataFrame, most: int, *ties: str) -> DataFrame:
    """The most findings of the highest score, ties by subject and the given columns; a report of fixed length."""
    return findings.orderBy(F.desc(F.round("score", 6)), "subject", *ties).limit(most)


def career_milestones(careers: DataFrame, least_maps: int = 250, most: int = 25) -> DataFrame:
    """subject, kind, rank, score: the players with the most maps (player, maps), of those with enough of them."""
    top = careers.filter(F.col("maps") >= least_maps).orderBy(F.desc("maps"), "player").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("maps"), "player"))  # of at most so many rows
    return top.select(F.col("player").alias("subject"), F.lit("milestone").alias("kind"), rank.alias("rank"), (0.35 + F.least(F.col("maps") / 2000.0, F.lit(0.3))).alias("score"))


def peak_milestones(ratings: DataFrame, most: int = 5) -> DataFrame:
    """subject, kind, rank, score: the teams with the highest rating ever (team, rating)."""
    top = ratings.groupBy("team").agg(F.max("rating").alias("peak")).orderBy(F.desc("peak"), "team").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("peak"), "team"))
    return top.select(F.col("team").alias("subject"), F.lit("milestone").alias("kind"), rank.alias("rank"), (0.8 - 0.08 * (rank - 1)).alias("score"))


def era_changes(pace: DataFrame, least: float = 0.05) -> DataFrame:
    """mode, subject, kind, change, score: consecutive seasons of a mode whose pace (mode, season, pace) moved by a share of least or more."""
    before = F.lag("pace").over(Window.partitionBy("mode").orderBy("season"))
    moved = pace.withColumn("change", (F.col("pace") - before) / before).filter(F.abs("change") >= least)
    return moved.select("mode", F.col("season").alias("subject"), F.lit("era_context").alias("kind"), "change", F.least(F.abs("change") * 2.5, F.lit(1.0)).alias("score"))


def head_to_head_edges(series: DataFrame, least_series: int = 8, least_rate: float = 0.70) -> DataFrame:
    """subject, opponent, wins, n, kind, score: sides that win at least that share of many series (a, b, a_won) of a pair."""
    low = F.col("a") < F.col("b")
    pairs = series.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.when(low, F.col("a_won")).otherwise(~F.col("a_won")).cast("int").alias("w"))
    n = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).filter(F.col("n") >= least_series)
    sides = F.array(*(F.struct(F.col(s).alias("subject"), F.col(o).alias("opponent"), wins.alias("wins")) for s, o, wins in (("x", "y", F.col("w")), ("y", "x", F.col("n") - F.col("w")))))
    rate = F.col("wins") / F.col("n")
    score = F.least((rate - 0.5) * 1.6 + F.col("n") / 40.0, F.lit(1.0))
    return n.select("n", F.inline(sides)).filter(rate >= least_rate).select("subject", "opponent", "wins", "n", F.lit("h2h_edge").alias("kind"), score.alias("score"))


def _pooled(rows: DataFrame, metric: str, name: str) -> DataFrame:
    return rows.filter((F.col("metric") == metric) & F.col("mode").isNull() & F.col("qualified") & F.col("pctl").isNotNull()).select("player", "season", F.col("pctl").alias(name))


def intangible_outliers(rows: DataFrame, rising: dict[str, bool], top: float = 0.9, half: float = 0.5, most: int = 24) -> DataFrame:
    """subject, season, mode, metric, undersold, score: metrics on which a season's rank contradicts that of kills per death.

    rows: metric rows with pctl; rising: for each metric looked at, whether higher is better. Undersold: among the best
    on the metric, in the lower half by kills per death; oversold: among the worst on it and the best by that.
    """
    low = [m for m, up in rising.items() if not up]
    quality = F.when(F.col("metric").isin(low), 1 - F.col("pctl")).otherwise(F.col("pctl"))
    own = rows.filter(F.col("qualified") & F.col("pctl").isNotNull() & F.col("metric").isin(list(rising))).join(_pooled(rows, "kd", "kd_pctl"), ["player", "season"]).withColumn("quality", quality)
    under = (F.col("quality") >= top) & (F.col("kd_pctl") <= half)
    over = (F.col("quality") <= 1 - top) & (F.col("kd_pctl") >= top)
    found = own.filter(under | over).select(F.col("player").alias("subject"), "season", "mode", "metric", under.alias("undersold"), F.least(0.5 + F.abs(F.col("quality") - F.col("kd_pctl")) * 0.45, F.lit(0.98)).alias("score"))
    return best(found, most, "season", "metric", "mode")


def profile_extremes(rows: DataFrame, rising: dict[str, bool], least_denominator: dict[str, float], least_z: float = 1.5, times: float = 2.0, most: int = 30) -> DataFrame:
    """subject, season, mode, metric, z, score: the best qualified season of each metric, season and mode, if it stands out.

    The best is by z in the metric's direction (rising), ties to the smaller player; it must lie least_z from the mean and
    have times the metric's least denominator.
    """
    low = [m for m, up in rising.items() if not up]
    good = F.when(F.col("metric").isin(low), -F.col("z")).otherwise(F.col("z"))
    own = rows.filter(F.col("qualified") & F.col("z").isNotNull() & F.col("metric").isin(list(rising)))
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("metric", "season", "mode").orderBy(F.desc(F.round(good, 9)), "player"))).filter("n = 1")
    floor = F.create_map(*(F.lit(x) for pair in least_denominator.items() for x in pair))[F.col("metric")]
    found = first.filter((F.abs("z") >= least_z) & (F.col("denom") >= floor * times))
    return best(found.select(F.col("player").alias("subject"), "season", "mode", "metric", "z", F.least(0.55 + F.abs("z") * 0.09, F.lit(0.97)).alias("score")), most, "season", "metric", "mode")


def clutch_milestones(rows: DataFrame, least_attempts: float = 20, top: float = 0.9, most: int = 10) -> DataFrame:
    """subject, season, mode, metric, attempts, score: the best decile of clutch rates with enough attempts."""
    own = rows.filter(F.col("metric").startswith("clutch") & F.col("qualified") & (F.col("denom") >= least_attempts) & (F.col("pctl") >= top))
    found = own.select(F.col("player").alias("subject"), "season", "mode", "metric", F.col("denom").alias("attempts"), F.least(0.55 + F.col("value") * 0.35, F.lit(0.95)).alias("score"))
    return best(found, most, "season", "metric", "mode")


def trade_asymmetries(rows: DataFrame, slay: str = "kills_p10", untraded: str = "untraded_death_rate", high: float = 0.75, most: int = 12) -> DataFrame:
    """subject, season, isolated, score: who kills much and dies unanswered, and who kills little and is always answered."""
    both = _pooled(rows, untraded, "u").join(_pooled(rows, slay, "k"), ["player", "season"])
    isolated = (F.col("k") >= high) & (F.col("u") >= high)
    answered = (F.col("k") <= 1 - high) & (F.col("u") <= 1 - high)
    score = F.least(0.55 + F.abs(F.col("u") - (1 - F.col("k"))) * 0.5, F.lit(0.95))
    return best(both.filter(isolated | answered).select(F.col("player").alias("subject"), "season", isolated.alias("isolated"), score.alias("score")), most, "season")


def team_styles(rows: DataFrame, least_z: float = 1.5, most: int = 12) -> DataFrame:
    """subject, season, metric, z, score: teams at the ends of how a team divides its work (team, season, metric, z, qualified)."""
    far = rows.filter(F.col("qualified") & (F.abs("z") >= least_z))
    return best(far.select(F.col("team").alias("subject"), "season", "metric", "z", F.least(0.5 + F.abs("z") * 0.12, F.lit(0.95)).alias("score")), most, "season", "metric")


def capped(findings: DataFrame, most: int = 2) -> DataFrame:
    """At most so many findings per subject and kind, the best by score, then by headline."""
    n = F.row_number().over(Window.partitionBy("subject", "kind").orderBy(F.desc("score"), "headline"))
    return findings.withColumn("__n", n).filter(F.col("__n") <= most).drop("__n")


def retracted(findings: DataFrame, level: float = 0.10) -> DataFrame:
    """Adds q_bh, q_by and retracted to findings with p within their kind; findings without p are not judged."""
    from matchloom.operators.ratings import adjusted_p

    judged = adjusted_p(findings.filter("p is not null"), ["kind"], ["subject", "headline"])
    rest = findings.filter("p is null").withColumns({"q_bh": F.lit(None).cast("double"), "q_by": F.lit(None).cast("double")})
    return judged.unionByName(rest).withColumn("retracted", F.coalesce(F.col("q_bh") > level, F.lit(False)))
