"""Window functions and cohort scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators.cohort import scored
from matchloom.plans.aggregates import LINES, lines
from matchloom.plans.base import Tables, query


@query("win_part_sum", f"WITH {LINES} SELECT player, game, deaths, round(sum(kills) OVER (PARTITION BY game, player % 2), 2) AS team_kills FROM lines")
def win_part_sum(t: Tables):
    team = Window.partitionBy("game", F.col("player") % 2)
    return lines(t).select("player", "game", "deaths", F.round(F.sum("kills").over(team), 2).alias("team_kills"))


@query("win_rn_last", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def win_rn_last(t: Tables):
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return t("orders").select("o_custkey", "o_orderkey", rn.alias("rn")).filter("rn = 1").drop("rn")


@query("win_rn_top", f"""WITH {LINES}, c AS (SELECT season, mode, player, count(*) AS n, row_number() OVER (PARTITION BY season, mode ORDER BY count(*) DESC, player) AS rn FROM lines GROUP BY 1, 2, 3)
SELECT season, mode, string_agg(CAST(player AS VARCHAR), ',' ORDER BY rn) AS lineup FROM c WHERE rn <= 4 GROUP BY 1, 2 HAVING count(*) = 4""")
def win_rn_top(t: Tables):
    c = lines(t).groupBy("season", "mode", "player").agg(F.count(F.lit(1)).alias("n"))
    top = c.withColumn("rn", F.row_number().over(Window.partitionBy("season", "mode").orderBy(F.desc("n"), "player"))).filter("rn <= 4")
    g = top.groupBy("season", "mode").agg(F.array_sort(F.collect_list(F.struct("rn", "player"))).alias("a")).filter(F.size("a") == 4)
    return g.select("season", "mode", F.array_join(F.transform("a", lambda x: x["player"].cast("string")), ",").alias("lineup"))


@query("win_rn_2", """SELECT o_custkey, max(o_totalprice) FILTER (WHERE rn = 1) AS latest, max(o_totalprice) FILTER (WHERE rn = 2) AS previous FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 2 GROUP BY o_custkey""")
def win_rn_2(t: Tables):
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    last = t("orders").select("o_custkey", "o_totalprice", rn.alias("rn")).filter("rn <= 2")
    return last.groupBy("o_custkey").agg(F.max(F.when(F.col("rn") == 1, F.col("o_totalprice"))).alias("latest"), F.max(F.when(F.col("rn") == 2, F.col("o_totalprice"))).alias("previous"))


@query("win_prev", "SELECT event_id, round(value - lag(value, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events")
def win_prev(t: Tables):
    before = F.lag("value", 1, 0.0).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select("event_id", F.round(F.col("value") - before, 6).alias("delta"))


@query("win_consec", f"""WITH {LINES}, s AS (SELECT player, season, sum(kills) / sum(deaths) AS kd FROM lines GROUP BY 1, 2),
d AS (SELECT player, season, kd, lead(season) OVER w AS ns, lead(kd) OVER w AS nk FROM s WINDOW w AS (PARTITION BY player ORDER BY season))
SELECT player, season, round(nk - kd, 6) AS change FROM d WHERE ns = season + 1""")
def win_consec(t: Tables):
    w = Window.partitionBy("player").orderBy("season")
    s = lines(t).groupBy("player", "season").agg((F.sum("kills") / F.sum("deaths")).alias("kd"))
    d = s.withColumns({"ns": F.lead("season").over(w), "nk": F.lead("kd").over(w)})
    return d.filter("ns = season + 1").select("player", "season", F.round(F.col("nk") - F.col("kd"), 6).alias("change"))


@query("win_trend", f"""WITH {LINES}, s AS (SELECT player, season, sum(kills) / sum(deaths) AS kd FROM lines GROUP BY 1, 2),
d AS (SELECT player, kd, lag(kd) OVER (PARTITION BY player ORDER BY season) AS pk FROM s)
SELECT player, CAST(count(*) AS BIGINT) AS seasons, count(*) >= 3 AND (bool_and(pk IS NULL OR kd > pk) OR bool_and(pk IS NULL OR kd < pk)) AS monotone FROM d GROUP BY player""")
def win_trend(t: Tables):
    s = lines(t).groupBy("player", "season").agg((F.sum("kills") / F.sum("deaths")).alias("kd"))
    d = s.withColumn("pk", F.lag("kd").over(Window.partitionBy("player").orderBy("season")))
    up, down = (F.every(F.coalesce(c, F.lit(True))) for c in (F.col("kd") > F.col("pk"), F.col("kd") < F.col("pk")))
    return d.groupBy("player").agg(F.count(F.lit(1)).alias("seasons"), ((F.count(F.lit(1)) >= 3) & (up | down)).alias("monotone"))


COHORT = f"""WITH {LINES}, v AS (SELECT player, season, mode, sum(kills) / greatest(sum(deaths), 1) AS value, CAST(count(*) AS BIGINT) AS denom, count(*) >= 8 AS qualified FROM lines
GROUP BY GROUPING SETS ((player, season, mode), (player, season))),
c AS (SELECT *, CAST(count(*) FILTER (WHERE qualified) OVER w AS DOUBLE) AS n, avg(value) FILTER (WHERE qualified) OVER w AS m, stddev_samp(value) FILTER (WHERE qualified) OVER w AS s,
count(*) FILTER (WHERE qualified) OVER (PARTITION BY season, mode ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below FROM v WINDOW w AS (PARTITION BY season, mode))"""


def kd_scored(t: Tables):
    sets = lines(t).groupingSets([["player", "season", "mode"], ["player", "season"]], "player", "season", "mode")
    values = sets.agg((F.sum("kills") / F.greatest(F.sum("deaths"), F.lit(1))).alias("value"), F.count(F.lit(1)).alias("denom")).withColumn("qualified", F.col("denom") >= 8)
    return scored(values, ["season", "mode"])


@query("kd_cohort", COHORT + """ SELECT player, season, mode, round(value, 6) AS value, denom, qualified, CASE WHEN n >= 15 AND s > 0 THEN round((value - m) / s, 6) END AS z,
CASE WHEN n >= 2 AND s > 0 THEN round(below / n, 6) END AS pctl FROM c""")
def kd_cohort(t: Tables):
    """Kills per death by player, season and mode (null: all modes), scored in its season's and mode's cohort."""
    return kd_scored(t).select("player", "season", "mode", F.round("value", 6).alias("value"), "denom", "qualified", F.round("z", 6).alias("z"), F.round("pctl", 6).alias("pctl"))


@query("win_pctl", COHORT + " SELECT player, season, mode, CASE WHEN n >= 2 AND s > 0 THEN round(below / n, 6) END AS pctl FROM c WHERE mode IS NOT NULL")
def win_pctl(t: Tables):
    return kd_scored(t).filter("mode is not null").select("player", "season", "mode", F.round("pctl", 6).alias("pctl"))


@query("win_z", COHORT + " SELECT player, season, mode, CASE WHEN n >= 15 AND s > 0 THEN round((value - m) / s, 6) END AS z FROM c WHERE mode IS NULL")
def win_z(t: Tables):
    return kd_scored(t).filter("mode is null").select("player", "season", "mode", F.round("z", 6).alias("z"))


@query("win_cap", "SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def win_cap(t: Tables):
    rn = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", rn.alias("rn")).filter("rn <= 2").drop("rn")


@query("win_best3", f"""WITH {LINES}, s AS (SELECT player, season, sum(kills) AS v FROM lines WHERE mode = 'A' GROUP BY 1, 2)
SELECT player, round(max(w), 2) AS best3 FROM (SELECT player, sum(v) OVER (PARTITION BY player ORDER BY season RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w FROM s) GROUP BY player""")
def win_best3(t: Tables):
    s = lines(t).filter("mode = 'A'").groupBy("player", "season").agg(F.sum("kills").alias("v"))
    three = F.sum("v").over(Window.partitionBy("player").orderBy("season").rangeBetween(0, 2))  # a missing season adds nothing
    return s.select("player", three.alias("w")).groupBy("player").agg(F.round(F.max("w"), 2).alias("best3"))
