"""Aggregations, sorting, paging and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.plans.base import Tables, query

K, D = "l_quantity", "l_linenumber"


def lines(t: Tables):
    return t("lineitem").select(
        F.col("l_suppkey").alias("player"), F.col("l_orderkey").alias("game"), F.year("l_shipdate").alias("season"), F.col("l_returnflag").alias("mode"),
        F.col(K).alias("kills"), F.col(D).alias("deaths"), F.col("l_extendedprice").alias("damage"), F.col("l_linestatus").alias("status"), F.col("l_discount").alias("rate"),
    )


LINES = """lines AS (SELECT l_suppkey AS player, l_orderkey AS game, CAST(year(l_shipdate) AS INTEGER) AS season, l_returnflag AS mode, l_quantity AS kills, l_linenumber AS deaths,
l_extendedprice AS damage, l_linestatus AS status, l_discount AS rate FROM lineitem)"""
SUMS = """CAST(count(*) AS BIGINT) AS maps, round(sum(kills), 2) AS kills, CAST(sum(deaths) AS BIGINT) AS deaths, round(avg(CASE WHEN damage > 50000 THEN 1 ELSE 0 END), 6) AS complete,
round(sum(kills * kills), 2) AS kk, CAST(sum(deaths * deaths) AS BIGINT) AS dd, round(sum(kills * deaths), 2) AS kd"""


def sums():
    return [
        F.count(F.lit(1)).alias("maps"), F.round(F.sum("kills"), 2).alias("kills"), F.sum("deaths").alias("deaths"), F.round(F.avg((F.col("damage") > 50000).cast("int")), 6).alias("complete"),
        F.round(F.sum(F.col("kills") * F.col("kills")), 2).alias("kk"), F.sum(F.col("deaths") * F.col("deaths")).cast("long").alias("dd"), F.round(F.sum(F.col("kills") * F.col("deaths")), 2).alias("kd"),
    ]


@query("agg_season_mode", f"WITH {LINES} SELECT player, season, mode, {SUMS} FROM lines GROUP BY 1, 2, 3")
def agg_season_mode(t: Tables):
    return lines(t).groupBy("player", "season", "mode").agg(*sums())


@query("agg_season_all", f"WITH {LINES} SELECT player, season, {SUMS} FROM lines GROUP BY 1, 2")
def agg_season_all(t: Tables):
    return lines(t).groupBy("player", "season").agg(*sums())


@query("agg_gsets", f"""WITH {LINES} SELECT player, season, CASE WHEN grouping(mode) = 1 THEN NULL ELSE mode END AS mode, grouping(mode) = 1 AS pooled, CAST(count(*) AS BIGINT) AS maps, round(sum(kills), 2) AS kills
FROM lines GROUP BY GROUPING SETS ((player, season, mode), (player, season))""")
def agg_gsets(t: Tables):
    sets = lines(t).groupingSets([["player", "season", "mode"], ["player", "season"]], "player", "season", "mode")
    return sets.agg((F.grouping("mode") == 1).alias("pooled"), F.count(F.lit(1)).alias("maps"), F.round(F.sum("kills"), 2).alias("kills"))


@query("agg_fold", f"""WITH {LINES}, m AS (SELECT player, season, unnest([mode, NULL]) AS mode, CASE WHEN rate > 0.02 THEN damage END AS damage FROM lines)
SELECT player, season, mode, CAST(count(*) AS BIGINT) AS maps, round(sum(damage), 2) AS damage, CAST(count(damage) AS BIGINT) AS damage_maps FROM m GROUP BY ALL""")
def agg_fold(t: Tables):
    reported = F.when(F.col("rate") > 0.02, F.col("damage"))  # null: not reported, never zero
    both = lines(t).select("player", "season", F.explode(F.array("mode", F.lit(None).cast("string"))).alias("mode"), reported.alias("damage"))
    return both.groupBy("player", "season", "mode").agg(F.count(F.lit(1)).alias("maps"), F.round(F.sum("damage"), 2).alias("damage"), F.count("damage").alias("damage_maps"))


@query("agg_filter", f"""WITH {LINES} SELECT player, CAST(count(*) FILTER (WHERE status = 'O') AS BIGINT) AS open_maps, round(avg(kills) FILTER (WHERE mode = 'N'), 6) AS n_kills,
max(damage) FILTER (WHERE mode = 'A') AS a_damage FROM lines GROUP BY player""")
def agg_filter(t: Tables):
    return lines(t).groupBy("player").agg(
        F.count_if(F.col("status") == "O").alias("open_maps"), F.round(F.avg(F.when(F.col("mode") == "N", F.col("kills"))), 6).alias("n_kills"), F.max(F.when(F.col("mode") == "A", F.col("damage"))).alias("a_damage")
    )


@query("agg_distinct", f"WITH {LINES} SELECT season, CAST(count(DISTINCT player) AS BIGINT) AS players, CAST(count(DISTINCT game) AS BIGINT) AS games, CAST(count(DISTINCT player) FILTER (WHERE mode = 'R') AS BIGINT) AS r_players FROM lines GROUP BY season")
def agg_distinct(t: Tables):
    return lines(t).groupBy("season").agg(F.count_distinct("player").alias("players"), F.count_distinct("game").alias("games"), F.count_distinct(F.when(F.col("mode") == "R", F.col("player"))).alias("r_players"))


@query("agg_having", f"WITH {LINES} SELECT player, season, CAST(count(*) AS BIGINT) AS maps FROM lines GROUP BY 1, 2 HAVING count(*) >= 8 AND sum(kills) > 2 * sum(deaths) AND 2 * count(*) FILTER (WHERE status = 'F') < count(*)")
def agg_having(t: Tables):
    g = lines(t).groupBy("player", "season").agg(F.count(F.lit(1)).alias("maps"), F.sum("kills").alias("k"), F.sum("deaths").alias("d"), F.count_if(F.col("status") == "F").alias("f"))
    return g.filter("maps >= 8 and k > 2 * d and 2 * f < maps").select("player", "season", "maps")


@query("agg_pctl", f"WITH {LINES} SELECT season, mode, round(quantile_cont(damage, 0.5), 4) AS median, round(quantile_cont(damage, 0.9), 4) AS p90 FROM lines GROUP BY 1, 2")
def agg_pctl(t: Tables):
    return lines(t).groupBy("season", "mode").agg(F.round(F.percentile("damage", 0.5), 4).alias("median"), F.round(F.percentile("damage", 0.9), 4).alias("p90"))


@query("agg_mode", f"WITH {LINES}, c AS (SELECT player, mode, count(*) AS n FROM lines GROUP BY 1, 2) SELECT player, arg_min(mode, (-n, mode)) AS main_mode FROM c GROUP BY player")
def agg_mode(t: Tables):
    return lines(t).groupBy("player").agg(F.mode("mode", True).alias("main_mode"))


@query("agg_corr", f"WITH {LINES}, m AS (SELECT player, avg(kills) AS k, avg(damage) AS d, avg(rate) AS r FROM lines GROUP BY player) SELECT round(corr(k, d), 6) AS kills_damage, round(corr(k, r), 6) AS kills_rate FROM m")
def agg_corr(t: Tables):
    means = lines(t).groupBy("player").agg(F.avg("kills").alias("k"), F.avg("damage").alias("d"), F.avg("rate").alias("r"))
    return means.agg(F.round(F.corr("k", "d"), 6).alias("kills_damage"), F.round(F.corr("k", "r"), 6).alias("kills_rate"))


@query("agg_wavg", f"WITH {LINES} SELECT season, round(sum(kills * rate) / nullif(sum(rate) FILTER (WHERE kills IS NOT NULL), 0), 6) AS weighted FROM lines GROUP BY season")
def agg_wavg(t: Tables):
    weight = F.sum(F.when(F.col("kills").isNotNull(), F.col("rate")))
    return lines(t).groupBy("season").agg(F.round(F.sum(F.col("kills") * F.col("rate")) / F.nullif(weight, F.lit(0.0)), 6).alias("weighted"))


@query("agg_arr_ord", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS keys, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[1] AS first_key FROM orders GROUP BY o_custkey")
def agg_arr_ord(t: Tables):
    ordered = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return t("orders").groupBy("o_custkey").agg(ordered.alias("a")).select("o_custkey", F.array_join(F.transform("a", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"), F.col("a")[0]["o_orderkey"].alias("first_key"))


@query("agg_arr_dist", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT nullif(o_orderpriority, '5-LOW')) FILTER (WHERE o_orderpriority <> '5-LOW')), ',') AS members FROM orders GROUP BY o_custkey")
def agg_arr_dist(t: Tables):
    members = F.array_sort(F.collect_set(F.nullif("o_orderpriority", F.lit("5-LOW"))))
    return t("orders").groupBy("o_custkey").agg(F.when(F.size(members) > 0, F.array_join(members, ",")).alias("members"))


@query("agg_distinct_on", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def agg_distinct_on(t: Tables):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))  # combines before the shuffle
    return t("orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("agg_modal", "WITH c AS (SELECT o_custkey AS player, o_orderkey % 25 AS team, CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n FROM orders GROUP BY 1, 2, 3) SELECT player, season, arg_min(team, (-n, team)) AS team FROM c GROUP BY 1, 2")
def agg_modal(t: Tables):
    c = t("orders").groupBy(F.col("o_custkey").alias("player"), (F.col("o_orderkey") % 25).alias("team"), F.year("o_orderdate").alias("season")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("player", "season").agg(F.min_by("team", F.struct(-F.col("n"), "team")).alias("team"))


@query("agg_minmax", "SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey")
def agg_minmax(t: Tables):
    return t("orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"), F.count(F.lit(1)).alias("n"))


@query("agg_pace", f"WITH {LINES} SELECT season, mode, round(sum(kills + deaths) / (sum(damage) / 600), 9) AS pace FROM lines GROUP BY 1, 2")
def agg_pace(t: Tables):
    return lines(t).groupBy("season", "mode").agg(F.round(F.sum(F.col("kills") + F.col("deaths")) / (F.sum("damage") / 600), 9).alias("pace"))


@query("agg_scalar_lg", """SELECT least(a, b) AS low, greatest(a, b) AS high, CAST(count(*) AS BIGINT) AS meetings, CAST(sum(CASE WHEN (o_totalprice > 150000) = (a < b) THEN 1 ELSE 0 END) AS BIGINT) AS low_wins
FROM (SELECT o_custkey % 25 AS a, o_orderkey % 25 AS b, o_totalprice FROM orders) WHERE a <> b GROUP BY 1, 2""")
def agg_scalar_lg(t: Tables):
    pairs = t("orders").select((F.col("o_custkey") % 25).alias("a"), (F.col("o_orderkey") % 25).alias("b"), (F.col("o_totalprice") > 150000).alias("won")).filter("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.count(F.lit(1)).alias("meetings"), F.count_if(F.col("won") == (F.col("a") < F.col("b"))).alias("low_wins"))


@query("agg_share", f"""WITH {LINES}, c AS (SELECT season, mode, player % 20 AS loadout, count(*) AS n FROM lines GROUP BY 1, 2, 3), s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY season, mode) AS DOUBLE) AS share FROM c)
SELECT season, mode, loadout, CAST(n AS BIGINT) AS n, round(share, 6) AS share FROM s WHERE n >= 50""")
def agg_share(t: Tables):
    c = lines(t).groupBy("season", "mode", (F.col("player") % 20).alias("loadout")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("season", "mode"))
    return c.withColumn("share", F.round(F.col("n") / total, 6)).filter("n >= 50")  # small loadouts count in the total


@query("agg_hist", """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_custkey) AS clo, max(o_custkey) AS chi FROM orders)
SELECT CAST(least(23, floor((o_totalprice - lo) / (hi - lo) * 24)) AS INTEGER) AS gx, CAST(least(23, floor((o_custkey - clo) / CAST(chi - clo AS DOUBLE) * 24)) AS INTEGER) AS gy, CAST(count(*) AS BIGINT) AS n FROM orders, e GROUP BY 1, 2""")
def agg_hist(t: Tables):
    orders = t("orders").select("o_totalprice", "o_custkey")
    ends = orders.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.min("o_custkey").alias("clo"), F.max("o_custkey").alias("chi"))
    cell = lambda x, lo, hi: F.least(F.lit(23), F.floor((F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo)) * 24)).cast("int")
    return orders.join(F.broadcast(ends)).groupBy(cell("o_totalprice", "lo", "hi").alias("gx"), cell("o_custkey", "clo", "chi").alias("gy")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_gini", f"""WITH {LINES}, s AS (SELECT game, kills, row_number() OVER (PARTITION BY game ORDER BY kills, deaths, player) AS i, count(*) OVER (PARTITION BY game) AS n, sum(kills) OVER (PARTITION BY game) AS total FROM lines)
SELECT game, round(sum((2 * i - n - 1) * kills) / (max(n) * max(total)), 6) AS gini, round(sum((kills / total) * (kills / total)), 6) AS herfindahl, round(stddev_samp(kills / total), 6) AS spread FROM s GROUP BY game""")
def agg_gini(t: Tables):
    game = Window.partitionBy("game")
    s = lines(t).select("game", "kills", F.row_number().over(game.orderBy("kills", "deaths", "player")).alias("i"), F.count(F.lit(1)).over(game).alias("n"), F.sum("kills").over(game).alias("total"))
    share = F.col("kills") / F.col("total")
    return s.groupBy("game").agg(
        F.round(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("kills")) / (F.max("n") * F.max("total")), 6).alias("gini"), F.round(F.sum(share * share), 6).alias("herfindahl"), F.round(F.stddev_samp(share), 6).alias("spread")
    )


@query("srt_multi", "SELECT c_custkey, c_acctbal FROM customer ORDER BY nullif(c_nationkey, 3) DESC NULLS LAST, c_acctbal, c_custkey LIMIT 50")
def srt_multi(t: Tables):
    return t("customer").orderBy(F.nullif("c_nationkey", F.lit(3)).desc_nulls_last(), F.asc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "c_acctbal")


@query("srt_page", "SELECT o_orderkey, o_totalprice, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def srt_page(t: Tables):
    orders = t("orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).join(F.broadcast(orders.agg(F.count(F.lit(1)).alias("total"))))


@query("srt_top", f"WITH {LINES} SELECT player, round(sum(kills), 2) AS kills FROM lines GROUP BY player ORDER BY kills DESC, player LIMIT 25")
def srt_top(t: Tables):
    return lines(t).groupBy("player").agg(F.round(F.sum("kills"), 2).alias("kills")).orderBy(F.desc("kills"), "player").limit(25)


@query("srt_heap", f"""WITH {LINES}, y AS (SELECT player, sum(kills) FILTER (WHERE season = 1995) AS a, sum(kills) FILTER (WHERE season = 1996) AS b FROM lines GROUP BY player)
SELECT player, round(abs(b - a), 2) AS moved FROM y WHERE a IS NOT NULL AND b IS NOT NULL ORDER BY moved DESC, player LIMIT 60""")
def srt_heap(t: Tables):
    of = lambda y: F.sum(F.when(F.col("season") == y, F.col("kills")))
    y = lines(t).groupBy("player").agg(of(1995).alias("a"), of(1996).alias("b"))
    return y.filter("a is not null and b is not null").select("player", F.round(F.abs(F.col("b") - F.col("a")), 2).alias("moved")).orderBy(F.desc("moved"), "player").limit(60)


@query("srt_divers", """WITH r AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders)
SELECT o_orderkey, o_orderpriority FROM r ORDER BY CASE WHEN rk <= 2 THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 12""")
def srt_divers(t: Tables):
    rk = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    top = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice", rk.alias("rk")).filter("rk <= 12")  # two of each kind, then the best of the rest
    return top.orderBy((F.col("rk") > 2).cast("int"), F.desc("o_totalprice"), "o_orderkey").limit(12).select("o_orderkey", "o_orderpriority")


@query("srt_ext", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS place FROM orders")
def srt_ext(t: Tables):
    from matchloom.operators.ordering import numbered

    return numbered(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "place").select("o_orderkey", "place")


@query("set_union_all", """SELECT team, CAST(count(*) AS BIGINT) AS played, CAST(sum(won) AS BIGINT) AS won FROM (SELECT o_custkey % 25 AS team, CAST(o_totalprice > 150000 AS INTEGER) AS won FROM orders WHERE o_custkey % 25 <> o_orderkey % 25
UNION ALL SELECT o_orderkey % 25, CAST(o_totalprice <= 150000 AS INTEGER) FROM orders WHERE o_custkey % 25 <> o_orderkey % 25) GROUP BY team""")
def set_union_all(t: Tables):
    series = t("orders").select((F.col("o_custkey") % 25).alias("a"), (F.col("o_orderkey") % 25).alias("b"), (F.col("o_totalprice") > 150000).alias("a_won")).filter("a <> b")
    sides = series.select(F.col("a").alias("team"), F.col("a_won").cast("int").alias("won")).unionByName(series.select(F.col("b").alias("team"), (~F.col("a_won")).cast("int").alias("won")))
    return sides.groupBy("team").agg(F.count(F.lit(1)).alias("played"), F.sum("won").alias("won"))


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t: Tables):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("set_except", """WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS roster FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey, roster, lead(roster) OVER (ORDER BY l_orderkey) AS nxt FROM l WHERE l_orderkey % 2 < 2)
SELECT l_orderkey, CAST(len(list_filter(roster, lambda x: NOT list_contains(nxt, x))) AS INTEGER) AS gone, CAST(len(list_filter(nxt, lambda x: NOT list_contains(roster, x))) AS INTEGER) AS come FROM
(SELECT a.l_orderkey, a.roster, b.roster AS nxt FROM l a JOIN l b ON b.l_orderkey = a.l_orderkey + 1)""")
def set_except(t: Tables):
    rosters = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("roster"))
    nxt = rosters.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("roster").alias("nxt"))
    return rosters.join(nxt, "l_orderkey").select("l_orderkey", F.size(F.array_except("roster", "nxt")).alias("gone"), F.size(F.array_except("nxt", "roster")).alias("come"))


@query("set_isect", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def set_isect(t: Tables):
    li = t("lineitem")
    a, r = (li.filter(F.col("l_returnflag") == m).select("l_orderkey") for m in "AR")
    return a.intersect(r).intersect(t("orders").filter("o_orderstatus = 'F'").select("o_orderkey"))


@query("set_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def set_distinct(t: Tables):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()
