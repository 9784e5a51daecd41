"""Source and normaliser queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions.values import cell_number, season_year
from matchloom.plans.base import Tables, query
from matchloom.sources import records


@query("src_num", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 AND l_discount = 0 THEN NULL WHEN l_linenumber = 4 THEN NULL ELSE l_discount END AS x FROM lineitem""")
def src_num(t: Tables):
    d = F.col("l_discount").cast("string")
    cell = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, F.concat(d, F.lit("%"))).when(F.col("l_linenumber") == 3, F.concat(d, F.lit("m"))).when(F.col("l_linenumber") == 4, "n/a").otherwise(d)
    return t("lineitem").select("l_orderkey", "l_linenumber", cell_number(cell).alias("x"))


@query("src_kind", "SELECT event_id, CASE WHEN event_id % 11 = 0 OR user_id = event_id % 150 THEN 'suicide' WHEN user_id % 2 = (event_id % 150) % 2 THEN 'teamkill' ELSE 'normal' END AS kind FROM events")
def src_kind(t: Tables):
    killer = F.when(F.col("event_id") % 11 > 0, F.col("event_id") % 150)
    return t("events").select("event_id", records.death_kind(F.col("user_id"), killer, F.col("user_id") % 2, killer % 2).alias("kind"))


@query("src_rounds", """WITH m AS (SELECT CAST(ts AS DATE) AS game, CAST(hour(ts) AS INTEGER) AS round, CAST(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS b FROM events GROUP BY 1, 2),
c AS (SELECT game, round, CAST(sum(a) OVER w AS BIGINT) AS score1, CAST(sum(b) OVER w AS BIGINT) AS score2, a, b FROM m WINDOW w AS (PARTITION BY game ORDER BY round))
SELECT game, round, score1, score2, CASE WHEN a > b THEN 1 WHEN b > a THEN 2 ELSE 0 END AS winner_side FROM c""")
def src_rounds(t: Tables):
    from pyspark.sql import Window

    m = t("events").groupBy(F.to_date("ts").alias("game"), F.hour("ts").alias("round")).agg(F.count_if(F.col("user_id") % 2 == 0).alias("a"), F.count_if(F.col("user_id") % 2 == 1).alias("b"))
    w = Window.partitionBy("game").orderBy("round")
    ends = m.select("game", "round", F.lit("roundend").alias("kind"), F.sum("a").over(w).alias("score1"), F.sum("b").over(w).alias("score2"), F.lit(0).alias("time_ms"))
    return records.rounds(ends).select("game", "round", "score1", "score2", "winner_side")


@query("src_era", "SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS season, CASE WHEN year(o_orderdate) < 1996 THEN 'archive' ELSE 'provider' END AS era FROM orders")
def src_era(t: Tables):
    return t("orders").select("o_orderkey", season_year(F.col("o_orderdate")).alias("season"), F.when(F.year("o_orderdate") < 1996, "archive").otherwise("provider").alias("era"))


@query("src_venue", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN true WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END AS is_lan FROM orders")
def src_venue(t: Tables):
    kind = F.when(F.col("o_orderstatus") == "F", "Offline").when(F.col("o_orderstatus") == "O", "online")
    return t("orders").select("o_orderkey", records.venue(F.when(F.col("o_orderkey") % 10 == 0, True), kind).alias("is_lan"))


@query("src_stints", "SELECT o_custkey AS player, o_orderkey % 25 AS team, CAST(min(o_orderdate) AS DATE) AS start_date, CAST(max(o_orderdate) AS DATE) AS end_date FROM orders GROUP BY 1, 2")
def src_stints(t: Tables):
    return t("orders").groupBy(F.col("o_custkey").alias("player"), (F.col("o_orderkey") % 25).alias("team")).agg(F.to_date(F.min("o_orderdate")).alias("start_date"), F.to_date(F.max("o_orderdate")).alias("end_date"))


@query("src_dedup", """WITH s AS (SELECT o_orderkey AS id, o_custkey % 200 AS pair, CAST(o_orderdate AS DATE) AS day, o_orderkey % 3 AS rank FROM orders)
SELECT id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.pair = a.pair AND b.rank < a.rank AND abs(date_diff('day', a.day, b.day)) <= 1)""")
def src_dedup(t: Tables):
    catalogue = F.when(F.col("o_orderkey") % 3 == 0, "first").when(F.col("o_orderkey") % 3 == 1, "second").otherwise("third")
    series = t("orders").select(F.col("o_orderkey").alias("id"), catalogue.alias("catalogue"), (F.col("o_custkey") % 200).alias("pair"), F.to_date("o_orderdate").alias("day"))
    return records.without_repeats(series, {"first": 0, "second": 1, "third": 2}).select("id")


@query("src_event", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type), '(steel|tin|brass)', 'metal'), '\\s+', ' ', 'g')) AS name FROM part")
def src_event(t: Tables):
    named = F.regexp_replace(F.regexp_replace(F.lower("p_type"), "^(.*?)(steel|tin|brass)", "$1metal"), r"\s+", " ")
    return t("part").select("p_partkey", F.trim(named).alias("name"))


@query("src_pair", """WITH l AS (SELECT l_orderkey AS id, list(DISTINCT l_suppkey) AS players FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_custkey % 20 AS m, o_orderstatus AS mode, CAST(o_orderdate AS DATE) AS day FROM orders),
a AS (SELECT id, m, mode, day, players FROM l JOIN o ON id = o_orderkey WHERE id % 2 = 0), b AS (SELECT id, m, mode, day, players FROM l JOIN o ON id = o_orderkey WHERE id % 2 = 1),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.players, b.players)) AS shared FROM a JOIN b ON a.m = b.m AND a.mode = b.mode AND abs(date_diff('day', a.day, b.day)) <= 5),
r AS (SELECT a, b, rank() OVER (PARTITION BY a ORDER BY shared DESC) AS ra, rank() OVER (PARTITION BY b ORDER BY shared DESC) AS rb FROM p WHERE shared > 0), k AS (SELECT a, b FROM r WHERE ra = 1 AND rb = 1)
SELECT a, b FROM (SELECT a, b, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM k) WHERE na = 1 AND nb = 1""")
def src_pair(t: Tables):
    players = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("players"))
    o = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("map"), F.col("o_orderstatus").alias("mode"), F.to_date("o_orderdate").alias("day"))
    maps = o.join(players, "id")
    return records.linked(maps.filter("id % 2 = 0"), maps.filter("id % 2 = 1"), 5)


@query("src_alias", """WITH n AS (SELECT regexp_replace(lower(h), '[^a-z0-9]', '', 'g') AS key, h, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS h FROM orders) GROUP BY 1, 2)
SELECT key, arg_min(h, (-n, h)) AS spelling FROM n GROUP BY key""")
def src_alias(t: Tables):
    spelled = F.when(F.col("o_orderkey") % 3 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    return records.spellings(t("orders").select(spelled.alias("handle")))
