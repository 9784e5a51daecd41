"""Joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators.intervals import as_of, overlaps, within
from matchloom.plans.base import Tables, query


@query("jn_chain", """SELECT r_name, CAST(year(l_shipdate) AS INTEGER) AS season, CAST(count(*) AS BIGINT) AS n_lines, round(sum(l_quantity), 2) AS kills
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def jn_chain(t: Tables):
    sides = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    played = t("orders").join(t("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_quantity")
    return (
        lines.join(played, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(sides, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("r_name", F.year("l_shipdate").alias("season"))
        .agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("kills"))
    )


@query("jn_left", """SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_series, max(o_totalprice) AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""")
def jn_left(t: Tables):
    done = t("orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    return t("customer").select("c_custkey").join(done, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_series"), F.max("o_totalprice").alias("best"))


@query("jn_nullsafe", """WITH a AS (SELECT l_suppkey AS player, nullif(l_returnflag, 'A') AS mode, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
b AS (SELECT l_suppkey AS player, nullif(l_returnflag, 'A') AS mode, CAST(count(*) AS BIGINT) AS m FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
SELECT a.player, a.mode, n, m FROM a LEFT JOIN b ON a.player = b.player AND a.mode IS NOT DISTINCT FROM b.mode""")
def jn_nullsafe(t: Tables):
    def side(status: str, name: str):
        lines = t("lineitem").filter(F.col("l_linestatus") == status)
        return lines.groupBy(F.col("l_suppkey").alias("player"), F.nullif("l_returnflag", F.lit("A")).alias("mode")).agg(F.count(F.lit(1)).alias(name))

    a, b = side("O", "n"), side("F", "m")
    return a.join(b, (a["player"] == b["player"]) & a["mode"].eqNullSafe(b["mode"]), "left").select(a["player"], a["mode"], "n", "m")


@query("jn_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def jn_semi(t: Tables):
    rich = t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(rich, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("jn_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def jn_anti(t: Tables):
    rich = t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(rich, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("jn_self_ne", """SELECT a.l_suppkey AS player, CAST(count(*) AS BIGINT) AS meetings, round(avg(b.l_quantity), 6) AS opposing_kills FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_suppkey % 2 <> b.l_suppkey % 2 GROUP BY a.l_suppkey""")
def jn_self_ne(t: Tables):
    """A side's lines are summed first, so a line meets one row of the other side and not each of its lines."""
    a = t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("player"), (F.col("l_suppkey") % 2).alias("side"), "l_quantity")
    other = a.groupBy("l_orderkey", (1 - F.col("side")).alias("side")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("kills"))
    met = a.join(other, ["l_orderkey", "side"]).groupBy("player")
    return met.agg(F.sum("n").alias("meetings"), F.round(F.sum("kills") / F.sum("n"), 6).alias("opposing_kills"))


@query("jn_self_lt", """SELECT a.l_suppkey AS player_a, b.l_suppkey AS player_b, CAST(count(DISTINCT a.l_orderkey) AS BIGINT) AS lobbies FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND b.l_suppkey > a.l_suppkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2""")
def jn_self_lt(t: Tables):
    lobby = t("lineitem").select("l_orderkey", "l_suppkey").distinct()
    a, b = lobby.withColumnRenamed("l_suppkey", "player_a"), lobby.withColumnRenamed("l_suppkey", "player_b")
    return a.join(b, "l_orderkey").filter("player_b > player_a").groupBy("player_a", "player_b").agg(F.count(F.lit(1)).alias("lobbies")).filter("lobbies >= 2")


@query("jn_mates", """WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), m AS (SELECT l_suppkey AS player, count(*) AS maps FROM p GROUP BY 1),
w AS (SELECT a.l_suppkey AS player, b.l_suppkey AS mate, count(*) AS n FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey AND a.l_suppkey % 2 = b.l_suppkey % 2 GROUP BY 1, 2)
SELECT w.player, round(max(n) / CAST(max(maps) AS DOUBLE), 6) AS share FROM w JOIN m ON w.player = m.player GROUP BY w.player""")
def jn_mates(t: Tables):
    played = t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("player")).distinct().withColumn("side", F.col("player") % 2)
    mates = played.withColumnRenamed("player", "mate")
    shared = played.join(mates, ["l_orderkey", "side"]).filter("player <> mate").groupBy("player", "mate").agg(F.count(F.lit(1)).alias("n"))
    maps = played.groupBy("player").agg(F.count(F.lit(1)).alias("maps"))
    return shared.groupBy("player").agg(F.max("n").alias("n")).join(maps, "player").select("player", F.round(F.col("n") / F.col("maps"), 6).alias("share"))


STINTS = """stints AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS start_date, CASE WHEN o_custkey % 3 > 0 THEN CAST(max(o_orderdate) AS DATE) END AS end_date
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)"""


def stints(t: Tables):
    """Each player's first to last finished series; a third are still open."""
    done = t("orders").filter("o_orderstatus = 'F'").groupBy("o_custkey")
    spans = done.agg(F.to_date(F.min("o_orderdate")).alias("start_date"), F.to_date(F.max("o_orderdate")).alias("last"))
    return spans.select("o_custkey", "start_date", F.when(F.col("o_custkey") % 3 > 0, F.col("last")).alias("end_date"))


@query("jn_range", f"""WITH {STINTS} SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN stints s ON o.o_custkey = s.o_custkey
AND CAST(o.o_orderdate AS DATE) BETWEEN s.start_date AND coalesce(s.end_date, DATE '2999-12-31') WHERE o.o_orderstatus <> 'F'""")
def jn_range(t: Tables):
    other = t("orders").filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return within(other, stints(t), ["o_custkey"], "day", "start_date", "end_date").select("o_orderkey", "o_custkey")


@query("jn_overlap", f"""WITH {STINTS} SELECT a.o_custkey AS a, b.o_custkey AS b FROM stints a JOIN stints b ON a.o_custkey % 500 = b.o_custkey % 500 AND a.o_custkey < b.o_custkey
AND a.start_date <= coalesce(b.end_date, DATE '2999-12-31') AND b.start_date <= coalesce(a.end_date, DATE '2999-12-31')""")
def jn_overlap(t: Tables):
    s = stints(t).withColumn("block", F.col("o_custkey") % 500)
    return overlaps(s, s, ["block"], "start_date", "end_date").filter("a.o_custkey < b.o_custkey").select(F.col("a.o_custkey").alias("a"), F.col("b.o_custkey").alias("b"))


@query("jn_asof", """SELECT e.event_id, (SELECT max_by(p.value, (p.ts, p.event_id)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS last_value
FROM events e WHERE e.event_type = 'click'""")
def jn_asof(t: Tables):
    events = t("events")
    steps = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("value").alias("last_value"))
    asked = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return as_of(asked, steps, ["user_id"], "ts", "event_id", ["last_value"]).select("event_id", "last_value")


@query("jn_window", """SELECT a.user_id, CAST(count(*) AS BIGINT) AS answered FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase'
AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 60 MINUTE WHERE a.event_type = 'click' GROUP BY a.user_id""")
def jn_window(t: Tables):
    """One ordered pass per user with a frame of the next hour, not every click against every purchase."""
    e = t("events").filter("event_type in ('click', 'purchase')").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    hour = Window.partitionBy("user_id").orderBy("at").rangeBetween(1, 3_600_000_000)
    n = e.withColumn("n", F.count(F.when(F.col("event_type") == "purchase", 1)).over(hour)).filter("event_type = 'click'")
    return n.groupBy("user_id").agg(F.sum("n").alias("answered")).filter("answered > 0")


@query("jn_lateral_v", "SELECT o_orderkey, team FROM (SELECT o_orderkey, unnest([o_custkey % 25, o_orderkey % 25]) AS team FROM orders)")
def jn_lateral_v(t: Tables):
    return t("orders").select("o_orderkey", F.explode(F.array(F.col("o_custkey") % 25, F.col("o_orderkey") % 25)).alias("team"))


@query("jn_lateral_q", """SELECT o_orderkey, (SELECT CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) FROM lineitem WHERE l_orderkey = o_orderkey) AS big_lines FROM orders""")
def jn_lateral_q(t: Tables):
    big = t("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 25).alias("big_lines"))
    return t("orders").select("o_orderkey").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("big_lines", F.lit(0)).alias("big_lines"))


@query("jn_next", """SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_key FROM orders""")
def jn_next(t: Tables):
    return t("orders").select("o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next_key"))


@query("jn_scalar", """SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / ((SELECT max(o_totalprice) FROM orders) - (SELECT min(o_totalprice) FROM orders)), 6) AS scaled FROM orders""")
def jn_scalar(t: Tables):
    orders = t("orders").select("o_orderkey", "o_totalprice")
    ends = orders.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))  # one row
    return orders.join(F.broadcast(ends)).select("o_orderkey", F.round((F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("scaled"))


@query("jn_lineage", """SELECT s_suppkey, coalesce(CASE WHEN s_nationkey < 20 THEN min(s_suppkey) OVER (PARTITION BY s_nationkey) END, s_suppkey) AS founder FROM supplier""")
def jn_lineage(t: Tables):
    org = F.when(F.col("s_nationkey") < 20, F.min("s_suppkey").over(Window.partitionBy("s_nationkey")))
    return t("supplier").select("s_suppkey", F.coalesce(org, "s_suppkey").alias("founder"))


@query("jn_using", """WITH a AS (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_mktsegment FROM customer) SELECT k, n, c_mktsegment FROM a JOIN b USING (k)""")
def jn_using(t: Tables):
    a = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(t("customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), on="k")


@query("jn_fullmerge", """WITH a AS (SELECT l_suppkey AS k, round(sum(l_quantity), 2) AS x FROM lineitem WHERE year(l_shipdate) = 1995 AND l_suppkey % 5 > 0 GROUP BY 1),
b AS (SELECT l_suppkey AS k, round(sum(l_quantity), 2) AS y FROM lineitem WHERE year(l_shipdate) = 1996 AND l_suppkey % 7 > 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, x, y, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'compared' END AS what FROM a FULL JOIN b ON a.k = b.k""")
def jn_fullmerge(t: Tables):
    def year(y: int, skip: int, name: str):
        lines = t("lineitem").filter((F.year("l_shipdate") == y) & (F.col("l_suppkey") % skip > 0))
        return lines.groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias(name))

    what = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("compared")
    return year(1995, 5, "x").join(year(1996, 7, "y"), "k", "full_outer").withColumn("what", what)


@query("jn_multi", """SELECT l_suppkey AS player, round(sum(l_quantity * w) / sum(w), 6) AS weighted FROM lineitem JOIN (VALUES ('A', 1.0::DOUBLE), ('N', 2.0::DOUBLE), ('R', 0.5::DOUBLE)) m(mode, w)
ON l_returnflag = mode GROUP BY l_suppkey""")
def jn_multi(t: Tables):
    weights = t.spark.createDataFrame([("A", 1.0), ("N", 2.0), ("R", 0.5)], "l_returnflag string, w double")  # one row per mode
    return t("lineitem").join(F.broadcast(weights), "l_returnflag").groupBy(F.col("l_suppkey").alias("player")).agg(F.round(F.sum(F.col("l_quantity") * F.col("w")) / F.sum("w"), 6).alias("weighted"))
