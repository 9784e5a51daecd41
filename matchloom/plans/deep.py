"""Queries of the models' inputs and consumers: round clocks, win probability, series, ratings of players, career boards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators import feed, maps, ratings, resample, runs
from matchloom.plans.aggregates import LINES, lines
from matchloom.plans.models import _SCORED, ALIVE, CAREER, ELO, TRADES, box_lines, deaths, metric_layer, predictions, newton_sql, season_credit, series, teams
from matchloom.plans.base import Tables, query

TABLE = """v AS (SELECT own, opponents, (victim + round) % 2 = 0 AS won FROM st), bv AS (SELECT own, opponents, won FROM v UNION ALL SELECT opponents, own, NOT won FROM v),
tb AS (SELECT own, opponents, CASE WHEN own = 0 THEN 0.0 WHEN opponents = 0 THEN 1.0 ELSE (count(*) FILTER (WHERE won) + 0.5) / (count(*) + 1.0) END AS p FROM bv GROUP BY own, opponents)"""


@query("ev_wpa", f"""WITH {ALIVE}, {TABLE}, k AS (SELECT st.killer, coalesce(y.p, 0.5) - CASE WHEN st.own = 0 THEN 0.0 WHEN st.opponents = 0 THEN 1.0 ELSE coalesce(x.p, 0.5) END AS wpa
FROM st LEFT JOIN tb x ON x.own = st.own AND x.opponents = st.opponents LEFT JOIN tb y ON y.own = st.own + 1 AND y.opponents = st.opponents)
SELECT killer, CAST(count(*) AS BIGINT) AS kills, round(sum(wpa), 6) AS wpa FROM k WHERE killer IS NOT NULL GROUP BY killer""")
def ev_wpa(t: Tables):
    states = feed.alive_after(deaths(t), teams(t)).withColumn("won", (F.col("victim") + F.col("round")) % 2 == 0)
    table = feed.state_table(feed.both_views(states))
    values = feed.kill_values(states.drop("won"), table)
    return values.filter("killer is not null").groupBy("killer").agg(F.count(F.lit(1)).alias("kills"), F.round(F.sum("wpa"), 6).alias("wpa"))


@query("ev_timeline", f"""WITH {ALIVE}, {TABLE} SELECT seq, round(CASE WHEN st.team = 0 THEN q ELSE 1 - q END, 6) AS p_side FROM (SELECT st.seq, st.team, CASE WHEN st.own = 0 THEN 0.0 WHEN st.opponents = 0 THEN 1.0 ELSE coalesce(tb.p, 0.5) END AS q
FROM st LEFT JOIN tb ON tb.own = st.own AND tb.opponents = st.opponents) st""")
def ev_timeline(t: Tables):
    """The even side's chance after every death."""
    states = feed.alive_after(deaths(t), teams(t)).withColumn("won", (F.col("victim") + F.col("round")) % 2 == 0)
    return feed.timeline(states, feed.state_table(feed.both_views(states)), F.lit(0)).select("seq", F.round("p_side", 6).alias("p_side"))


@query("rt_rollup", """WITH p AS (SELECT o_orderkey AS series, [1 / (1 + exp(-(o_totalprice - 150000) / (50000.0 + 30000 * i))) FOR i IN range(5)] AS p FROM orders),
w AS (SELECT series, m, list_aggregate([CASE WHEN (m >> i) & 1 = 1 THEN p[i + 1] ELSE 1 - p[i + 1] END FOR i IN range(5)], 'product') AS q FROM p, range(32) t(m) WHERE bit_count(m::INTEGER) >= 3)
SELECT series, round(sum(q), 6) AS p FROM w GROUP BY series""")
def rt_rollup(t: Tables):
    """Chances on five maps rolled up to a best-of-five series."""
    chances = [1 / (1 + F.exp(-(F.col("o_totalprice") - 150000) / (50000.0 + 30000 * i))) for i in range(5)]
    return t("orders").select(F.col("o_orderkey").alias("series"), *(c.alias(f"p{i}") for i, c in enumerate(chances))).select("series", F.round(maps.series_probability([F.col(f"p{i}") for i in range(5)]), 6).alias("p"))


@query("ev_overview", f"WITH {TRADES} SELECT round, CAST(count(*) AS BIGINT) AS deaths, round(avg(CAST(traded AS INT)), 6) AS traded_share, round(avg(CAST(answered AS INT)), 6) AS answered_share FROM tr GROUP BY round")
def ev_overview(t: Tables):
    tr = feed.trades(deaths(t), teams(t))
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(f"{c}_share")
    return tr.groupBy("round").agg(F.count(F.lit(1)).alias("deaths"), share("traded"), share("answered"))


@query("ev_clutch", """WITH e AS (SELECT concat(CAST(CAST(ts AS DATE) AS VARCHAR), '-', CAST(hour(ts) AS VARCHAR)) AS game, CAST(hour(ts) AS INTEGER) AS round, CAST((minute(ts) * 60 + CAST(floor(second(ts)) AS INTEGER)) * 10 AS BIGINT) AS time_ms, event_id AS seq, user_id AS victim FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY time_ms, seq) AS ord FROM e), roster AS (SELECT DISTINCT game, round, victim AS player, victim % 2 AS team FROM e),
once AS (SELECT *, victim % 2 AS team FROM o QUALIFY row_number() OVER (PARTITION BY game, victim ORDER BY ord) = 1), size AS (SELECT game, team, count(*) AS n FROM roster GROUP BY 1, 2),
st AS (SELECT once.game, once.ord, once.team, a.n - count(*) OVER (PARTITION BY once.game, once.team ORDER BY ord) AS own, b.n - (count(*) OVER (PARTITION BY once.game ORDER BY ord) - count(*) OVER (PARTITION BY once.game, once.team ORDER BY ord)) AS opponents
FROM once JOIN size a ON a.game = once.game AND a.team = once.team JOIN size b ON b.game = once.game AND b.team = 1 - once.team),
l AS (SELECT game, ord, team, own, opponents FROM st UNION ALL SELECT game, ord, 1 - team, opponents, own FROM st),
c AS (SELECT game, team, arg_min(opponents, ord) AS opponents FROM l WHERE own = 1 AND opponents BETWEEN 1 AND 4 GROUP BY 1, 2), w AS (SELECT DISTINCT game, round FROM roster)
SELECT opponents, CAST(count(*) AS BIGINT) AS tried, CAST(count(*) FILTER (WHERE team = round % 2) AS BIGINT) AS won FROM c JOIN w USING (game) GROUP BY opponents""")
def ev_clutch(t: Tables):
    """Every round is a game of those who die in it, so that sides shrink to their last survivor."""
    d = deaths(t).withColumn("game", F.concat_ws("-", "game", "round"))
    roster = d.select("game", F.col("victim").alias("player"), (F.col("victim") % 2).alias("team")).distinct()
    winners = d.select("game", "round", (F.col("round") % 2).cast("long").alias("team")).distinct()
    return feed.clutches(d, roster, winners).groupBy("opponents").agg(F.count(F.lit(1)).alias("tried"), F.count_if("won").alias("won"))


@query("ev_winner", """WITH m AS (SELECT CAST(ts AS DATE) AS game, CAST(hour(ts) AS INTEGER) AS round, count(*) FILTER (WHERE user_id % 2 = 0) AS a, count(*) FILTER (WHERE user_id % 2 = 1) AS b FROM events GROUP BY 1, 2)
SELECT game, round, CASE WHEN a > b THEN 100 ELSE 200 END AS team FROM m""")
def ev_winner(t: Tables):
    """A round's side with more events takes it; the box score has the totals, with the sides swapped on odd days."""
    m = t("events").groupBy(F.to_date("ts").alias("game"), F.hour("ts").alias("round")).agg(F.count_if(F.col("user_id") % 2 == 0).alias("a"), F.count_if(F.col("user_id") % 2 == 1).alias("b"))
    w = Window.partitionBy("game").orderBy("round")
    first = (F.col("a") > F.col("b")).cast("int")
    scores = m.select("game", "round", F.sum(first).over(w).alias("s1"), F.sum(1 - first).over(w).alias("s2"))
    odd = F.dayofmonth("game") % 2 == 1
    rounds = scores.select("game", "round", F.when(odd, F.col("s2")).otherwise(F.col("s1")).alias("score1"), F.when(odd, F.col("s1")).otherwise(F.col("s2")).alias("score2"))
    boxes = scores.groupBy("game").agg(F.max("s1").cast("int").alias("box1"), F.max("s2").cast("int").alias("box2"))
    boxes = boxes.select("game", F.lit(100).alias("team1"), F.lit(200).alias("team2"), "box1", "box2", F.when(F.col("box1") > F.col("box2"), 100).otherwise(200).alias("winner"))
    kept = boxes.filter("box1 <> box2")  # equal totals fit both ways
    even = boxes.filter("box1 = box2").select("game")
    laid = feed.round_winners(rounds, kept)
    return laid.unionByName(m.join(even, "game", "left_semi").select("game", "round", F.when(F.col("a") > F.col("b"), 100).otherwise(200).alias("team")))


@query("ev_clock", f"""WITH {TRADES}, b AS (SELECT unnest(range(0, 25)) AS bin), r AS (SELECT DISTINCT game, round FROM o), d AS (SELECT game, round, least(24, time_ms // 1500) AS bin, count(*) AS n FROM o GROUP BY 1, 2, 3),
gr AS (SELECT r.game, r.round, b.bin, coalesce(d.n, 0) AS n FROM r CROSS JOIN b LEFT JOIN d ON d.game = r.game AND d.round = r.round AND d.bin = b.bin),
c AS (SELECT bin, sum(n) OVER (PARTITION BY game, round ORDER BY bin) AS dead FROM gr) SELECT CAST(bin AS INTEGER) AS bin, round(avg(dead), 6) AS mean_dead FROM c GROUP BY bin""")
def ev_clock(t: Tables):
    f = deaths(t)
    bins = F.explode(F.sequence(F.lit(0), F.lit(24))).alias("bin")
    n = f.groupBy("game", "round", F.least(F.lit(24), F.expr("time_ms div 1500")).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = n.select("game", "round").distinct().select("game", "round", bins).join(n, ["game", "round", "bin"], "left")
    dead = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("game", "round").orderBy("bin"))
    return grid.select("bin", dead.alias("dead")).groupBy("bin").agg(F.round(F.avg("dead"), 6).alias("mean_dead"))


@query("seg_table", """WITH c AS (SELECT CAST(least(floor(l_quantity * 5 / 25), 10) AS INTEGER) AS own_cell, CAST(round_even(least(greatest(l_quantity * 5 - l_partkey % 250, -100), 100) / 20, 0) AS INTEGER) AS lead_cell, l_linestatus = 'O' AS won FROM lineitem)
SELECT own_cell, lead_cell, CAST(count(*) AS BIGINT) AS n, round((count(*) FILTER (WHERE won) + 0.5) / (count(*) + 1), 6) AS p FROM c GROUP BY 1, 2""")
def seg_table(t: Tables):
    own, lead = maps.hill_cell(F.col("l_quantity") * 5, F.col("l_partkey") % 250)
    c = t("lineitem").select(own.alias("own_cell"), lead.alias("lead_cell"), (F.col("l_linestatus") == "O").alias("won"))
    return c.groupBy("own_cell", "lead_cell").agg(F.count(F.lit(1)).alias("n"), F.round((F.count_if("won") + 0.5) / (F.count(F.lit(1)) + 1), 6).alias("p"))


@query("seg_types", "SELECT l_returnflag AS win_type, round(avg(abs(l_discount - lagged)), 6) AS mean_swing FROM (SELECT l_returnflag, l_discount, lag(l_discount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS lagged FROM lineitem) WHERE lagged IS NOT NULL GROUP BY 1")
def seg_types(t: Tables):
    before = F.lag("l_discount").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey"))
    return t("lineitem").select(F.col("l_returnflag").alias("win_type"), F.abs(F.col("l_discount") - before).alias("swing")).filter("swing is not null").groupBy("win_type").agg(F.round(F.avg("swing"), 6).alias("mean_swing"))


@query("sd_events", """WITH m AS (SELECT o_custkey AS series, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_totalprice > 150000 AS won FROM orders),
b AS (SELECT *, coalesce(sum(CAST(won AS INT)) OVER x, 0) AS w, coalesce(sum(CAST(NOT won AS INT)) OVER x, 0) AS l FROM m WINDOW x AS (PARTITION BY series ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT series, string_agg(CASE WHEN won THEN '1' ELSE '0' END, '' ORDER BY n) AS path, greatest(count(*) FILTER (WHERE won), count(*) FILTER (WHERE NOT won)) AS top FROM b WHERE w < 3 AND l < 3 GROUP BY series)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE length(path) = 3) AS BIGINT) AS sweeps, CAST(count(*) FILTER (WHERE length(path) = 5) AS BIGINT) AS deciders,
CAST(count(*) FILTER (WHERE path IN ('00111', '11000')) AS BIGINT) AS reverse_sweeps, CAST(count(*) FILTER (WHERE path[1] = path[length(path)]) AS BIGINT) AS first_map FROM p WHERE top = 3""")
def sd_events(t: Tables):
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return maps.dynamics(maps.paths(t("orders").select(F.col("o_custkey").alias("series"), nth.alias("ordinal"), (F.col("o_totalprice") > 150000).alias("won"))))


_GAIN = lambda i, j: f"16 * (s.y - 1 / (1 + pow(10, ({j} - {i}) / 400)))"


@query("rt_mapelo", f"""WITH RECURSIVE s AS (SELECT o_orderpriority AS pool, o_orderkey AS map, CAST(o_orderkey % 3 AS INTEGER) AS mode, CAST(o_custkey % 25 AS INTEGER) + 1 AS a, CAST(o_orderkey % 25 AS INTEGER) + 1 AS b, CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END::DOUBLE AS y,
row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_custkey % 25 <> o_orderkey % 25),
f AS (SELECT DISTINCT pool, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS map, CAST(NULL AS DOUBLE) AS pa, CAST(NULL AS DOUBLE) AS pm, CAST(NULL AS DOUBLE) AS seen,
list_resize(CAST([] AS DOUBLE[]), 25, 1500.0::DOUBLE) AS r, list_resize(CAST([] AS DOUBLE[]), 75, 1500.0::DOUBLE) AS m, list_resize(CAST([] AS DOUBLE[]), 75, 0.0::DOUBLE) AS n FROM s
UNION ALL SELECT f.pool, s.rn, s.map, 1 / (1 + pow(10, (f.r[s.b] - f.r[s.a]) / 400)), 1 / (1 + pow(10, (f.m[25 * s.mode + s.b] - f.m[25 * s.mode + s.a]) / 400)), least(f.n[25 * s.mode + s.a], f.n[25 * s.mode + s.b]),
[CASE WHEN i = s.a THEN f.r[i] + {_GAIN("f.r[s.a]", "f.r[s.b]")} WHEN i = s.b THEN f.r[i] - {_GAIN("f.r[s.a]", "f.r[s.b]")} ELSE f.r[i] END FOR i IN range(1, 26)],
[CASE WHEN i = 25 * s.mode + s.a THEN f.m[i] + {_GAIN("f.m[25 * s.mode + s.a]", "f.m[25 * s.mode + s.b]")} WHEN i = 25 * s.mode + s.b THEN f.m[i] - {_GAIN("f.m[25 * s.mode + s.a]", "f.m[25 * s.mode + s.b]")} ELSE f.m[i] END FOR i IN range(1, 76)],
[CASE WHEN i = 25 * s.mode + s.a OR i = 25 * s.mode + s.b THEN f.n[i] + 1 ELSE f.n[i] END FOR i IN range(1, 76)] FROM f JOIN s ON s.pool = f.pool AND s.rn = f.rn + 1)
SELECT map, round(pa, 6) AS p_all, round(pm, 6) AS p_mode, round(seen / (seen + 40) * pm + (1 - seen / (seen + 40)) * pa, 6) AS p FROM f WHERE map IS NOT NULL""")
def rt_mapelo(t: Tables):
    rows = series(t).withColumnRenamed("series", "map").withColumn("mode", F.col("map") % 3)
    return maps.map_elo(rows).select("map", *(F.round(c, 6).alias(c) for c in ("p_all", "p_mode", "p")))


_STEPS = ELO[ELO.index("f AS (") :]
_SWEPT = {k: _STEPS.replace("32 *", f"{k} *").replace("f AS (", f"f{k} AS (").replace("f.", f"f{k}.").replace("FROM f JOIN", f"FROM f{k} JOIN") for k in (16, 32, 64)}


@query("rt_sweep", ELO[: ELO.index("f AS (")] + ", ".join(_SWEPT.values()) + " " + " UNION ALL ".join(
    f"SELECT CAST({k} AS DOUBLE) AS k, CAST(count(*) AS BIGINT) AS n, round(avg(pow(f.p - s.y, 2)), 6) AS brier FROM f{k} f JOIN s ON s.series = f.series" for k in _SWEPT
))
def rt_sweep(t: Tables):
    rows = series(t)
    out = None
    for k in (16.0, 32.0, 64.0):
        scored = ratings.elo(rows, k).join(rows.select("series", F.col("a_won").alias("won")), "series").withColumn("k", F.lit(k))
        one = ratings.backtest(scored, ["k"]).select("k", "n", F.round("brier", 6).alias("brier"))
        out = one if out is None else out.unionByName(one)
    return out


@query("pr_diffs", """WITH s AS (SELECT l_orderkey AS game, l_suppkey % 2 AS side, sum(l_quantity) AS k, sum(l_linenumber) AS d, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2)
SELECT a.game, round(a.k / a.d - b.k / b.d, 6) AS kd, round(a.x / a.k - b.x / b.k + 1e-4, 2) AS damage FROM s a JOIN s b ON a.game = b.game AND a.side = 0 AND b.side = 1 WHERE a.k > 0 AND b.k > 0""")
def pr_diffs(t: Tables):
    s = t("lineitem").groupBy(F.col("l_orderkey").alias("game")).agg(*(F.sum(F.when(F.col("l_suppkey") % 2 == side, F.col(c))).alias(f"{n}{side}") for side in (0, 1) for n, c in (("k", "l_quantity"), ("d", "l_linenumber"), ("x", "l_extendedprice"))))
    both = s.filter("k0 > 0 and k1 > 0 and d0 > 0 and d1 > 0")  # one aggregate gives both sides of a map
    return both.select("game", F.round(F.col("k0") / F.col("d0") - F.col("k1") / F.col("d1"), 6).alias("kd"), F.round(F.col("x0") / F.col("k0") - F.col("x1") / F.col("k1") + 1e-4, 2).alias("damage"))


@query("pr_weights", f"""WITH s AS (SELECT l_orderkey AS game, l_suppkey % 2 AS side, sum(l_quantity) AS k, sum(l_linenumber) AS d, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2),
g AS (SELECT a.game, round(a.k / a.d - b.k / b.d, 6) AS kd, round(a.x / a.k - b.x / b.k + 1e-4, 2) AS damage FROM s a JOIN s b ON a.game = b.game AND a.side = 0 AND b.side = 1 WHERE a.k > 0 AND b.k > 0),
j AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, o_orderpriority AS mode, kd, damage, CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END AS y FROM g JOIN orders ON game = o_orderkey),
d AS MATERIALIZED (SELECT season, mode, y, (kd - avg(kd) OVER w) / stddev_samp(kd) OVER w AS x1, (damage - avg(damage) OVER w) / stddev_samp(damage) OVER w AS x2 FROM j WINDOW w AS (PARTITION BY season, mode)),
{newton_sql(10, "season, mode")} SELECT season, mode, CAST(n AS BIGINT) AS n, round(w0, 5) AS intercept, round(w1, 5) AS kd, round(w2, 5) AS damage FROM b10""")
def pr_weights(t: Tables):
    """A regression of map results on the sides' differences for every season and mode, each on its own scale."""
    games = t("orders").select(F.col("o_orderkey").alias("game"), F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("mode"), (F.col("o_totalprice") > 150000).alias("won"))
    d = pr_diffs(t).join(games, "game").select("season", "mode", "won", "kd", "damage")
    scaled = ratings.standardised(d, ["season", "mode"], ["kd", "damage"])
    fitted = ratings.logistic_by(scaled, ["season", "mode"], ["kd", "damage"], "won")
    return fitted.select("season", "mode", "n", *(F.round(c, 5).alias(c) for c in ("intercept", "kd", "damage")))


Z = f"""{_SCORED}, zz AS (SELECT player, season, mode, metric, denom, CASE WHEN n >= 15 AND sd > 1e-9 THEN (value - m) / sd END AS z, CASE WHEN n >= 2 AND sd > 1e-9 THEN below / n END AS pctl FROM c)"""


@query("pr_score", f"""{Z} SELECT player, season, round((0.6 * max(z) FILTER (WHERE metric = 'kd') + 0.4 * max(z) FILTER (WHERE metric = 'damage_pm')) * 0.15 * (max(denom) FILTER (WHERE metric = 'kd') / (max(denom) FILTER (WHERE metric = 'kd') + 15)) + 1, 6) AS rating
FROM zz WHERE mode IS NULL AND metric IN ('kd', 'damage_pm') GROUP BY 1, 2""")
def pr_score(t: Tables):
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    rows = metric_layer(t, "kd", "damage_pm").filter("mode is null").groupBy("player", "season")
    n = of("kd", "denom")
    return rows.agg(F.round((0.6 * of("kd", "z") + 0.4 * of("damage_pm", "z")) * 0.15 * (n / (n + 15)) + 1, 6).alias("rating"))


FAMILIES = {"kd": "slaying", "kills_pm": "slaying", "damage_pm": "slaying", "assists_pm": "support", "suicides_pm": "support", "hill_time_pm": "objective", "snd_plants_pr": "objective"}
_FAMILY = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{f}'" for m, f in FAMILIES.items()) + " END"


@query("cr_breadth", f"""{Z}, f AS (SELECT player, season, mode, {_FAMILY} AS family, avg(pctl) AS p FROM zz WHERE mode IS NOT NULL AND pctl IS NOT NULL AND {_FAMILY} IS NOT NULL GROUP BY 1, 2, 3, 4),
g AS (SELECT player, season, mode, avg(p) AS p FROM f GROUP BY 1, 2, 3), m AS (SELECT player, season, mode, max(maps) AS maps FROM s WHERE mode IS NOT NULL GROUP BY 1, 2, 3)
SELECT player, season, round(sum(p * maps) / sum(maps) * sum(maps) / (sum(maps) + 21.87), 6) AS breadth FROM g JOIN m USING (player, season, mode) GROUP BY 1, 2""")
def cr_breadth(t: Tables):
    family = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))[F.col("metric")]
    rows = metric_layer(t, *FAMILIES).filter("mode is not null and pctl is not null").withColumn("family", family)
    g = rows.groupBy("player", "season", "mode", "family").agg(F.avg("pctl").alias("p")).groupBy("player", "season", "mode").agg(F.avg("p").alias("p"))
    maps_ = box_lines(t).groupBy("player", "season", "mode").agg(F.count(F.lit(1)).alias("maps"))
    total = F.sum("maps")
    return g.join(maps_, ["player", "season", "mode"]).groupBy("player", "season").agg(F.round(F.sum(F.col("p") * F.col("maps")) / total * total / (total + 21.87), 6).alias("breadth"))


@query("cr_value", CAREER + """, k AS (SELECT player, season, credit, CAST(player % 17 AS DOUBLE) AS other FROM c)
SELECT player, season, round(avg(other) OVER w + (credit - avg(credit) OVER w) / nullif(stddev_samp(credit) OVER w, 0) * stddev_samp(other) OVER w, 6) AS mapped FROM k WINDOW w AS (PARTITION BY season)""")
def cr_value(t: Tables):
    """A value laid on another scale within its season: same mean and spread."""
    w = Window.partitionBy("season")
    k = season_credit(t).withColumn("other", (F.col("player") % 17).cast("double"))
    mapped = F.avg("other").over(w) + (F.col("credit") - F.avg("credit").over(w)) / F.nullif(F.stddev_samp("credit").over(w), F.lit(0.0)) * F.stddev_samp("other").over(w)
    return k.select("player", "season", F.round(mapped, 6).alias("mapped"))


LOBBY = "p AS (SELECT DISTINCT l_orderkey AS game, l_suppkey AS player, l_suppkey % 2 AS side, CAST(year(l_shipdate) AS INTEGER) AS season FROM lineitem), v AS (SELECT player, season, avg(kills) AS value FROM lines GROUP BY 1, 2)"


def lobby_values(t: Tables):
    p = t("lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("player"), (F.col("l_suppkey") % 2).alias("side"), F.year("l_shipdate").alias("season")).distinct()
    v = lines(t).groupBy("player", "season").agg(F.avg("kills").alias("value"))
    return p.join(v, ["player", "season"])


@query("cr_mates", f"""WITH {LINES}, {LOBBY}, x AS (SELECT p.*, value FROM p JOIN v USING (player, season))
SELECT a.player, a.season, round(max(a.value) - avg(b.value), 6) AS over_mates, CAST(count(*) AS BIGINT) AS shared FROM x a JOIN x b ON a.game = b.game AND a.season = b.season AND a.side = b.side AND a.player <> b.player GROUP BY 1, 2""")
def cr_mates(t: Tables):
    x = lobby_values(t)
    side = x.groupBy("game", "season", "side").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))  # a player is once on a side, so mates are the side less the player
    own = x.join(side, ["game", "season", "side"]).groupBy("player", "season").agg(F.max("value").alias("value"), F.sum(F.col("total") - F.col("value")).alias("mates"), F.sum(F.col("n") - 1).alias("shared"))
    return own.filter("shared > 0").select("player", "season", F.round(F.col("value") - F.col("mates") / F.col("shared"), 6).alias("over_mates"), "shared")


@query("cr_opp", f"""WITH {LINES}, {LOBBY}, x AS (SELECT p.*, value FROM p JOIN v USING (player, season)), s AS (SELECT game, season, side, avg(value) AS team_value FROM x GROUP BY 1, 2, 3)
SELECT a.player, a.season, round(avg(s.team_value), 6) AS faced FROM x a JOIN s ON a.game = s.game AND a.season = s.season AND a.side <> s.side GROUP BY 1, 2""")
def cr_opp(t: Tables):
    x = lobby_values(t)
    s = x.groupBy("game", "season", (1 - F.col("side")).alias("side")).agg(F.avg("value").alias("team_value"))
    return x.join(s, ["game", "season", "side"]).groupBy("player", "season").agg(F.round(F.avg("team_value"), 6).alias("faced"))


@query("role_dominance", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id AS player, arg_min(event_type, (-n, event_type)) AS role, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS dominance FROM c GROUP BY 1")
def role_dominance(t: Tables):
    c = t("events").groupBy(F.col("user_id").alias("player"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("player").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("role"), F.round(F.max("n") / F.sum("n"), 6).alias("dominance"))


@query("oa_rung1", f"""WITH {LINES}, x AS (SELECT season, player, kills, CAST(game % 101 AS DOUBLE) AS opp FROM lines), b AS (SELECT season, regr_slope(kills, opp) AS slope, avg(opp) AS mid FROM x GROUP BY season)
SELECT player, season, round(avg(kills - slope * (opp - mid)), 6) AS adjusted FROM x JOIN b USING (season) GROUP BY 1, 2""")
def oa_rung1(t: Tables):
    """Values less what the opponents' strength explains, by one slope a season."""
    x = lines(t).select("season", "player", "kills", (F.col("game") % 101).cast("double").alias("opp"))
    b = x.groupBy("season").agg(F.regr_slope("kills", "opp").alias("slope"), F.avg("opp").alias("mid"))
    return x.join(b, "season").groupBy("player", "season").agg(F.round(F.avg(F.col("kills") - F.col("slope") * (F.col("opp") - F.col("mid"))), 6).alias("adjusted"))


@query("ctx_stakes", r"""SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)promo.*brass') THEN 'final' WHEN regexp_matches(p_type, '(?i)promo|economy') THEN 'bracket' WHEN regexp_matches(p_type, '(?i)^standard') THEN 'pool' ELSE 'other' END AS stakes FROM part""")
def ctx_stakes(t: Tables):
    kind = F.col("p_type")
    return t("part").select("p_partkey", F.when(kind.rlike("(?i)promo.*brass"), "final").when(kind.rlike("(?i)promo|economy"), "bracket").when(kind.rlike("(?i)^standard"), "pool").otherwise("other").alias("stakes"))


@query("ctx_pooling", f"WITH {LINES}, g AS (SELECT mode, player % 40 AS map, count(*) AS n, avg(kills) AS m FROM lines GROUP BY 1, 2 HAVING count(*) >= 5), o AS (SELECT mode, avg(kills) AS mu FROM lines GROUP BY 1) SELECT mode, map, round(mu + n / (n + 20.0) * (m - mu), 6) AS effect FROM g JOIN o USING (mode)")
def ctx_pooling(t: Tables):
    g = lines(t).groupBy("mode", (F.col("player") % 40).alias("map")).agg(F.count(F.lit(1)).alias("n"), F.avg("kills").alias("m")).filter("n >= 5")
    o = lines(t).groupBy("mode").agg(F.avg("kills").alias("mu"))
    return g.join(o, "mode").select("mode", "map", F.round(F.col("mu") + F.col("n") / (F.col("n") + 20.0) * (F.col("m") - F.col("mu")), 6).alias("effect"))


_NUMBER = "CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7)) AS BIGINT) AS k"
_MIX = "(((k * 48271 + r * 16807) % 2147483647) * ((k * 48271 + r * 16807) % 2147483647) % 2147483647 + k) % 2147483647"


@query("st_pair", f"""WITH d AS (SELECT o_orderkey, o_orderpriority AS pool, pow(1 / (1 + exp(-(o_totalprice - 150000) / 100000)) - CAST(o_custkey % 3 > 0 AS INT), 2) - 0.25 AS gap, {_NUMBER} FROM orders),
y AS (SELECT pool, gap, r, {_MIX} AS m FROM d, range(1, 2001) t(r)), x AS (SELECT *, (m * m % 2147483647) >> 15 AS u FROM y), w AS (SELECT pool, r, gap, CASE WHEN u < 24109 THEN 0 WHEN u < 48218 THEN 1 WHEN u < 60273 THEN 2 WHEN u < 64291 THEN 3 ELSE 4 END AS w FROM x),
m AS (SELECT pool, r, sum(w * gap) / nullif(sum(w), 0) AS m FROM w GROUP BY 1, 2), s AS (SELECT pool, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
SELECT pool, a.n, round(a.mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS excludes_zero, round(a.mean / se, 5) AS dm_t, round(2.801585 * se, 6) AS mde80
FROM (SELECT pool, count(*) AS n, avg(gap) AS mean, stddev_samp(gap) / sqrt(count(*)) AS se FROM d GROUP BY 1) a JOIN s USING (pool)""")
def st_pair(t: Tables):
    """The gap of two forecasts' Brier scores: an interval from content-seeded resampling, the Diebold-Mariano statistic, the gap that could be found."""
    p = 1 / (1 + F.exp(-(F.col("o_totalprice") - 150000) / 100000))
    d = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("pool"), (F.pow(p - (F.col("o_custkey") % 3 > 0).cast("int"), F.lit(2.0)) - 0.25).alias("gap"))
    found = resample.paired_gaps(d, "o_orderkey", "gap", ["pool"])
    return found.select("pool", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")), "excludes_zero", F.round("dm_t", 5).alias("dm_t"), F.round("mde80", 6).alias("mde80"))


@query("val_overlap", CAREER + """, a AS (SELECT player, season, credit, row_number() OVER (PARTITION BY season ORDER BY credit DESC, player) AS rk, row_number() OVER (PARTITION BY season ORDER BY player % 13 DESC, player) AS award, count(*) OVER (PARTITION BY season) AS field FROM c)
SELECT season, CAST(count(*) FILTER (WHERE rk <= 10 AND award <= 10) AS BIGINT) AS hits, round(100.0 / max(field), 6) AS expected FROM a GROUP BY season""")
def val_overlap(t: Tables):
    """How many of a season's ten awards go to its ten best, beside what chance would give."""
    w = Window.partitionBy("season")
    a = season_credit(t).select("season", F.row_number().over(w.orderBy(F.desc("credit"), "player")).alias("rk"), F.row_number().over(w.orderBy(F.desc(F.col("player") % 13), "player")).alias("award"), F.count(F.lit(1)).over(w).alias("field"))
    return a.groupBy("season").agg(F.count_if((F.col("rk") <= 10) & (F.col("award") <= 10)).alias("hits"), F.round(100.0 / F.max("field"), 6).alias("expected"))


@query("ev_hold", CAREER + """, d AS (SELECT credit, lead(credit) OVER w AS nc, season, lead(season) OVER w AS ns FROM c WINDOW w AS (PARTITION BY player ORDER BY season)) SELECT round(corr(credit, nc), 6) AS persistence, CAST(count(*) AS BIGINT) AS pairs FROM d WHERE ns = season + 1""")
def ev_hold(t: Tables):
    w = Window.partitionBy("player").orderBy("season")
    d = season_credit(t).withColumns({"nc": F.lead("credit").over(w), "ns": F.lead("season").over(w)}).filter("ns = season + 1")
    return d.agg(F.round(F.corr("credit", "nc"), 6).alias("persistence"), F.count(F.lit(1)).alias("pairs"))


@query("snk_snap", f"WITH {LINES}, s AS (SELECT player, mode, round(sum(kills), 2) AS kills, CAST(sum(deaths) AS DOUBLE) AS deaths FROM lines GROUP BY GROUPING SETS ((player, mode), (player))) SELECT 'lines/' || player || '/' || coalesce(mode, 'all') || '/' || name AS path, value FROM (SELECT player, mode, unnest(['kills', 'deaths']) AS name, unnest([kills, deaths]) AS value FROM s)")
def snk_snap(t: Tables):
    sets = lines(t).groupingSets([["player", "mode"], ["player"]], "player", "mode").agg(F.round(F.sum("kills"), 2).alias("kills"), F.sum("deaths").cast("double").alias("deaths"))
    return runs.long_numbers(sets, ["player", "mode"], ["kills", "deaths"], "lines")


@query("rp_team", f"WITH {LINES}, g AS (SELECT player % 25 AS team, season, count(DISTINCT game) AS maps, round(avg(kills), 6) AS kills_value, round(avg(damage) + 1e-6, 4) AS damage_value FROM lines GROUP BY 1, 2) SELECT team, season, CAST(maps AS BIGINT) AS maps, kills_value, damage_value FROM g WHERE maps >= 8")
def rp_team(t: Tables):
    g = lines(t).groupBy((F.col("player") % 25).alias("team"), "season").agg(F.count_distinct("game").alias("maps"), F.round(F.avg("kills"), 6).alias("kills_value"), F.round(F.avg("damage") + 1e-6, 4).alias("damage_value"))
    return g.filter("maps >= 8")


@query("rd_spread", f"WITH {LINES} SELECT season, mode, round(min(v), 6) AS low, round(quantile_cont(v, 0.5), 6) AS mid, round(max(v), 6) AS high FROM (SELECT season, mode, player, sum(kills) / sum(deaths) AS v FROM lines GROUP BY 1, 2, 3) GROUP BY 1, 2")
def rd_spread(t: Tables):
    v = lines(t).groupBy("season", "mode", "player").agg((F.sum("kills") / F.sum("deaths")).alias("v"))
    return v.groupBy("season", "mode").agg(F.round(F.min("v"), 6).alias("low"), F.round(F.percentile("v", 0.5), 6).alias("mid"), F.round(F.max("v"), 6).alias("high"))


@query("qa_cov", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN value > 100 THEN 1 ELSE 0 END), 6) AS valued, round(avg(CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 1 ELSE 0 END), 6) AS keyed FROM events GROUP BY 1")
def qa_cov(t: Tables):
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") > 100).cast("int")), 6).alias("valued"), F.round(F.avg(F.get_json_object("props", "$.k").isNotNull().cast("int")), 6).alias("keyed"))


@query("rt_contrast", """WITH pr AS (SELECT o_orderpriority AS pool, 1 / (1 + exp(-(o_totalprice - 150000) / 100000)) AS p, o_custkey % 3 > 0 AS won FROM orders) SELECT pool, round(avg(pow(p - CAST(won AS INT), 2) - pow(0.5 - CAST(won AS INT), 2)), 6) AS gap FROM pr GROUP BY 1""")
def rt_contrast(t: Tables):
    y = F.col("won").cast("int")
    return predictions(t).groupBy("pool").agg(F.round(F.avg(F.pow(F.col("p") - y, F.lit(2.0)) - F.pow(F.lit(0.5) - y, F.lit(2.0))), 6).alias("gap"))
