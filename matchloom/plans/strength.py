"""Queries of line-ups, series, segments, skills and two-level models."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators import feed, hierarchy, lineups, resample, rounds, segments, skills
from matchloom.operators import series as races
from matchloom.plans.aggregates import LINES, lines
from matchloom.plans.base import Tables, query
from matchloom.plans.models import ALIVE, deaths, series, spread_sql, teams

# --- series -------------------------------------------------------------------------------------------------------


@query("sd_load", """WITH m AS (SELECT l_orderkey AS series, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS n, CASE WHEN l_discount > 0.01 THEN CASE WHEN l_quantity > 25 THEN 1 ELSE 2 END END AS winner FROM lineitem),
o AS (SELECT series, n + CASE WHEN series % 7 = 0 AND n > 1 THEN 1 ELSE 0 END AS ordinal, winner, count(*) FILTER (WHERE winner = 1) OVER w AS s1, count(*) FILTER (WHERE winner = 2) OVER w + CASE WHEN series % 10 = 0 THEN 1 ELSE 0 END AS s2 FROM m WINDOW w AS (PARTITION BY series)),
s AS (SELECT series, count(*) AS n, count(winner) AS decided, count(DISTINCT ordinal) AS d, min(ordinal) AS lo, max(ordinal) AS hi, count(*) FILTER (WHERE winner = 1) AS w1, any_value(s1) AS s1, any_value(s2) AS s2 FROM o GROUP BY series),
r AS (SELECT CASE WHEN decided < n THEN 'undecided_map' WHEN d < n OR lo <> 1 OR hi <> n THEN 'ordinal_gap' WHEN w1 <> s1 OR n - w1 <> s2 THEN 'score_mismatch' WHEN greatest(s1, s2) <> 3 THEN 'best_of_' || CAST(2 * greatest(s1, s2) - 1 AS VARCHAR) ELSE 'admitted' END AS reason FROM s WHERE s1 <> s2)
SELECT reason, CAST(count(*) AS BIGINT) AS series FROM r GROUP BY reason""")
def sd_load(t: Tables):
    """Which series are admitted; one in seven misses a map, one in ten has another score than its maps, one map in ten is undecided."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    winner = F.when(F.col("l_discount") > 0.01, F.when(F.col("l_quantity") > 25, 1).otherwise(2))
    m = t("lineitem").select(F.col("l_orderkey").alias("series"), F.row_number().over(order).alias("n"), winner.alias("winner"))
    whole = Window.partitionBy("series")
    m = m.select(
        "series", (F.col("n") + F.when((F.col("series") % 7 == 0) & (F.col("n") > 1), 1).otherwise(0)).alias("ordinal"), "winner", F.lit(1).alias("first"), F.count_if(F.col("winner") == 1).over(whole).alias("score1"),
        (F.count_if(F.col("winner") == 2).over(whole) + F.when(F.col("series") % 10 == 0, 1).otherwise(0)).alias("score2"),
    )
    return races.admitted(m).groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("series"))


def _races_sql() -> str:
    """Every sequence of five results, and the events of the race that it decides: a table of 32 rows."""
    rows = []
    for bits in product((0, 1), repeat=5):
        length = next(n for n in range(3, 6) if 3 in (sum(bits[:n]), n - sum(bits[:n])))
        path = bits[:length]
        won = int(sum(path) == 3)
        rows.append(f"([{', '.join(map(str, bits))}], {won}, {int(path[0] == won)}, {int(length == 3)}, {int(length == 5)}, {int(all(x != won for x in path[:2]))})")
    return f"(VALUES {', '.join(rows)}) races(bits, first_side_won, first_map_winner_won, sweep, decider, reverse_sweep)"


_NODES = "(VALUES " + ", ".join(f"({u!r}::DOUBLE, {w!r}::DOUBLE)" for u, w in zip(*(x.tolist() for x in races.gauss_hermite()))) + ") nodes(u, w)"


@query("sd_expected", f"""WITH p AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, w, [1 / (1 + exp(-(0.8 * (o_totalprice - 250000) / (150000.0 + 30000 * i) + 0.5 * u))) FOR i IN range(5)] AS p FROM orders, {_NODES}),
q AS (SELECT season, races.*, w * list_aggregate([CASE WHEN b[1] = 1 THEN b[2] ELSE 1 - b[2] END FOR b IN list_zip(races.bits, p.p)], 'product') AS q FROM p, {_races_sql()})
SELECT season, {', '.join(f'round(sum(q * {e}), 4) AS {e}' for e in races.EVENTS)} FROM q GROUP BY season""")
def sd_expected(t: Tables):
    """Sweeps, deciders and comebacks that a season's series would have without memory, with quality that the strengths miss."""
    logits = F.array(*((F.col("o_totalprice") - 250000) / (150000.0 + 30000 * i) for i in range(5)))
    rotations = t("orders").select(F.year("o_orderdate").alias("season"), "o_orderkey", logits.alias("logits"))
    return races.race_chances(rotations, ["season"], a=0.8, sigma=0.5).select("season", *(F.round(e, 4).alias(e) for e in races.EVENTS))


_RACE = """m AS (SELECT o_custkey AS series, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_totalprice > 250000 AS won FROM orders),
b AS (SELECT *, coalesce(sum(CAST(won AS INT)) OVER x, 0) AS w, coalesce(sum(CAST(NOT won AS INT)) OVER x, 0) AS l, lag(won) OVER (PARTITION BY series ORDER BY n) AS before FROM m WINDOW x AS (PARTITION BY series ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT series, n, CAST(won AS DOUBLE) AS won, ((series * 7 + n * 3) % 21 - 10) / 10.0 AS x, CASE WHEN before IS NULL THEN 0 WHEN before THEN 1 ELSE -1 END AS prev FROM b WHERE w < 3 AND l < 3)"""
POINTS = [(1.0, 0.5, 0.0), (0.2, 0.3, 0.1), (0.5, 1.2, -0.4)]


def race_rows(t: Tables):
    """Customers' orders as maps of a series, up to where a side has three, with strengths."""
    order = Window.partitionBy("series").orderBy("o_orderdate", "o_orderkey")
    m = t("orders").select(F.col("o_custkey").alias("series"), "o_orderdate", "o_orderkey", (F.col("o_totalprice") > 250000).cast("int").alias("won")).withColumn("n", F.row_number().over(order))
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    live = m.withColumns({"w": F.coalesce(F.sum("won").over(past), F.lit(0)), "l": F.coalesce(F.sum(1 - F.col("won")).over(past), F.lit(0))}).filter("w < 3 and l < 3")
    strength = ((F.col("series") * 7 + F.col("n") * 3) % 21 - 10) / 10.0
    g = live.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("n", strength.cast("double").alias("x"), F.col("won").cast("double").alias("won")))).alias("m"))
    return g.select("series", F.transform("m", lambda x: x["x"]).alias("strength"), F.transform("m", lambda x: x["won"]).alias("won"))


@query("sd_loglik", f"""WITH {_RACE}, p AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {s}::DOUBLE, {g}::DOUBLE)' for a, s, g in POINTS)}) p(a, sigma, gamma)),
s AS (SELECT series, a, sigma, gamma, any_value(w) AS w, sum(won * eta - ln(1 + exp(eta))) AS ll FROM (SELECT series, a, sigma, gamma, u, w, won, a * x + gamma * prev + sigma * u AS eta FROM r, p, {_NODES}) GROUP BY series, a, sigma, gamma, u),
q AS (SELECT series, a, sigma, gamma, ln(sum(w * exp(ll))) AS ll FROM s GROUP BY series, a, sigma, gamma) SELECT a, sigma, gamma, round(sum(ll), 4) AS loglik FROM q GROUP BY a, sigma, gamma""")
def sd_loglik(t: Tables):
    """The likelihood of all series at three settings, unmeasured quality integrated out."""
    found = races.log_likelihoods(race_rows(t), POINTS)
    return t.spark.createDataFrame([(*p, round(v[0], 4)) for p, v in zip(POINTS, found)], "a double, sigma double, gamma double, loglik double")


@query("sd_mixed")
def sd_mixed(t: Tables):
    """Momentum between maps beside unmeasured quality: the fit, the fit without momentum, the interval."""
    found = races.momentum(race_rows(t))
    return t.spark.createDataFrame([tuple(round(float(v), 4) for v in found.values())], ", ".join(f"{k} double" for k in found))


# --- line-ups -----------------------------------------------------------------------------------------------------

_SIDES = """ln AS (SELECT DISTINCT l_orderkey AS game, l_linenumber % 2 + 2 * (o_custkey % 12) AS team, l_suppkey AS player, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderpriority AS title, o_totalprice, o_orderkey % 50 = 0 AS undecided FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sd AS (SELECT game, team, any_value(season) AS season, any_value(title) AS title, count(*) AS size, any_value(undecided) AS undecided, list_sort(list(player)) AS players FROM ln GROUP BY game, team),
md AS (SELECT title, arg_max(size, n * 1000 - size) AS full_size FROM (SELECT title, size, count(*) AS n FROM sd GROUP BY title, size) GROUP BY title),
gm AS (SELECT game, any_value(season) AS season, any_value(title) AS title, count(*) AS teams, min(size) AS lo, max(size) AS hi, any_value(undecided) AS undecided FROM sd GROUP BY game),
ad AS (SELECT game, season, CASE WHEN undecided THEN 'undecided' WHEN teams <> 2 THEN 'not_two_teams' WHEN lo <> full_size OR hi <> full_size THEN 'side_size' ELSE 'admitted' END AS reason FROM gm JOIN md USING (title))"""


def lineup_lines(t: Tables):
    """An order is a map of two of 24 teams, whose suppliers of even and odd lines are the sides; the total price gives the margin."""
    orders = t("orders").select(F.col("o_orderkey").alias("game"), "o_custkey", F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("title"), "o_totalprice")
    rows = t("lineitem").select(F.col("l_orderkey").alias("game"), (F.col("l_linenumber") % 2).alias("side"), F.col("l_suppkey").alias("player")).distinct().join(orders, "game")
    margin = F.round((F.col("o_totalprice") - 250000) / 2000).cast("int") * F.when(F.col("side") == 0, 1).otherwise(-1)
    return rows.select("game", "title", "season", F.lit("all").alias("mode"), (F.col("side") + 2 * (F.col("o_custkey") % 12)).alias("team"), "player", F.when(F.col("game") % 50 != 0, margin > 0).alias("won"), margin.alias("margin"))


def admitted(t: Tables):
    return lineups.admitted_maps(lineup_lines(t)).filter("reason is null and margin <> 0")


@query("rapm_admission", f"WITH {_SIDES} SELECT season, reason, CAST(count(*) AS BIGINT) AS maps FROM ad GROUP BY season, reason")
def rapm_admission(t: Tables):
    return lineups.admitted_maps(lineup_lines(t)).groupBy("season", F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("maps"))


@query("ss_supply", f"""WITH {_SIDES}, c AS (SELECT sd.season, team, players, count(*) AS n FROM sd JOIN ad USING (game) WHERE reason = 'admitted' GROUP BY sd.season, team, players)
SELECT season, team, CAST(sum(n) AS BIGINT) AS maps, CAST(count(*) AS BIGINT) AS lineups, round(exp(ln(sum(n)) - sum(n * ln(n)) / sum(n)), 5) AS effective, round(max(n) / sum(n), 6) AS modal_share FROM c GROUP BY season, team""")
def ss_supply(t: Tables):
    """How much variety of line-ups each team-season supplies."""
    supply = lineups.lineup_supply(lineups.admitted_maps(lineup_lines(t)).filter("reason is null"))
    return supply.select("season", F.col("team").cast("long").alias("team"), "maps", "lineups", F.round("effective", 5).alias("effective"), F.round("modal_share", 6).alias("modal_share"))


@query("rapm")
def rapm(t: Tables):
    """Plus-minus of map results: a logistic ridge on line-ups, with errors and the share of maps with the most frequent mate."""
    return lineups.plus_minus(admitted(t)).select("player", "maps", F.round("value", 5).alias("value"), F.round("se", 5).alias("se"), F.round("mates", 5).alias("mates"))


@query("ss_fit")
def ss_fit(t: Tables):
    """State-space plus-minus over seasons, its penalties chosen by generalised cross-validation."""
    maps = admitted(t).cache()
    order = maps.select(F.col("season").cast("string").alias("cell"), F.col("season").alias("place")).distinct()
    model = lineups.StateSpace(lineups.design(maps, F.col("season")), lineups.normal_scores(maps).withColumnRenamed("game", "row"), order)
    best = model.tune(rounds=1, probes=2)
    return model.fit(best["ridge"], best["walk"]).select("column", F.round("value", 5).alias("value"), F.lit(best["ridge"]).alias("ridge"), F.lit(best["walk"]).alias("walk"))


@query("ss_pre")
def ss_pre(t: Tables):
    """What each season's schedule can identify, before anything is fitted."""
    found = lineups.preflight(admitted(t))
    return found.select(*(F.round(c, 5).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes))


# --- two-level models ---------------------------------------------------------------------------------------------

_GROUPS = f"""{LINES}, g AS MATERIALIZED (SELECT mode, player, count(*) AS m, avg(kills) AS mean, coalesce(var_samp(kills), 0) * (count(*) - 1) AS ss FROM lines GROUP BY 1, 2),
c AS MATERIALIZED (SELECT mode, count(*) AS players, sum(m) AS maps, sum(ss) / (sum(m) - count(*)) AS within, (sum(m * mean * mean) - pow(sum(m * mean), 2) / sum(m)) / (count(*) - 1) AS around, (sum(m) - sum(m * m) / sum(m)) / (count(*) - 1) AS m0 FROM g GROUP BY mode)"""


@query("pr_shrink", f"""WITH {_GROUPS} SELECT mode, players, CAST(maps AS BIGINT) AS maps, round(within, 5) AS within, round((around - within) / m0, 5) AS between, round(CASE WHEN around > within THEN within / ((around - within) / m0) ELSE 15 END, 2) AS k, around > within AS estimated FROM c""")
def pr_shrink(t: Tables):
    """How many maps keep half of a score: the one-way decomposition of map scores."""
    parts = hierarchy.components(lines(t).select("mode", "player", F.col("kills").alias("y")), ["mode"])
    return parts.select("mode", "players", "maps", F.round("within", 5).alias("within"), F.round("between", 5).alias("between"), F.round("k", 2).alias("k"), "estimated")


@query("pr_hier", f"""WITH RECURSIVE {LINES}, g AS MATERIALIZED (SELECT mode, player, count(*) AS m, avg(kills + player % 9) AS mean, coalesce(var_samp(kills + player % 9), 0) * (count(*) - 1) AS ss FROM lines GROUP BY 1, 2),
c AS MATERIALIZED (SELECT mode, sum(ss) / (sum(m) - count(*)) AS within, avg(mean) AS origin, sum(m) / count(*) AS usual FROM g GROUP BY mode), v AS MATERIALIZED (SELECT mode, player, m, mean, within / m AS variance, origin, within, usual FROM g JOIN c USING (mode)), {spread_sql("v", "mode")}
SELECT mode, player, CAST(m AS BIGINT) AS maps, round((mu + tau2 / (tau2 + variance) * (mean - mu) - origin) / sqrt(tau2), 4) AS z, round(sqrt(tau2 / (tau2 + variance) * variance / tau2), 4) AS sd, round(tau2 / (tau2 + variance), 4) AS shrinkage, tau2 <= 0.01 * within / greatest(usual, 1) AS collapsed
FROM v JOIN e USING (mode)""")
def pr_hier(t: Tables):
    """Posterior scores of players whose true scores differ."""
    scores = lines(t).select("mode", "player", (F.col("kills") + F.col("player") % 9).alias("y"))
    return hierarchy.posterior_ratings(scores, ["mode"]).select("mode", "player", "maps", *(F.round(c, 4).alias(c) for c in ("z", "sd", "shrinkage")), "collapsed")


# --- segments -----------------------------------------------------------------------------------------------------

#: Lines of an order are segments; both sides report them, but for one line in ten where side 2 does not, and one in ten claimed by neither.
_SEG = """sg AS (SELECT l_orderkey AS game, CASE WHEN l_orderkey % 3 = 0 THEN 'hill' WHEN l_orderkey % 3 = 1 THEN 'control_round' ELSE 'snd_round' END AS kind, row_number() OVER w AS ordinal, l_quantity > 25 AS first_won, l_discount, CAST(sum(CAST(l_quantity AS INTEGER)) OVER w AS INTEGER) AS s1, CAST(sum(CAST(l_partkey % 50 AS INTEGER)) OVER w AS INTEGER) AS s2, l_shipmode
FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey)),
mp AS (SELECT o_orderkey AS game, CAST(year(o_orderdate) AS INTEGER) AS season, CASE WHEN o_orderkey % 40 <> 0 THEN CASE WHEN o_totalprice > 250000 THEN 1 ELSE 2 END END AS winner, CASE WHEN o_orderkey % 9 = 0 THEN 7 END AS score1 FROM orders)"""
_STEPS = f"""{_SEG}, ft AS (SELECT *, CASE WHEN l_discount < 0.01 THEN 'missing_side' WHEN kind = 'hill' AND (s1 > 250 OR s2 > 250) THEN 'score_too_high' WHEN kind <> 'hill' AND l_discount > 0.09 THEN 'unclaimed' END AS fault FROM sg),
kn AS (SELECT *, count(fault) OVER (PARTITION BY game ORDER BY ordinal) = 0 AS known FROM ft),
st AS (SELECT game, kind, ordinal, CASE WHEN kind = 'hill' THEN s1 ELSE sum(CAST(first_won AS INT)) OVER w END AS own, CASE WHEN kind = 'hill' THEN s2 ELSE sum(CAST(NOT first_won AS INT)) OVER w END AS other FROM kn WHERE known WINDOW w AS (PARTITION BY game ORDER BY ordinal)),
gm AS (SELECT game, any_value(kind) AS kind, arg_min(fault, ordinal) FILTER (WHERE fault IS NOT NULL) AS fault, count(*) FILTER (WHERE known) AS good, max(ordinal) AS n, arg_max(s1, ordinal) AS end1, count(*) FILTER (WHERE l_discount >= 0.01) AS both_sides FROM kn GROUP BY game),
ld AS (SELECT gm.game, gm.kind, season, winner = 1 AS won, CASE WHEN kind = 'hill' THEN 0 ELSE n - good END AS dropped, CASE WHEN winner IS NULL THEN 'no_winner' WHEN both_sides = 0 THEN 'one_team' WHEN kind = 'hill' AND fault IS NOT NULL THEN fault WHEN kind = 'hill' AND score1 <> end1 THEN 'score_differs' WHEN good = 0 THEN 'nothing_left' ELSE 'used' END AS reason FROM gm JOIN mp USING (game))"""


def segment_maps(t: Tables):
    kind = F.when(F.col("l_orderkey") % 3 == 0, "hill").when(F.col("l_orderkey") % 3 == 1, "control_round").otherwise("snd_round")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    run = lambda c: F.sum(c.cast("int")).over(w).cast("int")
    rows = t("lineitem").select(F.col("l_orderkey").alias("game"), kind.alias("kind"), F.row_number().over(w).alias("ordinal"), (F.col("l_quantity") > 25).alias("first"), "l_discount", run(F.col("l_quantity")).alias("s1"), run(F.col("l_partkey") % 50).alias("s2"), "l_returnflag")
    side = lambda team, score, won: F.struct(F.lit(team).alias("team"), F.col(score).alias("score"), won.alias("won"))
    claimed = (F.col("kind") == "hill") | (F.col("l_discount") <= 0.09)
    sides = rows.select("game", "kind", "ordinal", "l_discount", F.col("l_returnflag").alias("win_type"), F.inline(F.array(side(1, "s1", F.col("first") & claimed), side(2, "s2", ~F.col("first") & claimed)))).filter("l_discount >= 0.01 or team = 1")
    winner = F.when(F.col("o_orderkey") % 40 != 0, F.when(F.col("o_totalprice") > 250000, 1).otherwise(2))
    none = F.lit(None).cast("int")
    maps = t("orders").select(F.col("o_orderkey").alias("game"), F.year("o_orderdate").alias("season"), F.weekofyear("o_orderdate").alias("event"), winner.alias("winner"), F.lit(1).alias("team1"), F.lit(2).alias("team2"), F.when(F.col("o_orderkey") % 9 == 0, 7).alias("score1"), none.alias("score2"))
    return segments.loaded(sides, maps)


@query("seg_load", f"WITH {_STEPS} SELECT kind, reason, CAST(count(*) AS BIGINT) AS maps, CAST(count(*) FILTER (WHERE reason = 'used' AND dropped > 0) AS BIGINT) AS truncated, CAST(sum(CASE WHEN reason = 'used' THEN dropped ELSE 0 END) AS BIGINT) AS dropped FROM ld GROUP BY kind, reason")
def seg_load(t: Tables):
    """How many maps of segments are used, cut short, or left out and why."""
    return segments.report(segment_maps(t)).withColumn("reason", F.coalesce("reason", F.lit("used")))


_VIEWS = f"""{_STEPS}, us AS (SELECT st.game, st.kind, season, own, other, won FROM st JOIN ld USING (game) WHERE reason = 'used' AND st.kind <> 'hill' AND greatest(own, other) < CASE st.kind WHEN 'snd_round' THEN 6 ELSE 3 END),
vw AS (SELECT game, kind, season, own, other, won FROM us UNION ALL SELECT game, kind, season, other, own, NOT won FROM us),
tb AS (SELECT kind, own, other, (count(*) FILTER (WHERE won) + 0.5) / (count(*) + 1) AS p FROM vw GROUP BY kind, own, other)"""


@query("seg_base", f"""WITH {_VIEWS}, bs AS (SELECT kind, own, other, p, CASE kind WHEN 'snd_round' THEN 6 ELSE 3 END - own AS need, 2 * CASE kind WHEN 'snd_round' THEN 6 ELSE 3 END - 1 - own - other AS rest FROM tb),
gr AS (SELECT kind, own, other, p, list_sum([CASE WHEN k >= need THEN factorial(CAST(rest AS INTEGER)) / (factorial(CAST(k AS INTEGER)) * factorial(CAST(rest - k AS INTEGER))) ELSE 0 END FOR k IN range(0, CAST(rest AS BIGINT) + 1)]) / pow(2, rest) AS b FROM bs)
SELECT kind, CAST(count(*) AS BIGINT) AS states, round(avg(pow(p - CAST(won AS INT), 2)), 6) AS table_brier, round(avg(pow(b - CAST(won AS INT), 2)), 6) AS baseline_brier FROM vw JOIN gr USING (kind, own, other) GROUP BY kind""")
def seg_base(t: Tables):
    """What a state of rounds is worth by counting, beside a race of fair coins."""
    maps = segment_maps(t)
    found = segments.compared(segments.states(maps), segments.baseline(maps)).filter("kind <> 'hill'")
    return found.select("kind", "states", F.round("table_brier", 6).alias("table_brier"), F.round("baseline_brier", 6).alias("baseline_brier"))


@query("seg_hills")
def seg_hills(t: Tables):
    """The same for points: the baseline draws hills from the league's own gains."""
    maps = segment_maps(t)
    found = segments.compared(segments.states(maps), segments.baseline(maps)).filter("kind = 'hill'")
    return found.select("kind", "states", F.round("table_brier", 6).alias("table_brier"), F.round("baseline_brier", 6).alias("baseline_brier"))


@query("seg_two_era", f"""WITH {_VIEWS}, er AS (SELECT kind, own, other, season < 1998 AS early, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE won) / count(*) AS p FROM vw GROUP BY kind, own, other, season < 1998)
SELECT a.kind, CAST(a.own AS INTEGER) AS cell_own, CAST(a.other AS INTEGER) AS cell_other, CAST(a.n AS BIGINT) AS n_one, CAST(b.n AS BIGINT) AS n_other, round(a.p - b.p, 6) AS delta, CASE WHEN 2 * a.p * (1 - a.p) / a.n + 2 * b.p * (1 - b.p) / b.n > 0 THEN round((a.p - b.p) / sqrt(2 * a.p * (1 - a.p) / a.n + 2 * b.p * (1 - b.p) / b.n), 5) END AS z
FROM er a JOIN er b ON a.kind = b.kind AND a.own = b.own AND a.other = b.other AND a.early AND NOT b.early""")
def seg_two_era(t: Tables):
    """The two eras' state tables, cell by cell."""
    states = segments.states(segment_maps(t)).filter("kind <> 'hill'")
    found = segments.two_eras(states.filter("season < 1998"), states.filter("season >= 1998"))
    return found.select("kind", "cell_own", "cell_other", "n_one", "n_other", F.round("delta", 6).alias("delta"), F.round("z", 5).alias("z"))


# --- skills -------------------------------------------------------------------------------------------------------

_SKILL = """WITH RECURSIVE s AS (SELECT o_orderpriority AS pool, o_orderkey AS series, CAST(o_custkey % 25 AS INTEGER) + 1 AS a, CAST(o_orderkey % 25 AS INTEGER) + 1 AS b, o_totalprice > 150000 AS won, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_custkey % 25 <> o_orderkey % 25),
f AS (SELECT DISTINCT pool, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS series, CAST(NULL AS INTEGER) AS a, list_resize(CAST([] AS DOUBLE[]), 25, 25.0::DOUBLE) AS m, list_resize(CAST([] AS DOUBLE[]), 25, 625.0::DOUBLE / 9) AS v FROM s
UNION ALL SELECT pool, rn, series, a, [CASE WHEN i = a THEN m[i] + va / c * CASE WHEN won THEN 1 - p ELSE -p END WHEN i = b THEN m[i] - vb / c * CASE WHEN won THEN 1 - p ELSE -p END ELSE m[i] END FOR i IN range(1, 26)],
[CASE WHEN i = a THEN va * greatest(1 - sqrt(va) / c * va / (c * c) * p * (1 - p), 0.0001) WHEN i = b THEN vb * greatest(1 - sqrt(vb) / c * vb / (c * c) * p * (1 - p), 0.0001) ELSE v[i] END FOR i IN range(1, 26)]
FROM (SELECT *, 1 / (1 + exp((m[b] - m[a]) / c)) AS p FROM (SELECT *, sqrt(va + vb + 2 * pow(25.0 / 6, 2)) AS c FROM (SELECT s.*, f.m, f.v, f.v[s.a] + pow(25.0 / 300, 2) AS va, f.v[s.b] + pow(25.0 / 300, 2) AS vb FROM f JOIN s ON s.pool = f.pool AND s.rn = f.rn + 1))))"""


@query("rt_openskill", _SKILL + " SELECT series, round(m[a], 5) AS mean, round(sqrt(v[a]), 5) AS deviation FROM f WHERE series IS NOT NULL")
def rt_openskill(t: Tables):
    """Plackett-Luce skills of the first side after each series, sides of one player."""
    s = series(t)
    maps = s.select("pool", F.col("series").alias("map"), "at", F.year("at").alias("season"), F.array("a").alias("a_players"), F.array("b").alias("b_players"), "a_won")
    rated = skills.skill_ratings(maps).withColumnRenamed("map", "series")
    return rated.join(s.select("series", F.col("a").alias("player")), ["series", "player"]).select("series", F.round("mean", 5).alias("mean"), F.round("deviation", 5).alias("deviation"))


def mode_maps(t: Tables):
    return series(t).withColumnRenamed("series", "map").withColumns({"mode": F.col("map") % 3, "event": F.date_format("at", "yyyy-MM")})


@query("rt_permuted", """WITH s AS (SELECT o_orderpriority AS pool, strftime(o_orderdate, '%Y-%m') AS event, o_orderkey AS map, o_orderkey % 3 AS mode, o_orderdate, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7)) AS BIGINT) AS k FROM orders WHERE o_custkey % 25 <> o_orderkey % 25),
d AS (SELECT *, (((k * 48271 + r * 16807) % 2147483647) * ((k * 48271 + r * 16807) % 2147483647) % 2147483647 + k) % 2147483647 AS x FROM s, range(0, 3) t(r)),
p AS (SELECT *, row_number() OVER (PARTITION BY pool, event, r ORDER BY o_orderdate, map) AS played, row_number() OVER (PARTITION BY pool, event, r ORDER BY CASE WHEN r = 0 THEN 0 ELSE x * x % 2147483647 END, o_orderdate, map) AS drawn FROM d)
SELECT a.map, CAST(a.r AS INTEGER) AS replicate, b.mode AS dealt FROM p a JOIN p b ON a.pool = b.pool AND a.event = b.event AND a.r = b.r AND a.drawn = b.played""")
def rt_permuted(t: Tables):
    """Two draws of the null of no mode specialisation: an event's modes dealt anew among its maps."""
    return skills.permuted_modes(mode_maps(t), "event", 2).select("map", "replicate", "dealt")


@query("rt_modenull")
def rt_modenull(t: Tables):
    found = skills.mode_null(mode_maps(t), "event")
    return found.select("pool", "cells", F.round("observed", 4).alias("observed"), "draws", *(F.round(c, 4).alias(c) for c in ("null_mean", "null_low", "null_high", "p_value")), "exceeds")


# --- rounds -------------------------------------------------------------------------------------------------------


def round_states(t: Tables):
    """Players left after the deaths of a round, from both sides; six days are an event."""
    states = feed.alive_after(deaths(t), teams(t)).withColumn("won", (F.col("victim") + F.col("round")) % 2 == 0)
    view = lambda a, b, won: F.struct(F.col(a).alias("own"), F.col(b).alias("other"), won.alias("won"))
    both = states.select(F.expr("(dayofmonth(game) - 1) div 6").cast("int").alias("event"), F.concat_ws("-", "game", "round").alias("round"), (F.col("time_ms") * 2).alias("time_ms"), F.inline(F.array(view("own", "opponents", F.col("won")), view("opponents", "own", ~F.col("won")))))
    return both.filter("own > 0 and other > 0")


@query("ev_rwp")
def ev_rwp(t: Tables):
    """Forecasts of rounds by five regressions and the state table, each event by those before it."""
    losses = rounds.walk_forward(round_states(t))
    found = resample.bootstrap_mean(losses.withColumn("unit", F.concat_ws("-", "event", "round")), "unit", "loss", ["model"])
    return found.select("model", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query("ev_rwp_table", f"""WITH {ALIVE}, v AS (SELECT (day(game) - 1) // 6 AS event, game || '-' || round AS rnd, own, opponents, (victim + round) % 2 = 0 AS won FROM st WHERE own > 0 AND opponents > 0),
bv AS (SELECT event, rnd, own, opponents, won FROM v UNION ALL SELECT event, rnd, opponents, own, NOT won FROM v), c AS (SELECT event, own, opponents, count(*) AS n, count(*) FILTER (WHERE won) AS w FROM bv GROUP BY 1, 2, 3),
p AS (SELECT e.event, c.own, c.opponents, (sum(w) + 0.5) / (sum(n) + 1) AS p FROM (SELECT DISTINCT event FROM bv) e JOIN c ON c.event < e.event GROUP BY 1, 2, 3),
l AS (SELECT bv.event, rnd, avg(pow(coalesce(p, 0.5) - CAST(won AS INT), 2)) AS loss FROM bv LEFT JOIN p ON p.event = bv.event AND p.own = bv.own AND p.opponents = bv.opponents WHERE bv.event > (SELECT min(event) FROM bv) GROUP BY 1, 2)
SELECT CAST(event AS INTEGER) AS event, CAST(count(*) AS BIGINT) AS rounds, round(avg(loss), 6) AS brier FROM l GROUP BY event""")
def ev_rwp_table(t: Tables):
    losses = rounds.walk_forward(round_states(t)).filter("model = 'state_table'")
    return losses.groupBy("event").agg(F.count(F.lit(1)).alias("rounds"), F.round(F.avg("loss"), 6).alias("brier"))
