"""Report, findings, quality, run and site-read queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators import feed, findings, metrics, quality, ratings, reports, runs
from matchloom.operators.cohort import scored
from matchloom.plans.aggregates import LINES, lines
from matchloom.plans.models import _BOX_SQL, _SCORED, ELO, FED, box_lines, fed_lines, long_sql, metric_layer, series
from matchloom.plans.base import Tables, query
from matchloom.plans.windows import COHORT, kd_scored

ROWS = f"{_SCORED}, w AS (SELECT player, season, mode, metric, round(value, 6) AS value, denom, qualified, CASE WHEN n >= 15 AND sd > 0 THEN round((value - m) / sd, 4) END AS z, CASE WHEN n >= 2 AND sd > 0 THEN round(below / n, 6) END AS pctl FROM c)"


@query("rp_query", f"""{ROWS} SELECT k.player, k.season, k.value AS kd_value, k.denom AS kd_denom, k.qualified AS kd_qualified, p.value AS kills_pm_value, p.denom AS kills_pm_denom
FROM w k LEFT JOIN w p ON p.player = k.player AND p.season = k.season AND p.mode IS NULL AND p.metric = 'kills_pm' WHERE k.metric = 'kd' AND k.mode IS NULL AND k.qualified""")
def rp_query(t: Tables):
    table = reports.wide(metric_layer(t, "kd", "kills_pm"), reports.resolve({"metrics": "kd,kills_pm"}, ["kd", "kills_pm"]))
    return table.select("player", "season", F.round("kd_value", 6).alias("kd_value"), "kd_denom", "kd_qualified", F.round("kills_pm_value", 6).alias("kills_pm_value"), "kills_pm_denom")


@query("rp_scope", f"{_SCORED} SELECT DISTINCT season, mode, mode IS NULL AS pooled FROM c WHERE metric = 'hill_time_share'")
def rp_scope(t: Tables):
    return metric_layer(t, "hill_time_share").select("season", "mode", F.col("mode").isNull().alias("pooled")).distinct()


@query("rp_members", f"WITH {LINES} SELECT DISTINCT player, season FROM lines WHERE (player, season) IN (SELECT player, season FROM lines WHERE game % 25 = 3)")
def rp_members(t: Tables):
    rows = lines(t).select("player", "season", "game")
    return rows.join(rows.filter("game % 25 = 3").select("player", "season"), ["player", "season"], "left_semi").select("player", "season").distinct()


@query("rd_index", f"""WITH {LINES}, s AS (SELECT player, CAST(count(*) AS BIGINT) AS maps, min(season) AS first_season, max(season) AS last_season, round(sum(kills) / sum(deaths), 6) AS kd FROM lines GROUP BY player)
SELECT s.*, s_name AS handle, n_name AS country FROM s JOIN supplier ON s_suppkey = player LEFT JOIN nation ON n_nationkey = s_nationkey""")
def rd_index(t: Tables):
    s = lines(t).groupBy("player").agg(F.count(F.lit(1)).alias("maps"), F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.round(F.sum("kills") / F.sum("deaths"), 6).alias("kd"))
    who = t("supplier").select(F.col("s_suppkey").alias("player"), F.col("s_name").alias("handle"), F.col("s_nationkey").alias("n_nationkey"))
    return s.join(who, "player").join(t("nation").select("n_nationkey", F.col("n_name").alias("country")), "n_nationkey", "left").drop("n_nationkey")


BOTH = """g AS (SELECT o_orderkey AS k, o_orderdate AS played, o_orderpriority AS mode, o_custkey % 25 AS team, o_orderkey % 25 AS opponent, o_totalprice > 150000 AS won FROM orders WHERE o_custkey % 25 <> o_orderkey % 25
UNION ALL SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderkey % 25, o_custkey % 25, NOT o_totalprice > 150000 FROM orders WHERE o_custkey % 25 <> o_orderkey % 25)"""


def both_sides(t: Tables):
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("mode"), (F.col("o_custkey") % 25).alias("a"), (F.col("o_orderkey") % 25).alias("b"), (F.col("o_totalprice") > 150000).alias("w")).filter("a <> b")
    return o.select("k", "at", "mode", F.inline(F.array(F.struct(F.col("a").alias("team"), F.col("b").alias("opponent"), F.col("w").alias("won")), F.struct(F.col("b").alias("team"), F.col("a").alias("opponent"), (~F.col("w")).alias("won")))))


@query("rd_h2h", f"WITH {BOTH} SELECT team, opponent, CAST(count(*) AS BIGINT) AS played, CAST(count(*) FILTER (WHERE won) AS BIGINT) AS wins FROM g GROUP BY 1, 2")
def rd_h2h(t: Tables):
    return both_sides(t).groupBy("team", "opponent").agg(F.count(F.lit(1)).alias("played"), F.count_if("won").alias("wins"))


@query("rd_records", f"WITH {BOTH} SELECT team, mode, CAST(count(*) AS BIGINT) AS played, round(avg(CAST(won AS INT)), 6) AS rate, CAST(max(played) FILTER (WHERE won) AS DATE) AS last_win FROM g GROUP BY 1, 2")
def rd_records(t: Tables):
    return both_sides(t).groupBy("team", "mode").agg(F.count(F.lit(1)).alias("played"), F.round(F.avg(F.col("won").cast("int")), 6).alias("rate"), F.to_date(F.max(F.when(F.col("won"), F.col("at")))).alias("last_win"))


@query("rd_standings", f"""{ELO}, g AS (SELECT f.pool, f.rn, s.a - 1 AS team, f.r[s.a] AS r, s.y AS w FROM f JOIN s ON s.pool = f.pool AND s.rn = f.rn UNION ALL SELECT f.pool, f.rn, s.b - 1, f.r[s.b], 1 - s.y FROM f JOIN s ON s.pool = f.pool AND s.rn = f.rn)
SELECT pool, CAST(team AS BIGINT) AS team, CAST(count(*) AS BIGINT) AS played, CAST(sum(w) AS BIGINT) AS wins, round(max(r), 4) AS peak, round(arg_max(r, rn), 4) AS final FROM g GROUP BY pool, team""")
def rd_standings(t: Tables):
    """Final and peak rating of each side of a league, with its record."""
    rows = series(t)
    rated = ratings.elo(rows).join(rows.select("pool", "series", "at", "a", "b", "a_won"), ["pool", "series"])
    side = lambda team, rating, won: F.struct(F.col(team).alias("team"), F.col(rating).alias("rating"), won.cast("int").alias("won"))
    both = rated.select("pool", "series", "at", F.inline(F.array(side("a", "rating_a", F.col("a_won")), side("b", "rating_b", ~F.col("a_won")))))
    return both.groupBy("pool", "team").agg(
        F.count(F.lit(1)).alias("played"), F.sum("won").alias("wins"), F.round(F.max("rating"), 4).alias("peak"), F.round(F.max_by("rating", F.struct("at", "series")), 4).alias("final")
    )


@query("rd_mapmeta", f"WITH {LINES} SELECT season, mode, CAST(count(DISTINCT game) AS BIGINT) AS games, round(count(DISTINCT game) / CAST(sum(count(DISTINCT game)) OVER (PARTITION BY season) AS DOUBLE), 6) AS share, round(avg(kills), 6) AS mean_kills FROM lines GROUP BY 1, 2")
def rd_mapmeta(t: Tables):
    g = lines(t).groupBy("season", "mode").agg(F.count_distinct("game").alias("games"), F.round(F.avg("kills"), 6).alias("mean_kills"))
    return g.select("season", "mode", "games", F.round(F.col("games") / F.sum("games").over(Window.partitionBy("season")), 6).alias("share"), "mean_kills")


@query("rd_coverage", f"WITH {LINES} SELECT season, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN rate > 0.02 THEN 1 ELSE 0 END), 6) AS share FROM lines GROUP BY season")
def rd_coverage(t: Tables):
    return reports.coverage_share(lines(t), ["season"], F.col("rate") > 0.02).withColumn("share", F.round("share", 6))


@query("rd_timeline", "SELECT o_custkey, array_to_string(list(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) ORDER BY o_orderdate, o_orderkey), ' ') AS timeline FROM orders GROUP BY o_custkey")
def rd_timeline(t: Tables):
    step = F.struct("o_orderdate", "o_orderkey", F.concat_ws(":", F.to_date("o_orderdate").cast("string"), F.col("o_orderkey").cast("string")).alias("s"))
    return t("orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["s"]), " ").alias("timeline"))


@query("rd_art", """SELECT user_id AS model, arg_max(event_id, (ts, event_id)) AS run_id, arg_max(props, (ts, event_id)) AS payload FROM events WHERE event_type = 'view' GROUP BY user_id""")
def rd_art(t: Tables):
    """An event is a run of its user's model, and an artifact named by its type."""
    e = t("events")
    held = e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("name"), F.col("props").alias("payload"))
    return runs.artifact(held, e.select(F.col("event_id").alias("id"), F.col("user_id").alias("model"), F.col("ts").alias("created_at")), "view")


@query("rd_feed", """SELECT event_id, CASE WHEN event_type = 'click' THEN c_name WHEN event_type = 'view' THEN s_name END AS subject FROM events
LEFT JOIN customer ON event_type = 'click' AND c_custkey = user_id LEFT JOIN supplier ON event_type = 'view' AND s_suppkey = user_id""")
def rd_feed(t: Tables):
    e = t("events").select("event_id", "event_type", "user_id")
    c = t("customer").select(F.col("c_custkey").alias("user_id"), F.lit("click").alias("event_type"), F.col("c_name").alias("c"))
    s = t("supplier").select(F.col("s_suppkey").alias("user_id"), F.lit("view").alias("event_type"), F.col("s_name").alias("s"))
    return e.join(c, ["user_id", "event_type"], "left").join(s, ["user_id", "event_type"], "left").select("event_id", F.coalesce("c", "s").alias("subject"))


@query("fd_outlier", COHORT + " SELECT player AS subject, season, 'outlier' AS kind, round(least(abs((value - m) / s) / 3.5, 1.0), 6) AS score FROM c WHERE mode IS NULL AND n >= 15 AND s > 0 AND abs((value - m) / s) >= 2 AND denom >= 30")
def fd_outlier(t: Tables):
    seasons = kd_scored(t).filter("mode is null").withColumnRenamed("denom", "maps")
    return findings.outliers(seasons).withColumn("score", F.round("score", 6))


@query("fd_trend", COHORT + """, p AS (SELECT player, season, below / n AS pctl FROM c WHERE mode IS NULL AND n >= 2 AND s > 0), d AS (SELECT player, pctl, pctl - lag(pctl) OVER (PARTITION BY player ORDER BY season) AS step FROM p)
SELECT player AS subject, 'trend' AS kind, round(least(abs(sum(step)), 1.0), 6) AS score FROM d GROUP BY player HAVING count(*) >= 3 AND (min(step) > 0 OR max(step) < 0) AND abs(sum(step)) >= 0.15""")
def fd_trend(t: Tables):
    return findings.trends(kd_scored(t).filter("mode is null")).withColumn("score", F.round("score", 6))


@query("fd_shift", f"""WITH {LINES}, c AS (SELECT season, player % 20 AS loadout, count(*) AS n FROM lines GROUP BY 1, 2), s AS (SELECT season, loadout, n / CAST(sum(n) OVER (PARTITION BY season) AS DOUBLE) AS share FROM c)
SELECT a.season AS "from", b.season AS next, a.loadout, round(b.share - a.share, 6) AS moved FROM s a JOIN s b ON b.season = a.season + 1 AND a.loadout = b.loadout WHERE abs(b.share - a.share) >= 0.002""")
def fd_shift(t: Tables):
    c = lines(t).groupBy("season", (F.col("player") % 20).alias("loadout")).agg(F.count(F.lit(1)).alias("n"))
    s = c.select("season", "loadout", (F.col("n") / F.sum("n").over(Window.partitionBy("season"))).alias("share"))
    return findings.shifts(s, "loadout", "season", 0.002).withColumn("moved", F.round("moved", 6))


@query("fd_milestone", f"""WITH {LINES}, c AS (SELECT player AS subject, count(*) AS maps FROM lines GROUP BY 1 HAVING count(*) >= 250 ORDER BY maps DESC, subject LIMIT 25),
p AS (SELECT o_custkey % 25 AS subject, max(o_totalprice) AS peak FROM orders GROUP BY 1 ORDER BY peak DESC, subject LIMIT 5)
SELECT 'player' AS who, subject, CAST(row_number() OVER (ORDER BY maps DESC, subject) AS INTEGER) AS rank, round(0.35 + least(maps / 2000.0, 0.3), 6) AS score FROM c
UNION ALL SELECT 'team', subject, CAST(row_number() OVER (ORDER BY peak DESC, subject) AS INTEGER), round(0.8 - 0.08 * (row_number() OVER (ORDER BY peak DESC, subject) - 1), 6) FROM p""")
def fd_milestone(t: Tables):
    careers = findings.career_milestones(lines(t).groupBy("player").agg(F.count(F.lit(1)).alias("maps"))).withColumn("who", F.lit("player"))
    peaks = findings.peak_milestones(t("orders").select((F.col("o_custkey") % 25).alias("team"), F.col("o_totalprice").alias("rating"))).withColumn("who", F.lit("team"))
    return careers.unionByName(peaks).select("who", "subject", "rank", F.round("score", 6).alias("score"))


@query("fd_era", f"""{_BOX_SQL}, p AS (SELECT mode, season, sum(kills + deaths) / (sum(duration_s) / 600) AS pace FROM box GROUP BY 1, 2),
c AS (SELECT mode, season, (pace - lag(pace) OVER w) / lag(pace) OVER w AS change FROM p WINDOW w AS (PARTITION BY mode ORDER BY season))
SELECT mode, season AS subject, round(change, 6) AS change, round(least(abs(change) * 2.5, 1.0), 6) AS score FROM c WHERE abs(change) >= 0.01""")
def fd_era(t: Tables):
    """The stand-in's seasons are alike: a change of a hundredth counts."""
    pace = box_lines(t).groupBy("mode", "season").agg((F.sum(F.col("kills") + F.col("deaths")) / (F.sum("duration_s") / 600)).alias("pace"))
    return findings.era_changes(pace, 0.01).select("mode", "subject", F.round("change", 6).alias("change"), F.round("score", 6).alias("score"))


@query("fd_h2h", """WITH d AS (SELECT least(o_custkey % 45, o_orderkey % 45) AS x, greatest(o_custkey % 45, o_orderkey % 45) AS y, (o_totalprice > 150000) = (o_custkey % 45 < o_orderkey % 45) AS w FROM orders WHERE o_custkey % 45 <> o_orderkey % 45),
n AS (SELECT x, y, count(*) AS n, count(*) FILTER (WHERE w) AS w FROM d GROUP BY 1, 2 HAVING count(*) >= 8), s AS (SELECT x AS subject, y AS opponent, w AS wins, n FROM n UNION ALL SELECT y, x, n - w, n FROM n)
SELECT subject, opponent, CAST(wins AS BIGINT) AS wins, CAST(n AS BIGINT) AS n, round(least((wins / n - 0.5) * 1.6 + n / 40.0, 1.0), 6) AS score FROM s WHERE wins / n >= 0.7""")
def fd_h2h(t: Tables):
    rows = t("orders").select((F.col("o_custkey") % 45).alias("a"), (F.col("o_orderkey") % 45).alias("b"), (F.col("o_totalprice") > 150000).alias("a_won")).filter("a <> b")
    return findings.head_to_head_edges(rows).select("subject", "opponent", "wins", "n", F.round("score", 6).alias("score"))


RISING = {"headshot_rate": True, "accuracy": True, "suicides_pm": False, "streak_conversion": True, "lives_p10": False}
_LOW = ", ".join(f"'{m}'" for m, up in RISING.items() if not up)
_KEYS = ", ".join(f"'{m}'" for m in RISING)
PCTL = f"""{_SCORED}, w AS (SELECT player, season, mode, metric, value, denom, qualified, CASE WHEN n >= 15 AND sd > 0 THEN (value - m) / sd END AS z, CASE WHEN n >= 2 AND sd > 0 THEN below / n END AS pctl FROM c)"""


@query("fd_intangible", f"""{PCTL}, k AS (SELECT player, season, pctl AS kd FROM w WHERE metric = 'kd' AND mode IS NULL AND qualified AND pctl IS NOT NULL),
q AS (SELECT w.player AS subject, w.season, mode, metric, CASE WHEN metric IN ({_LOW}) THEN 1 - pctl ELSE pctl END AS quality, kd FROM w JOIN k USING (player, season) WHERE qualified AND pctl IS NOT NULL AND metric IN ({_KEYS}))
SELECT subject, season, mode, metric, quality >= 0.9 AND kd <= 0.5 AS undersold, round(least(0.5 + abs(quality - kd) * 0.45, 0.98), 6) AS score FROM q WHERE quality >= 0.9 AND kd <= 0.5 OR quality <= 1 - 0.9 AND kd >= 0.9
ORDER BY score DESC, subject, season, metric, mode NULLS FIRST LIMIT 24""")
def fd_intangible(t: Tables):
    return findings.intangible_outliers(metric_layer(t, "kd", *RISING), RISING).withColumn("score", F.round("score", 6))


@query("fd_extreme", f"""{PCTL}, f AS (SELECT * FROM w WHERE qualified AND z IS NOT NULL AND metric IN ({_KEYS}) QUALIFY row_number() OVER (PARTITION BY metric, season, mode ORDER BY round(CASE WHEN metric IN ({_LOW}) THEN -z ELSE z END, 9) DESC, player) = 1)
SELECT player AS subject, season, mode, metric, round(z, 6) AS z, round(least(0.55 + abs(z) * 0.09, 0.97), 6) AS score FROM f WHERE abs(z) >= 1.5 AND denom >= 2 * CASE metric {" ".join(f"WHEN '{m.key}' THEN {m.least}" for m in metrics.PLAYER_METRICS if m.key in RISING)} END
ORDER BY score DESC, subject, season, metric, mode NULLS FIRST LIMIT 30""")
def fd_extreme(t: Tables):
    least = {m.key: float(m.least) for m in metrics.PLAYER_METRICS if m.key in RISING}
    return findings.profile_extremes(metric_layer(t, *RISING), RISING, least).withColumns({"z": F.round("z", 6), "score": F.round("score", 6)})


@query("fd_clutch", f"""WITH {FED}, r AS ({long_sql([m for m in metrics.FEED_METRICS if m.key.startswith("clutch")])}), v AS (SELECT * FROM r WHERE value IS NOT NULL),
c AS (SELECT *, count(*) FILTER (WHERE qualified) OVER w AS n, stddev_samp(value) FILTER (WHERE qualified) OVER w AS sd, count(*) FILTER (WHERE qualified) OVER (PARTITION BY metric, season, mode ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below
FROM v WINDOW w AS (PARTITION BY metric, season, mode))
SELECT player AS subject, season, mode, metric, denom AS attempts, round(least(0.55 + value * 0.35, 0.95), 6) AS score FROM c WHERE qualified AND denom >= 5 AND n >= 2 AND sd > 0 AND below / n >= 0.9
ORDER BY score DESC, subject, season, metric, mode NULLS FIRST LIMIT 10""")
def fd_clutch(t: Tables):
    """Five attempts suffice here, as the stand-in's rosters are in few clutches."""
    sums = metrics.folded(fed_lines(t), [*feed.FEED_COLUMNS, *feed.ROUND_COLUMNS, "deaths", "duration_s"])
    rows = metrics.metric_rows(sums, [m for m in metrics.FEED_METRICS if m.key.startswith("clutch")])
    return findings.clutch_milestones(rows, 5).withColumn("score", F.round("score", 6))


@query("fd_trade", f"""{PCTL}, u AS (SELECT player, season, pctl AS u FROM w WHERE metric = 'suicides_pm' AND mode IS NULL AND qualified AND pctl IS NOT NULL), k AS (SELECT player, season, pctl AS k FROM w WHERE metric = 'kills_p10' AND mode IS NULL AND qualified AND pctl IS NOT NULL)
SELECT player AS subject, season, k >= 0.75 AND u >= 0.75 AS isolated, round(least(0.55 + abs(u - (1 - k)) * 0.5, 0.95), 6) AS score FROM u JOIN k USING (player, season) WHERE k >= 0.75 AND u >= 0.75 OR k <= 0.25 AND u <= 0.25 ORDER BY score DESC, subject, season LIMIT 12""")
def fd_trade(t: Tables):
    """Line items have no feed: suicides stand for untraded deaths."""
    return findings.trade_asymmetries(metric_layer(t, "kills_p10", "suicides_pm"), untraded="suicides_pm").withColumn("score", F.round("score", 6))


@query("fd_style", f"""WITH {LINES}, p AS (SELECT player % 25 AS team, season, player, sum(kills) AS x FROM lines GROUP BY 1, 2, 3), s AS (SELECT team, season, x / sum(x) OVER (PARTITION BY team, season) AS s FROM p),
h AS (SELECT team, season, sum(s * s) AS v FROM s GROUP BY 1, 2), z AS (SELECT team, season, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS z FROM h WINDOW w AS (PARTITION BY season))
SELECT team AS subject, season, 'snd_fb_concentration' AS metric, round(z, 6) AS z, round(least(0.5 + abs(z) * 0.12, 0.95), 6) AS score FROM z WHERE abs(z) >= 1.5 ORDER BY score DESC, subject, season LIMIT 12""")
def fd_style(t: Tables):
    shares = metrics.concentration(lines(t).withColumn("team", F.col("player") % 25), "kills").select("team", "season", F.lit("snd_fb_concentration").alias("metric"), F.col("herfindahl").alias("value"), F.lit(True).alias("qualified"))
    return findings.team_styles(scored(shares, ["metric", "season"])).withColumns({"z": F.round("z", 6), "score": F.round("score", 6)})


@query("fd_control", """WITH t AS (SELECT o_orderkey, o_orderpriority AS kind, CASE WHEN o_orderkey % 4 > 0 THEN 1 / (1 + o_totalprice / 1000) END AS p FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY p, o_orderkey) AS i, count(*) OVER (PARTITION BY kind) AS n FROM t WHERE p IS NOT NULL),
q AS (SELECT *, min(p * n / i) OVER (PARTITION BY kind ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM r)
SELECT t.o_orderkey AS subject, coalesce(q.q > 0.01, false) AS retracted FROM t LEFT JOIN q ON t.o_orderkey = q.o_orderkey""")
def fd_control(t: Tables):
    f = t("orders").select(F.col("o_orderkey").alias("subject"), F.lit("").alias("headline"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderkey") % 4 > 0, 1 / (1 + F.col("o_totalprice") / 1000)).alias("p"))
    return findings.retracted(f, 0.01).select("subject", "retracted")


CHECKS = [
    quality.Check("negative price", quality.negative("orders", ["o_totalprice"])),
    quality.Check("duplicate order", quality.duplicated("orders", ["o_orderkey"])),
    quality.Check("order without customer", quality.orphaned("orders", "o_custkey", "customer", "c_custkey")),
    quality.Check("line without order", quality.orphaned("lineitem", "l_orderkey", "orders", "o_orderkey")),
    quality.Check("unknown status", quality.unaccepted("orders", "o_orderstatus", ["F", "O", "P"])),
    quality.Check("repeated line", quality.duplicated("lineitem", ["l_orderkey", "l_linenumber"]), hard=False),
]


@query("qa_gate", """WITH f AS (SELECT 'unknown status' AS n, count(*) AS k FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P') UNION ALL SELECT 'negative price', count(*) FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'duplicate order', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1) UNION ALL SELECT 'order without customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'full discount', count(*) FROM lineitem WHERE l_discount >= 0.1)
SELECT count(*) FILTER (WHERE k > 0) = 0 AS passes, coalesce(string_agg(n, ',' ORDER BY n) FILTER (WHERE k > 0), '') AS failed FROM f""")
def qa_gate(t: Tables):
    """The hard checks, and one that discounts stay below a tenth."""
    hard = [c for c in CHECKS if c.hard] + [quality.Check("full discount", lambda x: x["lineitem"].filter("l_discount >= 0.1"))]
    return quality.gate(quality.report(hard, {n: t(n) for n in ("orders", "customer", "lineitem")}))


@query("qa_hard", """SELECT 'negative price' AS check_name, true AS hard, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_totalprice < 0) AS failing
UNION ALL SELECT 'duplicate order', true, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1))
UNION ALL SELECT 'order without customer', true, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'line without order', true, (SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'unknown status', true, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P'))
UNION ALL SELECT 'repeated line', false, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))""")
def qa_hard(t: Tables):
    return quality.report(CHECKS, {n: t(n) for n in ("orders", "customer", "lineitem")})


@query("id_queue", """WITH k AS (SELECT s_suppkey AS player, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS key FROM supplier)
SELECT a.player AS a, b.player AS b, CASE WHEN a.key = b.key THEN 'same key' ELSE 'one edit' END AS reason FROM k a JOIN k b ON a.player < b.player AND levenshtein(a.key, b.key) <= 1""")
def id_queue(t: Tables):
    return quality.identity_candidates(t("supplier").select(F.col("s_suppkey").alias("player"), F.col("s_name").alias("handle")))


RUNS = "r AS (SELECT o_orderkey AS id, o_orderpriority AS model, o_orderdate AS created_at FROM orders)"


def model_runs(t: Tables):
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("model"), F.col("o_orderdate").alias("created_at"))


@query("snk_latest", f"WITH {RUNS} SELECT model, arg_max(id, (created_at, id)) AS id FROM r GROUP BY model")
def snk_latest(t: Tables):
    return runs.latest(model_runs(t)).select("model", "id")


@query("op_models", f"WITH {RUNS}, n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY created_at DESC, id DESC) AS n FROM r) SELECT model, max(id) FILTER (WHERE n = 1) AS latest, max(id) FILTER (WHERE n = 2) AS previous FROM n GROUP BY model")
def op_models(t: Tables):
    return runs.last_two(model_runs(t))


@query("snk_prune", f"WITH {RUNS}, k AS (SELECT model, arg_max(id, (created_at, id)) AS id FROM r GROUP BY model) SELECT l_orderkey AS run_id, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT id FROM k) OR l_orderkey NOT IN (SELECT id FROM r)")
def snk_prune(t: Tables):
    return runs.pruned(t("lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber"), model_runs(t))


@query("snk_upsert", """WITH a AS (SELECT o_orderkey, o_totalprice, 2 AS source_rank, 1 AS o FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, o_totalprice + 1, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 3 END, 0 FROM orders WHERE o_orderkey % 5 > 0)
SELECT o_orderkey, arg_min(o_totalprice, (source_rank, o)) AS o_totalprice, CAST(arg_min(source_rank, (source_rank, o)) AS INTEGER) AS source_rank FROM a GROUP BY o_orderkey""")
def snk_upsert(t: Tables):
    o = t("orders").select("o_orderkey", "o_totalprice")
    current = o.filter("o_orderkey % 3 > 0").withColumn("source_rank", F.lit(2))
    incoming = o.filter("o_orderkey % 5 > 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(3).alias("source_rank"))
    return runs.upserted(current, incoming, ["o_orderkey"], "source_rank")


def snapshot(t: Tables, year: int):
    rows = lines(t).filter(F.col("season") == year).groupBy("player").agg(F.round(F.sum("kills") - 500, 2).alias("kills"), F.sum("deaths").cast("double").alias("deaths"))
    return runs.long_numbers(rows, ["player"], ["kills", "deaths"], "season")


@query("df_diff", f"""WITH {LINES}, s AS (SELECT season, player, unnest(['kills', 'deaths']) AS name, unnest([round(sum(kills) - 500, 2), CAST(sum(deaths) AS DOUBLE)]) AS value FROM lines WHERE season IN (1995, 1996) GROUP BY season, player),
a AS (SELECT 'season/' || player || '/' || name AS path, value FROM s WHERE season = 1995), b AS (SELECT 'season/' || player || '/' || name AS path, value FROM s WHERE season = 1996)
SELECT coalesce(a.path, b.path) AS path, a.value AS before, b.value AS after, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' WHEN abs(b.value - a.value) <= greatest(1e-9, 1e-6 * greatest(abs(a.value), abs(b.value))) THEN 'same'
WHEN sign(a.value) * sign(b.value) < 0 THEN 'flipped' ELSE 'moved' END AS verdict FROM a FULL JOIN b ON a.path = b.path""")
def df_diff(t: Tables):
    return runs.compared(snapshot(t, 1995), snapshot(t, 1996))


@query("op_lineage", "SELECT 'orders' AS source, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def op_lineage(t: Tables):
    counts = [t(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("source"), "n") for n in ("orders", "lineitem", "events")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("pop_digest", """WITH a AS (SELECT o_orderpriority AS stratum, o_orderkey // 16777216 AS k2, o_orderkey // 4096 AS k1, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS d, count(*) AS n FROM orders GROUP BY 1, 2, 3),
b AS (SELECT stratum, k2, sha256(string_agg(d, ',' ORDER BY k1)) AS d, sum(n) AS n FROM a GROUP BY 1, 2) SELECT stratum, sha256(string_agg(d, ',' ORDER BY k2)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1""")
def pop_digest(t: Tables):
    """A digest of each stratum's keys in order: ranges of 4,096 keys, then of 4,096 ranges, so no group holds more than that."""
    rows = t("orders").select(F.col("o_orderpriority").alias("stratum"), F.expr("o_orderkey div 16777216").alias("k2"), F.expr("o_orderkey div 4096").alias("k1"), F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("d"), F.lit(1).alias("n"))
    for keys, order in ((["stratum", "k2", "k1"], "k"), (["stratum", "k2"], "k1"), (["stratum"], "k2")):
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "d"))), lambda x: x["d"]), ",")
        rows = rows.groupBy(*keys).agg(F.sha2(listed, 256).alias("d"), F.sum("n").alias("n"))
    return rows.select("stratum", F.col("d").alias("digest"), "n")
