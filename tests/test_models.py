"""Golden values of scores, ratings, statistics, reports, runs and normalisers."""

import json
import tarfile
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from matchloom.operators import cohort, findings, linear, metrics, quality, ratings, reports, runs
from matchloom.operators.blend import weighted_present
from matchloom.operators.ordering import average_rank, numbered
from matchloom.sources import records


def test_cohort_scores(spark):
    rows = [("a", float(v), True) for v in range(1, 6)] + [("b", 1.0, True), ("b", 2.0, True), ("b", 3.0, True), ("b", 10.0, False), ("c", 5.0, True), ("c", 5.0, True)]
    got = cohort.scored(spark.createDataFrame(rows, "k string, value double, qualified boolean"), ["k"], least_for_z=2).collect()
    by = {(r.k, r.value): (r.z, r.pctl) for r in got}
    assert by[("a", 3.0)][0] == pytest.approx(0) and by[("a", 5.0)][0] == pytest.approx(2 / 2.5**0.5)
    assert by[("a", 1.0)][1] == pytest.approx(0.2) and by[("a", 5.0)][1] == 1
    assert by[("b", 10.0)][0] > 2 and by[("b", 10.0)][1] == 1
    assert by[("c", 5.0)] == (None, None)


def test_best_scores_without_moving_the_rows(spark):
    rows = [(k, "s", float((i * 37 + n) % 101) / 7, i % 5 > 0) for n, k in enumerate(("a", "b", None)) for i in range(60)]
    rows += [("few", "s", float(i), i < 14) for i in range(20)] + [("same", "s", 0.1, True) for _ in range(30)]
    df = spark.createDataFrame(rows, "k string, s string, value double, qualified boolean").repartition(7)
    want = {r.k: r for r in cohort.scored(df, ["k", "s"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("z").alias("scored"), F.max("z").alias("best")).collect()}
    best = cohort.best_scores(df, ["k", "s"])
    got = {r.k: r for r in best.collect()}
    assert got.keys() == want.keys() and (got["few"].scored, got["same"].scored, got["same"].best) == (0, 0, None)
    for k in ("a", "b", None):
        assert (got[k].n, got[k].scored, got[k].best) == (want[k].n, want[k].scored, pytest.approx(want[k].best))
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # which would move and sort every row


def test_elo_and_glicko_goldens(spark):
    series = spark.createDataFrame([("x", 1, 1, "a", "b", True), ("x", 2, 2, "a", "b", None), ("y", 3, 1, "a", "b", False)], "pool string, series int, at int, a string, b string, a_won boolean")
    got = {r.series: (r.p, r.rating_a, r.rating_b) for r in ratings.elo(series).collect()}
    assert got == {1: (0.5, 1516.0, 1484.0), 3: (0.5, 1484.0, 1516.0)}
    r, rd, vol = ratings.glicko2_update(1500, 200, 0.06, [(1400, 30, 1), (1550, 100, 0), (1700, 300, 0)])
    assert (round(r, 2), round(rd, 2), round(vol, 5)) == (1464.05, 151.52, 0.06) or (r, rd) == (pytest.approx(1464.06, abs=0.02), pytest.approx(151.52, abs=0.02))
    idle = ratings.glicko2_update(1500, 50, 0.06, [])
    assert idle[0] == 1500 and 50 < idle[1] <= 350
    periods = series.filter("a_won is not null").withColumn("period", F.col("at"))
    out = ratings.glicko2(periods).collect()
    assert len(out) == 4 and {r.side: r.rating > 1500 for r in out if r.pool == "x"} == {"a": True, "b": False}


def test_backtest_golden_and_bins(spark):
    p = spark.createDataFrame([(1, 0.8, True), (1, 0.6, False), (1, 0.5, True), (1, 0.3, False)], "k int, p double, won boolean")
    r = ratings.backtest(p, ["k"]).first()
    assert (r.n, round(r.brier, 6), r.accuracy) == (4, 0.185, 0.75)
    assert sum(b.n for b in ratings.calibration(p).collect()) == 4


@pytest.mark.parametrize(("ps", "want"), [([0.01, 0.02, 0.03, 0.04, 0.05], [0.05] * 5), ([0.05, 0.01, 0.03], [0.05, 0.03, 0.045])])
def test_false_discovery(spark, ps, want):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "family string, id int, p double")
    rows = sorted(ratings.adjusted_p(df, ["family"], ["id"]).collect(), key=lambda r: r.id)
    assert [round(r.q_bh, 9) for r in rows] == want
    assert all(r.q_by >= r.q_bh >= r.p - 1e-12 for r in rows)


def test_logistic_and_plus_minus_recover_what_was_planted(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.3 + x @ np.array([1.0, -2.0]))))
    df = spark.createDataFrame([(float(a), float(b), bool(w)) for (a, b), w in zip(x, y)], "a double, b double, won boolean")
    assert ratings.logistic(df, ["a", "b"], "won", l2=1e-6) == pytest.approx([0.3, 1.0, -2.0], abs=0.2)
    sides = spark.createDataFrame([(g, p, 1 if i < 2 else -1) for g in range(200) for i, p in enumerate(rng.permutation(6)[:4].tolist())], "game int, player int, sign int")
    strength = spark.createDataFrame([(p, float(p)) for p in range(6)], "player int, s double")
    margins = sides.join(strength, "player").groupBy("game").agg(F.sum(F.col("sign") * F.col("s")).alias("margin"))
    right = sides.join(margins, "game").groupBy(F.col("player").alias("i"), F.lit(0).alias("k")).agg(F.sum(F.col("sign") * F.col("margin")).alias("b"))
    systems = spark.createDataFrame([(0, 1e-3, 0.0)], "k int, ridge double, walk double")
    cells = linear.gram(sides.select("game", F.col("player").alias("column"), "sign"), "game").withColumn("w", F.lit(None).cast("double"))
    got = {r.i: r.x for r in linear.solve(cells, right, systems).collect()}
    assert [round(got[p] - got[0]) for p in range(6)] == list(range(6))


def test_empirical_bayes_shrinks_towards_the_mean(spark):
    df = spark.createDataFrame([("c", 1.0, 0.5), ("c", 2.0, 0.5), ("c", 6.0, 8.0)], "k string, mean double, variance double")
    rows = {r.mean: r for r in ratings.empirical_bayes(df, ["k"]).collect()}
    assert rows[6.0].posterior < 6 and rows[1.0].posterior > 1 and rows[6.0].tau2 == 0  # their variances explain all of the spread
    apart = spark.createDataFrame([("c", 1.0, 0.5), ("c", 4.0, 0.5), ("c", 9.0, 0.5), ("c", 6.0, 8.0)], "k string, mean double, variance double")
    rows = {r.mean: r for r in ratings.empirical_bayes(apart, ["k"]).collect()}
    assert 4.5 < rows[6.0].posterior < 6 and rows[1.0].posterior > 1 and 0 < rows[6.0].shrinkage < rows[1.0].shrinkage < 1


def test_sums_first_then_one_division(spark):
    lines = spark.createDataFrame([(1, 1, 1, 2020, "hp", 10.0, 5.0, 600.0), (1, 2, 1, 2020, "hp", 2.0, 10.0, 300.0)], "player int, game int, team int, season int, mode string, kills double, deaths double, duration_s double")
    rows = metrics.metric_rows(metrics.folded(lines, ["kills", "deaths", "duration_s"]), metrics.PLAYER_METRICS)
    got = {(r["mode"], r.metric): r.value for r in rows.collect()}
    assert got[("hp", "kd")] == pytest.approx(12 / 15) and got[(None, "kills_p10")] == pytest.approx(12 / 900 * 600)
    assert ("hp", "headshot_rate") not in got
    assert len({m.key for m in metrics.PLAYER_METRICS}) == len(metrics.PLAYER_METRICS) == 105


def test_zero_divisors_leave_rows_out_and_missing_is_not_zero(spark):
    lines = spark.createDataFrame([(1, 1, 1, 2020, "hp", 3.0, 0.0, 0.0, None), (1, 2, 1, 2020, "hp", 3.0, 0.0, 0.0, 90.0)], "player int, game int, team int, season int, mode string, kills double, deaths double, duration_s double, damage double")
    rows = metrics.metric_rows(metrics.folded(lines, ["kills", "deaths", "duration_s", "damage"]), metrics.PLAYER_METRICS)
    got = {(r["mode"], r.metric): (r.value, r.denom) for r in rows.collect()}
    assert got[("hp", "kd")][0] == 6 and ("hp", "kills_p10") not in got and got[("hp", "damage_pm")] == (90.0, 1.0)


def test_series_and_team_metrics(spark):
    games = [(1, o, t, 2020, (t == 1) == w) for o, w in enumerate([True, True, False, False, True]) for t in (1, 2)]
    df = spark.createDataFrame(games, "series int, ordinal int, team int, season int, won boolean")
    got = {r.team: (r.series_win_rate, r.series, r.decider_win_rate, r.deciders) for r in metrics.series_metrics(df).collect()}
    assert got == {1: (1.0, 1, 1.0, 1), 2: (0.0, 1, 0.0, 1)}
    lines = spark.createDataFrame([(1, t, 10 * t + p, 2020, "hp", 10, h) for t in (1, 2) for p, h in enumerate((0, 60))], "game int, team int, player int, season int, mode string, kills int, hill_time int")
    results = spark.createDataFrame([(1, 1, 2, 250, 200, True), (1, 2, 1, 200, 250, False)], "game int, team int, opponent int, score int, opponent_score int, won boolean")
    rows = {(r.team, r["mode"], r.metric): r.value for r in metrics.team_metrics(lines, results).collect()}
    assert rows[(1, "hp", "hp_avg_margin")] == 50 and rows[(1, "hp", "hill_time_gini")] == pytest.approx(0.5) and rows[(2, None, "map_win_rate")] == 0


def test_report_resolution_pivot_and_exports(spark):
    report = reports.resolve({"preset": "p", "years": "2020,x,2021", "sort": "zzz"}, ["kd", "kills_pm"], {"p": {"metrics": "kills_pm,kd,none"}})
    assert report.metrics == ("kills_pm", "kd") and report.years == (2020, 2021) and report.sort == "kills_pm" and report.descending
    rows = spark.createDataFrame(
        [(1, 2020, None, "kd", 1.5, 9.0, True, None, None), (2, 2020, None, "kd", 2.5, 9.0, True, None, None), (3, 2020, None, "kd", 9.0, 1.0, False, None, None), (2, 2020, None, "kills_pm", 20.0, 9.0, True, None, None)],
        "player int, season int, mode string, metric string, value double, denom double, qualified boolean, z double, pctl double",
    )
    table = reports.wide(rows, reports.resolve({"metrics": "kd,kills_pm"}, ["kd", "kills_pm"]))
    assert [(r.player, r.kills_pm_value) for r in table.collect()] == [(2, 20.0), (1, None)]
    assert [r.player for r in reports.wide(rows, reports.resolve({"metrics": "kd", "players": "3"}, ["kd"])).collect()] == [3]
    odd = spark.createDataFrame([('a,"b', 1), (None, 2)], "name string, n int")
    csv, cut = reports.exported(odd, "csv", 1)
    assert csv.decode("utf-8-sig") == 'name,n\r\n"a,""b",1\r\n' and cut
    assert json.loads(reports.exported(odd, "json")[0])[1] == {"name": None, "n": 2}
    assert b"<n>2</n>" in reports.exported(odd, "xml")[0]
    book = zipfile.ZipFile(BytesIO(reports.exported(odd, "xlsx")[0]))
    assert b"a,&quot;b" in book.read("xl/worksheets/sheet1.xml") or b'a,"b' in book.read("xl/worksheets/sheet1.xml")


def test_runs_replace_themselves_and_differences_are_named(spark, tmp_path):
    path = str(tmp_path / "marts")
    for value in (1.0, 2.0):
        runs.publish(spark.createDataFrame([("a", value)], "k string, value double"), path, "elo", "1", "2024-01-01")
    runs.publish(spark.createDataFrame([("a", 9.0)], "k string, value double"), path, "elo", "1", "2024-02-01")
    assert sorted(r.value for r in spark.read.parquet(path).collect()) == [2.0, 9.0]
    old = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", -1.0)], "path string, value double")
    new = spark.createDataFrame([("a", 1.0 + 1e-9), ("b", 2.0), ("d", 1.0), ("e", 1.0)], "path string, value double")
    assert {r.path: r.verdict for r in runs.compared(old, new).collect()} == {"a": "same", "b": "moved", "c": "removed", "d": "flipped", "e": "added"}


def test_findings_are_capped_and_trends_need_one_direction(spark):
    rows = spark.createDataFrame([(1, "k", s, str(s)) for s in (0.1, 0.5, 0.9)], "subject int, kind string, score double, headline string")
    assert sorted(r.score for r in findings.capped(rows).collect()) == [0.5, 0.9]
    seasons = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (1, 3, 0.4), (2, 1, 0.1), (2, 2, 0.5), (2, 3, 0.4)], "player int, season int, pctl double")
    assert [r.subject for r in findings.trends(seasons).collect()] == [1]


def test_trends_take_every_season(spark, tmp_path):
    from matchloom.plans.registry import QUERIES

    # of eight players one rises and one falls from season to season, all before 1999; each has eight lines a season
    place = {1993: [0, 1, 2, 3, 4, 5, 6, 7], 1994: [3, 0, 1, 2, 5, 4, 7, 6], 1995: [7, 1, 0, 3, 2, 5, 4, 6]}
    rows = [(p, 100 * year + game, f"{year}-05-0{game + 1}", "A", 10.0 + at, 1, 1.0, "O", 0.0) for year, order in place.items() for p, at in enumerate(order) for game in range(8)]
    names = "l_suppkey long, l_orderkey long, l_shipdate string, l_returnflag string, l_quantity double, l_linenumber int, l_extendedprice double, l_linestatus string, l_discount double"
    spark.createDataFrame(rows, names).withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted((r.subject, r.score) for r in QUERIES["fd_trend"](spark, str(tmp_path)).collect()) == [(0, 0.875), (2, 0.25)]


def test_quality_checks_and_identity(spark):
    t = {"a": spark.createDataFrame([(1, 2), (1, -1), (9, 3)], "k int, v int"), "b": spark.createDataFrame([(1,)], "k int")}
    checks = [quality.Check("neg", quality.negative("a", ["v"])), quality.Check("dup", quality.duplicated("a", ["k"])), quality.Check("orphan", quality.orphaned("a", "k", "b", "k"), hard=False)]
    assert {r.check_name: r.failing for r in quality.report(checks, t).collect()} == {"neg": 1, "dup": 1, "orphan": 1}
    names = spark.createDataFrame([(1, "Scump"), (2, "scump_"), (3, "Scumpp"), (4, "Crimsix")], "player int, handle string")
    assert {(r.a, r.b, r.reason) for r in quality.identity_candidates(names).collect()} == {(1, 2, "same key"), (1, 3, "one edit"), (2, 3, "one edit")}


def test_blend_ranks_and_numbers(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(weighted_present({"a": 0.5, "b": 0.5})).collect()] == [2.0, 1.0, None]
    x = spark.createDataFrame([(v,) for v in (5, 1, 3, 3)], "v int")
    assert sorted((r.v, r.rk) for r in average_rank(x, "v", "rk").collect()) == [(1, 1.0), (3, 2.5), (3, 2.5), (5, 4.0)]
    y = spark.range(1000).withColumn("k", F.rand(3))
    assert sorted(r.place for r in numbered(y, ["k", "id"], "place").collect()) == list(range(1, 1001))


def test_archives_tarballs_and_linkage(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿player,kills,acc\nx,10,12.5%\n".encode())
    (tmp_path / "b.csv").write_text("player,kills,bonus\ny,,0.0%\nz,7m,3\n")
    rows = records.typed(records.read_archive(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["player", "kills", "acc"]), ["kills", "acc"])
    got = {r.player: (r.kills, r.acc, r.extras) for r in rows.collect()}
    assert got == {"x": (10.0, 12.5, {}), "y": (None, None, {}), "z": (7.0, None, {"bonus": "3"})}
    with tarfile.open(tmp_path / "feed.tar.gz", "w:gz") as tar:
        for i in range(3):
            data = json.dumps({"data": {"attacker": {"name": "q"}} if i else {"attacker_name": "q"}}).encode()
            info = tarfile.TarInfo(f"g{i}.json")
            info.size = len(data)
            tar.addfile(info, BytesIO(data))
    feed = records.read_tarballs(spark, str(tmp_path / "feed.tar.gz"))
    assert sorted(r[0] for r in feed.select(records.death_shape(F.col("body"))).collect()) == ["flat", "nested", "nested"]
    maps = "id string, map string, mode string, day date, players array<string>"
    a = spark.createDataFrame([("a1", "m", "hp", None, ["p", "q"])], maps).withColumn("day", F.to_date(F.lit("2020-01-01")))
    b = spark.createDataFrame([("b1", "m", "hp", None, ["p", "q"]), ("b2", "m", "hp", None, ["p"])], maps).withColumn("day", F.to_date(F.lit("2020-01-02")))
    assert [tuple(r) for r in records.linked(a, b).collect()] == [("a1", "b1")]
    s = spark.createDataFrame([(1, "x", "p", "2020-01-01"), (2, "y", "p", "2020-01-02"), (3, "y", "p", "2020-01-05"), (4, "x", "p", "2020-01-01")], "id int, catalogue string, pair string, day string").withColumn("day", F.to_date("day"))
    assert sorted(r.id for r in records.without_repeats(s, {"x": 0, "y": 1}).collect()) == [1, 3, 4]


def test_identity_candidates_of_short_handles(spark):
    from matchloom.operators.quality import identity_candidates

    names = spark.createDataFrame([(1, "scump"), (2, "skump"), (3, "scum"), (4, "scump"), (5, "other"), (6, "a"), (7, "b")], "player int, handle string")
    got = sorted(tuple(r) for r in identity_candidates(names).collect())
    assert got == [(1, 2, "one edit"), (1, 3, "one edit"), (1, 4, "same key"), (2, 4, "one edit"), (3, 4, "one edit"), (6, 7, "one edit")]


def test_report_parameters():
    from matchloom.operators import reports

    presets = {"p": {"metrics": "kd,accuracy", "years": "2020,2019", "mode": "hp", "sort": "accuracy"}}
    asked = {"plain": {}, "preset": {"preset": "p"}, "over": {"preset": "p", "metrics": "kd,kd", "years": "2021", "qualified": "0", "dir": "asc"}, "bad": {"metrics": "no,kd", "years": "x,2020", "sort": "no"}}
    found = {name: reports.resolve(params, ["kd", "accuracy"], presets) for name, params in asked.items()}
    got = {name: (",".join(r.metrics), ",".join(map(str, r.years)), r.mode, r.qualified, r.sort, r.descending) for name, r in found.items()}
    assert got == {
        "plain": ("kd", "", None, True, "kd", True), "preset": ("kd,accuracy", "2019,2020", "hp", True, "accuracy", True), "over": ("kd", "2021", "hp", False, "kd", False), "bad": ("kd", "2020", None, True, "kd", True)
    }
