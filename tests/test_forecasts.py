import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import forecasts, ratings, resample
from matchloom.operators import player_rating as pr

COLUMNS = "season int, mode string, title string, game int, event int, team int, player int, won boolean, kills double, deaths double, hill double, score double, duration_s double"
SLOTS = {
    "hp": (pr.paced("kills", "kills"), pr.paced("deaths", "deaths"), (*pr.paced("hill", "hill"), pr.Form("score_pm", "score", "1", ("score",)))),
    "snd": (pr.paced("kills", "kills"), pr.paced("deaths", "deaths")),
}


def lines_of(rng, games=120):
    true = {p: rng.normal() for p in range(16)}
    rows = []
    for g in range(games):
        season, mode = 2018 + g % 2, "hp" if g % 4 < 2 else "snd"
        picked = rng.permutation(16)[:6].tolist()
        edge = sum(true[p] for p in picked[:3]) - sum(true[p] for p in picked[3:])
        won = bool(rng.random() < 1 / (1 + math.exp(-edge)))
        for i, p in enumerate(picked):
            rows.append((season, mode, f"t{season}", g, g // 20, i // 3, p, won if i < 3 else not won, float(20 + 4 * true[p] + rng.normal()), float(20 + rng.integers(0, 5)), float(rng.integers(1, 60)) if season == 2018 else None, float(rng.integers(1, 9)), 600.0 if season == 2019 else None))
    return rows, true


def test_features_profiles_and_ratings(spark):
    rng = np.random.default_rng(1)
    rows, true = lines_of(rng, 400)
    df = spark.createDataFrame(rows, COLUMNS).cache()
    forms = pr.resolved(df, SLOTS).cache()
    assert {(r.season, r.mode): (r.form0, r.form1, r.form2) for r in forms.collect()} == {(2018, "hp"): (1, 1, 1), (2019, "hp"): (0, 0, 2), (2018, "snd"): (1, 1, None), (2019, "snd"): (0, 0, None)}
    given = pr.terms(df, forms, SLOTS).cache()
    diffs = pr.differences(given, 3).cache()
    one = diffs.filter("season = 2019 and mode = 'hp'").first()
    own = lambda team: [r for r in rows if r[3] == one.game and r[5] == team]
    rate = lambda team, at, per: sum(r[at] for r in own(team)) / per(own(team))
    minutes = lambda some: sum(r[12] / 600 for r in some)
    assert one.x0 == pytest.approx(rate(0, 8, minutes) - rate(1, 8, minutes)) and one.x2 == pytest.approx(rate(0, 11, len) - rate(1, 11, len)) and one.won == own(0)[0][7]
    weights = pr.mode_weights(diffs, 3).cache()
    fit = {(r.season, r.mode): r for r in weights.collect()}
    cohort = [r for r in diffs.collect() if (r.season, r.mode) == (2018, "hp")]
    x = np.array([[r.x0, r.x1, r.x2] for r in cohort])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    y, full, beta = np.array([float(r.won) for r in cohort]), np.hstack([np.ones((len(cohort), 1)), z]), np.zeros(4)
    for _ in range(60):
        m = 1 / (1 + np.exp(-full @ beta))
        beta += np.linalg.solve((full * (m * (1 - m))[:, None]).T @ full + np.diag([0, 1, 1, 1]), full.T @ (y - m) - np.array([0, 1, 1, 1]) * beta)
    got = fit[2018, "hp"]
    assert [got.intercept, got.x0, got.x1, got.x2] == pytest.approx(list(beta), abs=1e-7) and got.n == len(cohort) and fit[2018, "snd"].x2 == 0
    intervals = {(r.season, r.mode): r for r in pr.weight_intervals(diffs, 3, 40).collect()}
    assert intervals[2018, "hp"].x0_low < beta[1] < intervals[2018, "hp"].x0_high and intervals[2018, "hp"].draws == 40 and intervals[2018, "hp"].ratio_low >= 0
    numbers = {r.game: r.u for r in diffs.select("game", resample.unit_number(F.col("game")).alias("u")).collect()}
    w = resample.copies(np.array([numbers[r.game] for r in cohort]), np.arange(1, 41)).astype(float)
    drawn = []
    for times in w.T:
        mid = (times @ x) / times.sum()
        sd = np.sqrt((times @ (x - mid) ** 2) / (times.sum() - 1))
        full, beta = np.hstack([np.ones((len(x), 1)), (x - mid) / sd]), np.zeros(4)
        for _ in range(60):
            m = 1 / (1 + np.exp(-full @ beta))
            beta += np.linalg.solve((full * (times * m * (1 - m))[:, None]).T @ full + np.diag([0, 1, 1, 1]), full.T @ (times * (y - m)) - np.array([0, 1, 1, 1]) * beta)
        drawn.append(beta[1:])
    own = intervals[2018, "hp"]
    assert [own.x0_low, own.x1_low, own.x2_low] == pytest.approx(list(np.percentile(drawn, 2.5, axis=0)), abs=1e-6) and [own.x0_high, own.x2_high] == pytest.approx(list(np.percentile(drawn, 97.5, axis=0)[[0, 2]]), abs=1e-6)
    rated = pr.player_ratings(given, weights, 3).collect()
    pooled = {(r.season, r.player): r for r in rated if r["mode"] is None}
    assert len(pooled) == 32 and np.corrcoef([pooled[2018, p].rating for p in range(16)], [true[p] for p in range(16)])[0, 1] > 0.8
    for (season, player), r in pooled.items():
        parts = [q for q in rated if q.season == season and q.player == player and q["mode"] is not None]
        assert r.maps == sum(q.maps for q in parts) and r.rating == pytest.approx(1 + sum((q.rating - 1) * q.maps for q in parts) / r.maps)
        assert all(q.rating == pytest.approx(1 + 0.15 * q.score * q.maps / (q.maps + q.k)) for q in parts)


def test_backtest_and_sign_rules(spark):
    rng = np.random.default_rng(2)
    rows, _ = lines_of(rng, 400)
    df = spark.createDataFrame(rows, COLUMNS)
    diffs = pr.differences(pr.terms(df, pr.resolved(df, SLOTS), SLOTS), 3).withColumn("x2", F.when(F.col("won"), 1.0).otherwise(-1.0)).cache()  # a leak
    order = spark.createDataFrame([(e, e) for e in range(20)], "event int, place int")
    found = pr.backtest_maps(diffs, 3, order).cache()
    assert found.count() > 100 and found.filter("event < 8").isEmpty()  # 5 maps a cohort and event: 40 earlier ones from event 8 on
    rules = {(r.season, r.mode, r.slot): r for r in pr.sign_rules(diffs, 3, found).collect()}
    assert all(r.accuracy == 1 for (_, _, slot), r in rules.items() if slot == 2) and all(r.model_accuracy > 0.8 for r in rules.values())
    assert rules[2018, "hp", 0].accuracy >= 0.5 and rules[2018, "hp", 0].direction == 1


def test_prefixes_are_fitted_without_a_row_a_term(spark, monkeypatch):
    """Spans, blocks of rows and of fits that no prefix ends with, unsettled and absent rows: the weights of a regression of each prefix's rows."""
    for name, value in (("SPAN", 37), ("SPANS", 9), ("ROWS_AT_ONCE", 16), ("FITS_AT_ONCE", 3)):
        monkeypatch.setattr(ratings, name, value)
    rng = np.random.default_rng(21)
    x = rng.normal(size=(2, 400, 2))
    rows = [(p, i, *map(float, x[k, i]), None if i % 11 == 3 else float(rng.random() < 1 / (1 + np.exp(-x[k, i, 0])))) for k, p in enumerate("uv") for i in range(400 - 150 * k)]
    df = spark.createDataFrame(rows, "pool string, place int, f0 double, f1 double, y double")
    ends = df.select("pool", F.expr("place div 25").alias("block")).filter("block > 0").distinct().withColumn("end", F.col("block") * 25)
    want = ratings.logistic_by(df.join(ends, "pool").filter("place < end"), ["pool", "block"], ["f0", "f1"], "y")
    got = {(r.pool, r.block): r for r in ratings.logistic_of_prefixes(df, ends, ["f0", "f1"], "y").collect()}
    assert len(got) == ends.count()
    for r in want.collect():
        own = got[r.pool, r.block]
        assert own.n == r.n and (own.intercept, own.f0, own.f1) == pytest.approx((r.intercept, r.f0, r.f1), abs=1e-8)


def test_win_probability(spark):
    rng = np.random.default_rng(3)
    true = rng.normal(size=8)
    rows = []
    for i in range(420):
        a, b = rng.choice(8, 2, replace=False).tolist()
        rows.append(("x", i, i, i // 30, a, b, bool(rng.random() < 1 / (1 + math.exp(true[b] - true[a])))))
    rows.append(("x", 1000, 1000, 20, 0, 1, None))
    series = spark.createDataFrame(rows, "pool string, series int, at int, period int, a int, b int, a_won boolean").repartition(3)
    features = forecasts.series_features(series).cache()
    f = {r.series: r for r in features.collect()}
    assert len(f) == 420 and f[5].glicko == 0 and f[5].deviations == 2.0 and f[0].form == 0 and f[0].meetings == 0
    state, elo, wins, form, met = {}, {}, {}, {}, {}
    want = {}
    for period in range(14):
        games = {}
        for _, i, _, p, a, b, won in rows:
            if p != period or won is None:
                continue
            ra, rb = state.get(a, (1500, 350, 0.06)), state.get(b, (1500, 350, 0.06))
            damp = 1 / math.sqrt(1 + 3 * (ra[1] ** 2 + rb[1] ** 2) / 173.7178**2 / math.pi**2)
            last = lambda side: form.get(side, [])[-10:]
            score = lambda side: sum(last(side)) + 0.5 * (10 - len(last(side)))
            w, n = met.get((a, b), (0, 0))
            p_elo = ratings.elo_expected(elo.get(a, 1500.0), elo.get(b, 1500.0))
            want[i] = (damp * (ra[0] - rb[0]) / 173.7178, math.log(p_elo / (1 - p_elo)), (ra[1] + rb[1]) / 350, (score(a) - score(b)) / 10, (w + 2) / (n + 4) - 0.5)
            shift = 32 * (won - p_elo)
            elo[a], elo[b] = elo.get(a, 1500.0) + shift, elo.get(b, 1500.0) - shift
            form.setdefault(a, []).append(float(won))
            form.setdefault(b, []).append(1.0 - won)
            met[a, b], met[b, a] = (w + won, n + 1), (n - w + 1 - won, n + 1)
            games.setdefault(a, []).append((b, float(won)))
            games.setdefault(b, []).append((a, 1.0 - won))
        before = dict(state)
        for side in {*state, *games}:
            own = before.get(side, (1500, 350, 0.06))
            state[side] = ratings.glicko2_update(*own, [(*before.get(o, (1500, 350, 0.06))[:2], s) for o, s in games.get(side, [])])
    for i, values in want.items():
        assert [f[i].glicko, f[i].elo, f[i].deviations, f[i].form, f[i].meetings] == pytest.approx(list(values), abs=1e-9)
    got = {r.series: r for r in forecasts.win_probability(features).collect()}
    assert got[150].p == pytest.approx(1 / (1 + math.exp(-f[150].glicko)))
    past = [f[i] for i in range(250)]
    x = np.array([[1, *(r[c] for c in forecasts.FEATURES)] for r in past])
    y, beta, ridge = np.array([float(r.a_won) for r in past]), np.zeros(6), np.diag([0, 1, 1, 1, 1, 1.0])
    for _ in range(60):
        m = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (m * (1 - m))[:, None]).T @ x + ridge, x.T @ (y - m) - ridge @ beta)
    one = np.array([1, *(f[270][c] for c in forecasts.FEATURES)])
    assert got[270].p == pytest.approx(1 / (1 + math.exp(-one @ beta)), abs=1e-8)  # series 250 to 299 use the first 250


def test_controls(spark):
    rng = np.random.default_rng(4)
    true = {p: rng.normal() for p in range(12)}
    rows = []
    for g in range(300):
        picked = [int(p) for p in rng.permutation(12)[:6]]
        edge = sum(true[p] for p in picked[:3]) - sum(true[p] for p in picked[3:])
        rows.append((g, 1, sorted(picked[:3]), sorted(picked[3:]), bool(rng.random() < 1 / (1 + math.exp(-edge)))))
    maps = spark.createDataFrame([(g, s, 1, 2, h, v, w) for g, s, h, v, w in rows], "game int, season int, home int, away int, home_players array<int>, away_players array<int>, home_won boolean").cache()
    drawn = forecasts.shuffled_sides(maps, 2).collect()
    assert len(drawn) == 600 and all(len(r.home_players) == 3 and sorted((*r.home_players, *r.away_players)) == sorted((*rows[r.game][2], *rows[r.game][3])) for r in drawn)
    assert any(sorted(r.home_players) != rows[r.game][2] for r in drawn)
    control = forecasts.side_control(maps, 4).collect()
    assert len(control) == 4 and all(r.columns == 12 and r.covered >= 0.75 for r in control)
    x = rng.normal(size=200)
    pairs = spark.createDataFrame([(i, float(v), float(v + rng.normal())) for i, v in enumerate(x)], "u int, x double, y double")
    (found,) = forecasts.permuted_control(pairs, "u", 3).collect()
    assert found.n == 200 and found.observed > 0.5 and found.permuted_most < 0.3 and found.passes
    assert forecasts.permuted_control(pairs.limit(10), "u").collect() == []
