import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import hierarchy, ratings, resample, rounds, segments, skills


# --- two-level models ---------------------------------------------------------------------------------------------


def em(x, v, rounds_=200_000):
    tau2 = max(np.var(x, ddof=1) - v.mean(), 0.01 * np.var(x, ddof=1))
    for _ in range(rounds_):
        w = 1 / (tau2 + v)
        mu = (w * x).sum() / w.sum()
        b = tau2 * w
        new = (b * v + (b * (x - mu)) ** 2).mean()
        if abs(new - tau2) <= 1e-13 * max(tau2, 1e-9):
            break
        tau2 = new
    return mu, tau2


def test_spread_is_the_fixed_point_of_em(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k, (tau, size) in {"wide": (1.0, 60), "small": (0.2, 200), "none": (0.0, 80), "scale": (1e-4, 100)}.items():
        v = rng.uniform(0.01, 0.3, size) * (1e-8 if k == "scale" else 1)
        x = rng.normal(5, tau, size) + rng.normal(size=size) * np.sqrt(v)
        if k == "none":
            x = 5 + (x - x.mean()) * 0.3
        rows += [(k, float(a), float(b)) for a, b in zip(x, v)]
        want[k] = em(x, v)
    rows += [("one", 3.0, 0.1), (None, 1.0, 0.1), (None, 2.0, 0.1), (None, 4.0, 0.1)]
    got = {r.k: r for r in hierarchy.spread(spark.createDataFrame(rows, "k string, mean double, variance double"), ["k"]).collect()}
    for k in ("wide", "small", "scale"):
        assert got[k].tau2 == pytest.approx(want[k][1], rel=1e-5) and got[k].mu == pytest.approx(want[k][0], rel=1e-9)
    assert got["none"].tau2 == 0 and want["none"][1] < 1e-4 and (got["one"].tau2, got["one"].mu) == (0, 3.0) and got[None].tau2 > 0
    assert got["wide"].rounds < 60


def test_components_and_posterior(spark):
    rng = np.random.default_rng(2)
    rows = []
    for cohort, tau in (("a", 0.8), ("b", 0.0)):
        for p in range(60):
            true = rng.normal(0, tau)
            rows += [(cohort, p, float(true + rng.normal(0, 1.5))) for _ in range(int(rng.integers(1, 30)))]
    rows += [("single", 1, 1.0), ("single", 1, 2.0), ("flat", 1, 1.0), ("flat", 2, 3.0)]
    df = spark.createDataFrame(rows, "cohort string, player int, y double")
    parts = {r.cohort: r for r in hierarchy.components(df, ["cohort"]).collect()}
    groups = {}
    for c, p, y in rows:
        groups.setdefault(c, {}).setdefault(p, []).append(y)
    own = [np.array(v) for v in groups["a"].values()]
    total, n = sum(map(len, own)), len(own)
    within = sum(((g - g.mean()) ** 2).sum() for g in own) / (total - n)
    grand = np.concatenate(own).mean()
    between = sum(len(g) * (g.mean() - grand) ** 2 for g in own) / (n - 1)
    m0 = (total - sum(len(g) ** 2 for g in own) / total) / (n - 1)
    assert parts["a"].within == pytest.approx(within) and parts["a"].k == pytest.approx(within / ((between - within) / m0)) and parts["a"].estimated
    assert (parts["single"].k, parts["single"].estimated, parts["flat"].k, parts["flat"].estimated) == (15.0, False, 15.0, False)
    got = {(r.cohort, r.player): r for r in hierarchy.posterior_ratings(df, ["cohort"]).collect()}
    x, maps = np.array([g.mean() for g in own]), np.array([len(g) for g in own])
    mu, tau2 = em(x, within / maps)
    for k, p in enumerate(groups["a"]):
        v = within / maps[k]
        b = tau2 / (tau2 + v)
        r = got["a", p]
        assert r.z == pytest.approx((mu + b * (x[k] - mu) - x.mean()) / math.sqrt(tau2), abs=1e-4) and r.sd == pytest.approx(math.sqrt(b * v / tau2), rel=1e-4) and r.shrinkage == pytest.approx(b, rel=1e-4)
    assert not got["a", 0].collapsed and ("single", 1) not in got
    flat = got["flat", 1]  # the asserted ratio keeps half of a score at 15 maps
    assert flat.shrinkage == pytest.approx(1 / 16) and not flat.estimated


def test_regressions_settle(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [3.0, -2.0])))).astype(float)
    rows = [("a", float(p), float(q), float(w)) for (p, q), w in zip(x, y)] + [("b", 0.5, 0.1, 1.0), ("b", 0.2, 0.3, 1.0)]
    df = spark.createDataFrame(rows, "k string, p double, q double, y double")
    got = {r.k: r for r in ratings.logistic_by(df, ["k"], ["p", "q"], "y").collect()}
    full, beta = np.hstack([np.ones((400, 1)), x]), np.zeros(3)
    for _ in range(100):
        m = 1 / (1 + np.exp(-full @ beta))
        beta += np.linalg.solve((full * (m * (1 - m))[:, None]).T @ full + np.diag([0, 1, 1]), full.T @ (y - m) - np.array([0, 1, 1]) * beta)
    assert [got["a"].intercept, got["a"].p, got["a"].q] == pytest.approx(list(beta), abs=1e-8) and got["b"].intercept > 15
    cells = df.filter("k = 'a'").withColumn("p", F.round("p")).groupBy("k", "p").agg(F.sum("y").alias("wins"), F.count(F.lit(1)).alias("n"))
    whole = ratings.logistic_by(df.filter("k = 'a'").withColumn("p", F.round("p")), ["k"], ["p"], "y").first()
    one = ratings.logistic_by(cells, ["k"], ["p"], "wins", weight="n").first()
    assert (one.n, one.p) == (whole.n, pytest.approx(whole.p, abs=1e-9))


# --- resampling ---------------------------------------------------------------------------------------------------


def test_bootstrap_and_paired_gaps(spark):
    rng = np.random.default_rng(4)
    rows = [("a", f"u{i}", float(v)) for i, v in enumerate(rng.normal(0.2, 1, 800))] + [("b", f"w{i}", 1.0) for i in range(20)] + [(None, "n", 2.0), ("a", "gone", None)]
    df = spark.createDataFrame(rows, "k string, u string, gap double").repartition(5)
    got = {r.k: r for r in resample.paired_gaps(df, "u", "gap", ["k"], 400).collect()}
    values = np.array([v for k, _, v in rows if k == "a" and v is not None])
    se = values.std(ddof=1) / math.sqrt(800)
    a = got["a"]
    assert (a.n, a.mean) == (800, pytest.approx(values.mean())) and a.dm_t == pytest.approx(values.mean() / se) and a.mde80 == pytest.approx(2.801585 * se)
    assert a.dm_p == pytest.approx(math.erfc(abs(values.mean() / se) / math.sqrt(2))) and a.high - a.low == pytest.approx(3.92 * se, rel=0.2) and a.excludes_zero == (a.low > 0)
    assert got["b"].n == 20 and got["b"].low is None and got["b"].dm_p is None and got[None].mean == 2.0
    number = {r.u: r.x for r in df.select("u", resample.unit_number(F.col("u")).alias("x")).collect()}
    drawn = spark.createDataFrame([(1,)], "a int").select(resample.draw(F.lit(number["u3"]).cast("long"), F.lit(7).cast("long"))).first()[0]
    assert resample.copies(np.array([number["u3"]]), np.array([7]))[0, 0] == np.searchsorted(resample.POISSON, drawn >> 15, side="right")


# --- segments -----------------------------------------------------------------------------------------------------

SEGMENTS = "game int, kind string, ordinal int, team int, score int, won boolean, win_type string"
MAPS = "game int, season int, event int, winner int, team1 int, team2 int, score1 int, score2 int"


def rows_of(game, kind, wins, scores=None):
    return [(game, kind, n, team, scores[n - 1][team - 1] if scores else None, (team == 1) == w, "wipe" if w else "time") for n, w in enumerate(wins, 1) for team in (1, 2)]


def test_segments(spark):
    hill = [(30, 10), (60, 90), (250, 120)]
    s = rows_of(1, "snd_round", [1, 1, 0, 1]) + rows_of(2, "hill", [1, 0, 1], hill) + rows_of(3, "snd_round", [1, 0, 1])[:-1] + rows_of(4, "snd_round", [0, 1])[2:]
    s += [(5, "snd_round", n, 1, None, True, None) for n in (1, 2)] + rows_of(6, "hill", [1, 1], [(30, 10), (20, 20)]) + rows_of(7, "hill", [1, 1], [(30, 10), (260, 20)]) + rows_of(8, "hill", [1, 1], hill[:2])
    s += rows_of(9, "hill", [1, 1], [(30, None), (60, 70)]) + rows_of(10, "snd_round", [1]) + rows_of(11, "snd_round", [1]) + rows_of(12, "hill", [1, 1], hill[:2])[:-1]
    m = [(g, 2020, g, 1, 1, 2, None, None) for g in range(1, 13)]
    m[1], m[7], m[9], m[10] = (2, 2020, 2, 1, 2, 1, 120, 250), (8, 2020, 8, 1, 1, 2, 61, 90), (10, 2020, 10, None, 1, 2, None, None), (11, 2020, 11, 7, 1, 2, None, None)
    got = {r.game: r for r in segments.loaded(spark.createDataFrame(s[::-1], SEGMENTS), spark.createDataFrame(m, MAPS)).collect()}
    assert {g: r.reason for g, r in got.items()} == {1: None, 2: None, 3: None, 4: "nothing_left", 5: "one_team", 6: "score_falls", 7: "score_too_high", 8: "score_differs", 9: "no_score", 10: "no_winner", 11: "other_winner", 12: "missing_side"}
    assert [(x.own, x.other, x.own_won, x.win_type) for x in got[1].steps] == [(1, 0, 1, "wipe"), (2, 0, 1, "wipe"), (2, 1, 0, "time"), (3, 1, 1, "wipe")]
    assert [(x.own, x.other) for x in got[2].steps] == hill and (got[3].dropped, len(got[3].steps), got[2].dropped) == (1, 2, 0)
    df = segments.loaded(spark.createDataFrame(s, SEGMENTS), spark.createDataFrame(m, MAPS))
    tally = {(r.kind, r.reason): (r.maps, r.truncated, r.dropped) for r in segments.report(df).collect()}
    assert tally["snd_round", None] == (2, 1, 1) and tally["hill", "score_falls"] == (1, 0, 0)
    states = segments.states(df)
    seen = {(r.game, r.own, r.other, r.won) for r in states.collect()}
    assert (1, 3, 1, True) in seen and (1, 1, 3, False) in seen and (2, 250, 120, True) not in seen
    assert {(r.cell_own, r.cell_other) for r in states.filter("game = 2").collect()} == {(1, 1), (0, -1), (2, -2), (3, 2)}


def test_grids():
    race = segments.race_grid(6)
    for own in range(6):
        for other in range(6):
            assert race[own, other] == pytest.approx(0.5 * race[own + 1, other] + 0.5 * race[own, other + 1])
    shares = [(0, 10, 0.2), (10, 0, 0.2), (10, 10, 0.3), (25, 5, 0.15), (5, 25, 0.15)]
    grid = segments.hill_grid(shares, 60)
    for own in range(60):
        assert grid[own, own] == pytest.approx(0.5)
        for other in range(60):
            want = 0.0
            for a, b, w in shares:
                na, nb = min(own + a, 60), min(other + b, 60)
                want += w * (0.5 if na == nb == 60 else 1.0 if na == 60 else 0.0 if nb == 60 else grid[na, nb])
            assert grid[own, other] == pytest.approx(want)


def test_baseline_and_eras(spark):
    rng = np.random.default_rng(6)
    s, m, feed = [], [], []
    for g in range(80):
        wins = []
        while wins.count(1) < 6 and wins.count(0) < 6:
            wins.append(int(rng.random() < 0.5))
        s += rows_of(g, "snd_round", wins)
        m.append((g, 2020, g % 5, 1 if wins.count(1) == 6 else 2, 1, 2, None, None))
        feed += [(g, 2018, 1, n, 1 if w else 2) for n, w in enumerate(wins)]
    feed += [(500, 2017, 1, n, 1) for n in range(5)]
    df = segments.loaded(spark.createDataFrame(s, SEGMENTS), spark.createDataFrame(m, MAPS)).cache()
    (row,) = segments.compared(segments.states(df), segments.baseline(df)).collect()
    assert row.table_brier <= row.baseline_brier < 0.25
    fed = segments.feed_maps(spark.createDataFrame(feed, "game int, season int, event int, round int, side int"))
    assert {r.reason for r in fed.filter("game = 500").collect()} == {"other_race"}
    cells = segments.two_eras(segments.states(df), segments.states(fed)).collect()
    assert len(cells) > 30 and all(r.delta == 0 and r.n_one == r.n_other for r in cells)


# --- skills and modes ---------------------------------------------------------------------------------------------


def test_plackett_luce(spark):
    won, lost, p = skills.plackett_luce([(25.0, 25 / 3)], [(25.0, 25 / 3)])
    assert p == pytest.approx(0.5) and won[0] == (pytest.approx(27.63523138, abs=2e-3), pytest.approx(8.0655063, abs=2e-3)) and lost[0][0] == pytest.approx(50 - won[0][0])
    rng = np.random.default_rng(7)
    true = {p: rng.normal() for p in range(12)}
    rows = []
    for i in range(900):
        picked = rng.permutation(12)[:6].tolist()
        a, b = picked[:3], picked[3:]
        rows.append(("x", i, i, i // 300, a, b, bool(rng.random() < 1 / (1 + math.exp(-2 * (sum(true[p] for p in a) - sum(true[p] for p in b)))))))
    rows.append(("x", 2000, 2000, 2, [1], [2], None))
    maps = spark.createDataFrame(rows, "pool string, map int, at int, season int, a_players array<int>, b_players array<int>, a_won boolean").repartition(3)
    rated = skills.skill_ratings(maps).cache()
    last = {r.player: r.mean for r in rated.orderBy("map").collect()}
    assert np.corrcoef([last[p] for p in range(12)], [true[p] for p in range(12)])[0, 1] > 0.9
    forecasts = rated.select("map", "p", "a_won").distinct()
    assert forecasts.count() == 900 and forecasts.filter("map > 200").agg(F.avg(F.pow(F.col("p") - F.col("a_won").cast("int"), 2))).first()[0] < 0.2
    seasons = skills.season_skills(rated, maps).collect()
    assert {r.season for r in seasons} == {0, 1, 2} and all(r.maps >= 8 for r in seasons)


def test_mode_null(spark):
    rng = np.random.default_rng(8)
    def league(special):
        rows = []
        for i in range(1200):
            a, b = rng.choice(6, 2, replace=False).tolist()
            mode = int(rng.integers(0, 3))
            edge = (3.0 if a % 3 == mode else 0.0) - (3.0 if b % 3 == mode else 0.0) if special else 0.0
            rows.append((i, i, i // 60, f"m{mode}", a, b, bool(rng.random() < 1 / (1 + math.exp(-edge)))))
        return rows
    rows = [("special", *r) for r in league(True)] + [("even", *r) for r in league(False)]
    maps = spark.createDataFrame(rows, "pool string, map int, at int, event int, mode string, a int, b int, a_won boolean")
    drawn = skills.permuted_modes(maps, "event", 2).collect()
    for replicate in (0, 1, 2):
        own = [r for r in drawn if r.replicate == replicate and r.pool == "even"]
        by_event = lambda key: sorted((r.event, r[key]) for r in own)
        assert by_event("mode") == by_event("dealt") and (replicate == 0) == all(r.mode == r.dealt for r in own)
    got = {r.pool: r for r in skills.mode_null(maps, "event", 40).collect()}
    assert got["special"].exceeds and got["special"].p_value == pytest.approx(1 / 41) and got["even"].p_value > 0.02 and got["even"].draws == 40 and got["even"].cells == 18


def test_modes_are_dealt_as_permuted_without_a_row_a_draw(spark, monkeypatch):
    monkeypatch.setattr(skills, "BLOCK", 3)  # two blocks, the last one not full
    rows = [(p, i, i // 7, i // 20, None if i % 9 == 0 else f"m{i * i % 4}", i % 5, (i + 1) % 5, i % 3 == 0) for p in "xy" for i in range(100)]
    maps = spark.createDataFrame(rows, "pool string, map int, at int, event int, mode string, a int, b int, a_won boolean")
    kinds, dealt = [None, "m0", "m1"], skills.dealt_modes(maps, "event", [None, "m0", "m1"], 4).collect()
    assert len(dealt) == 2 * len(rows) and {(r.block, len(r.modes)) for r in dealt} == {(0, 6), (1, 4)}
    got = {(r.pool, r.map, 3 * r.block + d): kinds[code] for r in dealt for d, code in enumerate(np.frombuffer(r.modes, np.uint16))}
    assert got == {(r.pool, r.map, r.replicate): r.dealt for r in skills.permuted_modes(maps, "event", 4).collect()}


# --- rounds -------------------------------------------------------------------------------------------------------


def test_rounds_walk_forward(spark):
    rng = np.random.default_rng(9)
    rows = []
    for r in range(240):
        own, other, event = 4, 4, r // 60
        won = None
        states = []
        while own and other:
            states.append((own, other, int(rng.integers(0, 150_000))))
            if rng.random() < 0.5:
                own -= 1
            else:
                other -= 1
        won = other == 0
        for a, b, t in states:
            rows += [(event, r, a, b, t, won), (event, r, b, a, t, not won)]
    df = spark.createDataFrame(rows, "event int, round int, own int, other int, time_ms int, won boolean")
    losses = rounds.walk_forward(df).cache()
    assert losses.count() == 180 * 7 and losses.filter("event = 0").isEmpty()
    of = {r.model: r.loss for r in losses.groupBy("model").agg(F.avg("loss").alias("loss")).collect()}
    assert of["coin_flip"] == pytest.approx(0.25) and all(of[m] < 0.22 for m in of if m != "coin_flip")
    past = [(a, b, w) for e, _, a, b, _, w in rows if e < 2]
    x = np.array([[1.0, a - b] for a, b, _ in past])
    y, beta = np.array([float(w) for *_, w in past]), np.zeros(2)
    for _ in range(50):
        m = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (m * (1 - m))[:, None]).T @ x + np.diag([0, 1.0]), x.T @ (y - m) - np.array([0, 1.0]) * beta)
    one = [(a, b, w) for e, r, a, b, _, w in rows if r == 130]
    want = np.mean([(1 / (1 + math.exp(-(beta[0] + beta[1] * (a - b)))) - w) ** 2 for a, b, w in one])
    table = {(a, b): (sum(w for p, q, w in past if (p, q) == (a, b)) + 0.5) / (sum((p, q) == (a, b) for p, q, _ in past) + 1) for a, b, _ in one}
    got = {r.model: r.loss for r in losses.filter("round = 130").collect()}
    assert got["diff_only"] == pytest.approx(want, abs=1e-8) and got["state_table"] == pytest.approx(np.mean([(table[a, b] - w) ** 2 for a, b, w in one]))
    gap = resample.paired_gaps(rounds.gaps(losses, [("survivors", "coin_flip"), ("survivors_time", "survivors")]), "round", "gap", ["a", "b"], 200).collect()
    assert {r.a: r.excludes_zero for r in gap}["survivors"] and all(r.n == 180 for r in gap)
