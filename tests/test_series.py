import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import series


def test_admission_ladder(spark):
    maps = [("ok", n, "a" if w else "b", "a", 3, 1) for n, w in enumerate((1, 0, 1, 1), 1)]
    maps += [("undecided", 1, None, "a", 3, 0), ("undecided", 3, "a", "a", 3, 0)]
    maps += [("gap", 1, "a", "a", 3, 0), ("gap", 2, "a", "a", 3, 0), ("gap", 4, "a", "a", 3, 0)]
    maps += [("twice", 1, "a", "a", 2, 0), ("twice", 1, "a", "a", 2, 0), ("null", None, "a", "a", 1, 0)]
    maps += [("score", n, "a", "a", 3, 1) for n in (1, 2, 3)]
    maps += [("short", n, "a", "a", 2, 0) for n in (1, 2)] + [("tied", 1, "a", "a", 1, 1)]
    df = spark.createDataFrame(maps[::-1], "series string, ordinal int, winner string, first string, score1 int, score2 int")
    got = {r.series: (r.reason, r.path) for r in series.admitted(df).collect()}
    assert got["ok"] == (None, [1, 0, 1, 1]) and "tied" not in got
    assert {k: v[0] for k, v in got.items() if k != "ok"} == {"undecided": "undecided_map", "gap": "ordinal_gap", "twice": "ordinal_gap", "null": "ordinal_gap", "score": "score_mismatch", "short": "best_of_3"}


def test_paths_and_their_events(spark):
    paths = series.race_paths(3)
    assert len(paths) == 20 and sorted(map(len, paths)) == [3] * 2 + [4] * 6 + [5] * 12
    df = spark.createDataFrame([(list(p),) for p in paths], "path array<int>")
    for r in df.select("path", *series.race_events(F.col("path")).values()).collect():
        p, won = r.path, int(sum(r.path) == 3)
        assert (r.first_side_won, r.first_map_winner_won, r.sweep, r.decider) == (won, int(p[0] == won), int(len(p) == 3), int(len(p) == 5))
        assert r.reverse_sweep == int(p[:2] == [1 - won] * 2)


def test_even_races_and_latent_quality(spark):
    df = spark.createDataFrame([(1, [0.0] * 5), (2, [1.0, -1.0, 0.5, 0.0, 2.0])], "k int, logits array<double>")
    even = {r.k: r for r in series.race_chances(df, ["k"]).collect()}[1]
    assert (even.first_side_won, even.sweep, even.decider, even.first_map_winner_won, even.reverse_sweep) == pytest.approx((0.5, 0.25, 0.375, 0.6875, 0.0625))
    loose = {r.k: r for r in series.race_chances(df, ["k"], a=0.7, sigma=0.9).collect()}[2]
    nodes, weights = np.polynomial.hermite_e.hermegauss(24)
    want = 0.0
    for u, w in zip(nodes, weights / math.sqrt(2 * math.pi)):
        p = [1 / (1 + math.exp(-(0.7 * x + 0.9 * u))) for x in (1.0, -1.0, 0.5, 0.0, 2.0)]
        want += w * (p[0] * p[1] * p[2] + (1 - p[0]) * (1 - p[1]) * (1 - p[2]))
    assert loose.sweep == pytest.approx(want, abs=1e-12)


def played(rng, n, a, sigma, gamma):
    out = []
    for _ in range(n):
        x, u, won = rng.normal(size=5), sigma * rng.normal(), []
        while len(won) < 5 and won.count(1) < 3 and won.count(0) < 3:
            eta = a * x[len(won)] + u + gamma * (0 if not won else 2 * won[-1] - 1)
            won.append(int(rng.random() < 1 / (1 + math.exp(-eta))))
        out.append(([float(v) for v in x[: len(won)]], won))
    return out


SCHEMA = "strength array<double>, won array<int>"


def test_derivatives(spark):
    df = spark.createDataFrame(played(np.random.default_rng(1), 200, 1.0, 0.5, 0.2), SCHEMA)
    at, eps = np.array([0.8, 0.6, 0.1]), 1e-4
    points = [tuple(at)] + [tuple(at + s * eps * np.eye(3)[i]) for i in range(3) for s in (1, -1)]
    found = series.log_likelihoods(df, points)
    for i in range(3):
        up, down = found[1 + 2 * i], found[2 + 2 * i]
        assert found[0][1][i] == pytest.approx((up[0] - down[0]) / (2 * eps), rel=1e-5, abs=1e-5)
        assert found[0][2][i] == pytest.approx((up[1] - down[1]) / (2 * eps), rel=1e-4, abs=1e-3)


def test_planted_momentum(spark):
    df = spark.createDataFrame(played(np.random.default_rng(5), 6000, 1.2, 0.7, 0.35), SCHEMA)
    got = series.momentum(df)
    assert abs(got["a"] - 1.2) < 0.12 and abs(got["sigma"] - 0.7) < 0.2 and got["low"] < 0.35 < got["high"] and got["low"] > 0.1
    assert got["loglik"] > got["null_loglik"] and got["n"] == 6000
    rows = df.cache()
    for bound in ("low", "high"):
        held = series.fit_momentum(rows, got[bound], (got["a"], got["sigma"], 0.0))
        assert abs(got["loglik"] - held.loglik - series.HALF_CHI2) < 0.05
    none = series.momentum(spark.createDataFrame(played(np.random.default_rng(6), 4000, 1.0, 0.8, 0.0), SCHEMA))
    assert none["low"] < 0 < none["high"]
