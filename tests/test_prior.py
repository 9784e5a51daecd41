import numpy as np
import pytest

from matchloom.operators import prior


def test_walk_forward_ridge_and_blend(spark):
    rng = np.random.default_rng(1)
    true = np.array([0.8, -0.5, 0.0])
    rows = []
    for season in range(4):
        for p in range(60):
            x = rng.normal(size=3)
            se = float(rng.uniform(0.2, 0.6))
            rows.append((season, p, *map(float, x), float(0.3 + x @ true + rng.normal(0, 0.3) + rng.normal(0, se)), se, 1))
    df = spark.createDataFrame(rows, "season int, player int, x0 double, x1 double, x2 double, y double, se double, one int")
    given, fitted = prior.weighted(df, ["one"])
    tau2 = fitted.first().tau2
    assert 0.3 < tau2 < 2.0
    found, folds = prior.walk_forward(given, 3)
    assert {r.season for r in folds.collect()} == {1, 2, 3} and found.count() == 180
    past = [r for r in rows if r[0] < 2]
    x, y, w = np.array([r[2:5] for r in past]), np.array([r[5] for r in past]), np.array([1 / (r[6] ** 2 + tau2) for r in past])
    best = None
    for penalty in prior.PENALTIES:
        mean, middle = w @ x / w.sum(), w @ y / w.sum()
        gram = (x - mean).T @ (w[:, None] * (x - mean))
        beta = np.linalg.solve(gram + penalty * np.eye(3), (x - mean).T @ (w * (y - middle)))
        df_ = 1 + np.trace(np.linalg.solve(gram + penalty * np.eye(3), gram))
        score = (w * (y - middle - (x - mean) @ beta) ** 2).sum() / w.sum() / (1 - df_ / len(y)) ** 2
        if best is None or score < best[0]:
            best = (score, penalty, middle - mean @ beta, beta)
    fold = {r.season: r for r in folds.collect()}[2]
    assert (fold.n, fold.penalty) == (120, best[1])
    mixed = {(r.season, r.player): r for r in prior.blended(found).collect()}
    one, given_ = mixed[2, 7], next(r for r in rows if r[:2] == (2, 7))
    assert one.prior == pytest.approx(best[2] + np.array(given_[2:5]) @ best[3]) and one.prior_se > 0
    error = np.var([r.y - r.prior for r in mixed.values()], ddof=1)
    share = (1 / error) / (1 / error + 1 / one.se**2)
    assert one.prior_share == pytest.approx(share) and one.skill == pytest.approx(share * one.prior + (1 - share) * one.y) and one.skill_se == pytest.approx((1 / error + 1 / one.se**2) ** -0.5)
    assert np.corrcoef([r.prior for r in mixed.values()], [r.y for r in mixed.values()])[0, 1] > 0.7


def test_rows_with_one_of_the_two(spark):
    df = spark.createDataFrame([(1.0, 0.5, None, None), (None, None, 2.0, 0.25), (None, None, None, None)], "prior double, prior_se double, y double, se double")
    assert [(r.skill, r.skill_se) for r in prior.blended(df, 0.25).collect()] == [(1.0, 0.5), (2.0, 0.25), (None, None)]
