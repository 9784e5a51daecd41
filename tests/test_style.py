import numpy as np
import pytest

from matchloom.operators import style


def test_columns_are_dealt_in_parts_and_some_replicates_at_a_time(spark, monkeypatch):
    """The products are those of the columns laid out whole, and no more than MOVED entries are moved at once."""
    monkeypatch.setattr(style, "WIDTH", 16)
    monkeypatch.setattr(style, "MOVED", 2 * 101 * 3)
    rounds, plain = [], style._matrices
    monkeypatch.setattr(style, "_matrices", lambda made, size: rounds.append(1) or plain(made, size))
    rng = np.random.default_rng(11)
    x = rng.normal(size=(97, 3))
    placed = spark.createDataFrame([(p + 1, *map(float, x[p])) for p in range(97)], "place long, x0 double, x1 double, x2 double").repartition(5)
    maps = [(k, i, int(rng.integers(1, 101)), int(rng.integers(0, 101))) for k in range(5) for i in range(3)]
    got = style._dealt_products(placed, 3, maps, 101)
    assert sorted(got) == list(range(5)) and len(rounds) == 3
    for k in range(5):
        laid = np.zeros((101, 3))
        for _, i, a, b in (m for m in maps if m[0] == k):
            laid[(a * np.arange(97) + b) % 101, i] = x[:, i]
        assert got[k] == pytest.approx(laid.T @ laid)


def test_basis_residuals_and_components(spark):
    rng = np.random.default_rng(1)
    n = 240
    rating, hidden = rng.normal(size=n), rng.normal(size=(n, 2))
    x = np.stack([hidden[:, 0] + 0.3 * rng.normal(size=n) + 0.5 * rating, hidden[:, 0] + 0.3 * rng.normal(size=n), -hidden[:, 0] + 0.3 * rng.normal(size=n), hidden[:, 1] + 0.3 * rng.normal(size=n), hidden[:, 1] + 0.3 * rng.normal(size=n), rng.normal(size=n)], axis=1)
    rows = [(i % 3, f"p{i}", f"f{j}", float(x[i, j])) for i in range(n) for j in range(6)]
    rows += [(0, f"p{i}", "rare", 1.0) for i in range(0, n, 3)] + [(0, "lonely", "f0", 1.0)]
    values = spark.createDataFrame(rows, "season int, subject string, feature string, z double")
    whole, names = style.basis(values, spark.createDataFrame([(f"p{i}", float(rating[i])) for i in range(n)], "subject string, rating double"))
    assert names == [f"f{j}" for j in range(6)] and whole.count() == n  # rare is in one season alone
    left, share = style.residuals(whole, 6)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    q = (rating - rating.mean()) / rating.std()
    resid = z - np.outer(q, z.T @ q / n)
    assert share == pytest.approx(1 - resid.var(axis=0).sum() / 6)
    resid = resid / resid.std(axis=0)
    got = {r.subject: r for r in left.collect()}
    assert [got["p7"][f"x{j}"] for j in range(6)] == pytest.approx(list(resid[7]))
    scores, loadings, values_, bound = style.components(left, 6, 40)
    want = np.linalg.eigvalsh(resid.T @ resid / (n - 1))[::-1]
    assert values_ == pytest.approx(want) and len(loadings) == 2 and all(row[np.abs(row).argmax()] > 0 for row in loadings)
    null = np.percentile([np.linalg.eigvalsh(np.cov(np.stack([rng.permutation(resid[:, j]) for j in range(6)], axis=1), rowvar=False))[::-1] for _ in range(200)], 95, axis=0)
    assert bound == pytest.approx(null, rel=0.08)
    one = {r.subject: r for r in scores.collect()}["p7"]
    assert [one.s0, one.s1] == pytest.approx(list(resid[7] @ loadings.T))


def test_groups(spark):
    rng = np.random.default_rng(2)
    middles = np.array([[0, 0], [8, 0], [0, 8]])
    x = np.concatenate([m + rng.normal(size=(60, 2)) for m in middles])
    points = spark.createDataFrame([(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(x)], "subject string, s0 double, s1 double").repartition(4).cache()
    centres, inertia = style.k_means(points, 2, 3, 5)
    near = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert inertia == pytest.approx(near.min(axis=1).sum()) and sorted(np.round(centres / 8).astype(int).tolist()) == [[0, 0], [0, 1], [1, 0]]
    label, d = near.argmin(axis=1), ((x[:, None] - x[None]) ** 2).sum(axis=2)
    widths = []
    for i in range(len(x)):
        own = label == label[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == j].mean() for j in range(3) if j != label[i])
        widths.append((b - a) / max(a, b))
    assert style.silhouette(points, 2, centres) == pytest.approx(np.mean(widths))
    found = {r.k: r for r in style.groups(points, 2, 4, 3).collect()}
    assert found[1].silhouette is None and max((2, 3, 4), key=lambda k: found[k].silhouette) == 3 and found[1].inertia > found[2].inertia > found[3].inertia
    assert style.next_prime(1) == 2 and style.next_prime(90) == 97
