import math
from fractions import Fraction

import numpy as np
import pytest

from matchloom.llm import whitening
from matchloom.llm.whitening import op12_whitening, whitened

SCHEMA = "vec_id long, embedding array<float>, x int, n string, whitened double"


def brute(rows, components):
    """By id: deviation and, with signs fixed, whitened values; and the shares of variance. Exact sums, dense eigenvectors."""
    kept = [(i, tuple(math.floor(64.0 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(x) for _, x in kept)
    kept = [(i, x + (1_000_000,) * (width - len(x))) for i, x in kept]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = [k for k in np.argsort(-values) if values[k] > 1e-12 * values.max()][:components]
    deviations = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in kept]
    projected = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for _, x in kept]) @ axes[:, order] / np.sqrt(values[order])
    total = sum(d for _, d in ((None, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for x in fit)) / n**3
    return n, deviations, projected, values[order] / total


def test_against_exact_sums_and_dense_eigenvectors(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(20, 20))
    rows = [(int(i), [float(c) for c in rng.normal(size=20) @ mix]) for i in range(300)]
    rows += [(500 + i, [0.5] * 20) for i in range(150)] + [rows[3], (None, [0.25] * 20), (600, None), (601, [1.0, None]), (602, [float("inf")] * 20), (603, [float("nan")] * 20), (604, []), (605, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "clash", 2.0) for r in rows], SCHEMA)
    n, deviations, projected, shares = brute(rows, 16)
    got, fitted = whitened(df)
    got = got.collect()
    assert fitted.n == n and fitted.identity_error < 1e-9 and np.allclose(fitted.eigenvalues / fitted.total, shares, rtol=1e-9)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.vec_id, r.deviation) for r in got), key=key) == sorted(deviations, key=key)
    order = sorted(range(len(deviations)), key=lambda k: key(deviations[k]))
    ours, theirs = np.array([r.whitened for r in sorted(got, key=lambda r: key((r.vec_id,)))]), projected[order]
    signs = np.sign((ours * theirs).sum(axis=0))
    assert ours.shape[1] == 16 and np.abs(ours - theirs * signs).max() < 1e-7
    assert np.allclose(fitted.axes @ fitted.axes.T, np.eye(16), atol=1e-12)


def test_fewer_components_where_vectors_span_less(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(a), float(2 * a), float(b), 0.0]) for i, (a, b) in enumerate(rng.integers(-50, 50, (100, 2)))]
    got, fitted = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert len(fitted.eigenvalues) == 2 and fitted.identity_error < 1e-9 and all(len(r.whitened) == 2 for r in got.collect())
    assert abs(sum(fitted.eigenvalues) / fitted.total - 1) < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, [])], [(1, None)]])
def test_tables_without_two_vectors(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_whitening(spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_64_bits_is_an_error(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [3e9])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="(?i)overflow"):
        whitened(df)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=64)]) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_whitening(spark, str(tmp_path)).collect()
    n, deviations, projected, shares = brute(rows, 16)
    assert len(got) == 16 * 400 and {r.n for r in got} == {n} and {(r.vec_id, r.deviation) for r in got} == set(deviations)
    assert np.allclose([r.explained for r in sorted(got, key=lambda r: (r.vec_id, r.component))[:16]], shares)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    ours = np.zeros((400, 16))
    for r in got:
        ours[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.abs(ours) - np.abs(projected)).max() < 1e-7
