import math

import numpy as np
import pytest

from matchloom.llm import vector_codes
from matchloom.llm.vector_codes import Annuli, coded, codebooks_digest, decoded, fit_codebooks, summed_by

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, row int, salt int"


def brute(rows, parts, entries, rounds):
    """Codes, errors and codebooks by plain loops; rows: (id, components)."""
    kept = [(i, [math.floor(256.0 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    step = max(1, -(-max((len(v) for _, v in kept), default=0) // parts))
    kept = [(i, v + [0] * (parts * step - len(v))) for i, v in kept]
    cut = lambda v: [v[p * step : (p + 1) * step] for p in range(parts)]
    ids = sorted({i for i, _ in kept if i is not None})[:entries]
    books = [[cut(min(v for j, v in kept if j == i))[p] for i in ids] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    name = lambda: [[min((gap(part, e), k) for k, e in enumerate(books[p])) for p, part in enumerate(cut(v))] for _, v in kept]
    for _ in range(rounds if ids else 0):
        named = name()
        for p in range(parts):
            for e in range(len(ids)):
                own = [cut(v)[p] for (_, v), names in zip(kept, named) if names[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = [(i, bytes(k for _, k in names), sum(d for d, _ in names)) for (i, _), names in zip(kept, name())] if ids else []
    return codes, books


@pytest.mark.parametrize("kind", ["normal", "ties", "norms", "one"])
def test_annulus_finds_the_nearest(kind):
    rng = np.random.default_rng(len(kind))
    entries = rng.integers(-3, 4, (40, 3)) if kind == "ties" else rng.integers(-900, 900, (1 if kind == "one" else 64, 3))
    parts = rng.integers(-3, 4, (500, 3)) if kind == "ties" else rng.integers(-1000, 1000, (500, 3))
    if kind == "norms":
        entries = entries * rng.integers(1, 4000, (64, 1))
    index, distance, compared = Annuli(entries).nearest(parts)
    every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    if kind == "norms":
        assert compared < 0.5 * every.size


def test_against_plain_loops(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i) * 3, [float(x) for x in rng.normal(size=10)]) for i in range(60)]
    rows += [(0, [0.5] * 10), (None, [1.0] * 10), (None, [0.25] * 10), (300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")] * 10), (304, []), (305, [1.0, -2.0])]
    rows += [rows[5], rows[6], (7, [1.0] * 10), (8, [1.0] * 10), (9, [1.0] * 10)]
    df = spark.createDataFrame([(*r, None if k % 4 == 0 else k % 3, "clash", 1, 2, 3) for k, r in enumerate(rows)], SCHEMA)
    books = fit_codebooks(df, parts=4, entries=8, rounds=2)
    codes, wanted = brute(rows, 4, 8, 2)
    assert books.tolist() == wanted
    got = coded(df, books, keep=("label",))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, bytes(r.code), r.error) for r in got.collect()), key=key) == sorted(codes, key=key)
    back = {r.vec_id: r.vector for r in decoded(got, books).collect() if r.vec_id is not None}
    code = next(bytes(r.code) for r in got.collect() if r.vec_id == 6)
    assert back[6] == [(x + 0.5) / 256 for p in range(4) for x in wanted[p][code[p]]]
    summed = summed_by(got.select("vec_id", "error", "row.label"), "label", "error", "s").collect()
    sums = {}
    for r in summed:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert len(summed) == len(codes) and all(r.s == sums[r.label] for r in summed)


def test_empty_tables_and_few_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    books = fit_codebooks(empty)
    assert books.shape == (16, 0, 1) and coded(empty, books).collect() == [] and codebooks_digest(books)
    blank = spark.createDataFrame([(1, [], 1, "", 1, 1, 1), (2, [], 1, "", 1, 1, 1)], SCHEMA)
    assert [(bytes(r.code), r.error) for r in coded(blank, fit_codebooks(blank)).collect()] == [(bytes(16), 0)] * 2


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="smaller factor"):
        fit_codebooks(df)


def test_query_on_hot_labels(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=64)], 7 if i % 3 else None) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op13_vector_codes(spark, str(tmp_path)).collect()
    codes, books = brute([r[:2] for r in rows], 16, 64, 2)
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted((i, c.hex(), e) for i, c, e in codes)
    assert len({(r.vec_id % 3 == 0, r.label_error) for r in got}) == 2 and {r.codebooks_sha256 for r in got} == {codebooks_digest(np.array(books))}
