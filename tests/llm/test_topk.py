import numpy as np
import pytest

from matchloom.llm import topk


def brute(vectors, queries, k):
    out = []
    for q, wanted in queries:
        scored = []
        for i, v in vectors:
            if i != q:
                n = min(len(v), len(wanted))
                scored.append((-sum(int(a) * int(b) for a, b in zip(v[:n], wanted[:n])), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def floors(v):
    return [int(np.floor(256.0 * float(np.float32(x)))) for x in v]


@pytest.mark.parametrize("kind, block", [("normal", 8192), ("ties", 8192), ("zeros", 8192), ("large", 64), ("ties", 50)])
def test_against_brute_force(spark, monkeypatch, kind, block):
    monkeypatch.setattr(topk, "VECTORS_PER_BLOCK", block)
    rng = np.random.default_rng(len(kind))
    rows = []
    for i in range(400):
        v = rng.normal(size=8) if kind == "normal" else rng.integers(-1, 2, 8) / 2 if kind == "ties" else np.zeros(8) if kind == "zeros" else rng.normal(size=8) * 1e6
        rows.append((i, [float(x) for x in v]))
    rows += [(500, None), (501, [1.0, None]), (550, [float("nan")] * 8), (600, [float("inf")] * 8), (601, []), (602, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()
    usable = [(i, floors(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert sorted(map(tuple, got)) == brute(usable, [u for u in usable if u[0] % 50 == 0], 5)


def test_small_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(*[spark.createDataFrame([], schema)] * 2).count() == 0
    three = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], schema)
    assert sorted(map(tuple, topk.top_k(three, three.filter("vec_id = 0")).collect())) == [(0, 1, 2, 256 * 768), (0, 2, 1, 256 * 512)]


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 20, (4000, 8)).astype(float)
    v[:40, :2] += 5000  # few vectors are large, and in the same dimensions
    lists = topk.SortedLists(np.arange(4000), v)
    query = np.array([3.0, 2.0, 0, 0, 1, 0, 0, 0])
    best, seen = lists.search(-1, query, 5)
    order = np.lexsort((np.arange(4000), -(v @ query)))[:5]
    assert best == [(int(i), int(v[i] @ query)) for i in order] and seen < 400
    _, with_floor = topk.SortedLists(np.arange(3000), v[1000:]).search(-1, query, 5, best[-1][1])
    _, without = topk.SortedLists(np.arange(3000), v[1000:]).search(-1, query, 5)
    assert with_floor < 200 < without


def test_repeated_rows_each_take_a_rank(spark):
    rows = [(0, [1.0]), (7, [9.0]), (7, [9.0]), (7, [8.0]), (3, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id = 0"), 4).collect()))
    assert got == [(0, 1, 7, 256 * 2304), (0, 2, 7, 256 * 2304), (0, 3, 7, 256 * 2048), (0, 4, 3, 256 * 1280)]
    five = spark.createDataFrame([(0, [1.0])] * 2 + [(7, [9.0])] * 5, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(five, five.filter("vec_id = 0")).collect())) == [(0, r, 7, 256 * 2304) for r in range(1, 6)]
