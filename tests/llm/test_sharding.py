import random
import zlib

import pytest
from pyspark.sql import functions as F

from matchloom.llm import sharding
from matchloom.llm.sharding import Rooms, best_fit_decreasing, best_fit_shards, least_capacity


def brute(sizes, capacity):
    """Loads of best fit decreasing, group by group."""
    loads = []
    for size in sorted(sizes, reverse=True):
        fitting = [i for i, load in enumerate(loads) if load + size <= capacity]
        if fitting:
            loads[max(fitting, key=lambda i: loads[i])] += size
        else:
            loads.append(size)
    return sorted(loads)


def loads_of(plan):
    loads = {}
    for size, start, stop, per, first in plan:
        for i in range(stop - start):
            loads[first + i // per] = loads.get(first + i // per, 0) + size
    return sorted(loads.values())


def histogram(sizes):
    return sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)


@pytest.mark.parametrize("seed", range(40))
def test_plan_equals_group_by_group_packing(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 12 if seed % 2 else 400) for _ in range(rng.randint(1, 120))]
    capacity = rng.choice([12, 30, 401, 1000])
    plan, shards = best_fit_decreasing(histogram(sizes), capacity)
    assert loads_of(plan) == brute(sizes, capacity) and shards == len(loads_of(plan))
    by_size = {}
    for size, start, stop, _, _ in plan:
        assert start == by_size.get(size, 0)  # each group once
        by_size[size] = stop
    assert by_size == dict(histogram(sizes))


@pytest.mark.parametrize("seed", range(10))
def test_least_capacity(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 50) for _ in range(200)] + ([3000] if seed % 3 == 0 else [])
    capacity = least_capacity(histogram(sizes), 7)
    assert len(brute(sizes, capacity)) <= 7 < len(brute(sizes, capacity - 1))
    rest = [load for load in brute(sizes, capacity) if load <= capacity]
    assert max(rest) - min(rest) <= 8  # a share is several hundred


def test_many_shards_are_runs_of_the_tree():
    plan, shards = best_fit_decreasing([(700, 10**9), (300, 10**9), (1, 5)], 1000)
    assert shards == 10**9 + 1 and plan == [(700, 0, 10**9, 1, 0), (300, 0, 10**9, 1, 0), (1, 0, 5, 1000, 10**9)]


def test_tree_keeps_its_order():
    rng, rooms, plain = random.Random(1), Rooms(), []
    for i in range(3000):
        if rng.random() < 0.6:
            room = rng.randint(1, 500)
            rooms.add(room, i, 1)
            plain.append(room)
        else:
            size = rng.randint(1, 500)
            found, best = rooms.take(size), min((r for r in plain if r >= size), default=None)
            assert (found and found[0]) == best
            if best:
                plain.remove(best)


def test_size_class(spark):
    sizes = [1, 8, 2047, 2048, 2049, 2050, 4095, 4096, 4097, 10**6 + 1, 2**40, 2**40 + 1]
    got = spark.createDataFrame([(s,) for s in sizes], "s long").select(sharding.size_class(F.col("s"))).collect()
    for s, (c,) in zip(sizes, got):
        assert s <= c < s * 1.001 and (c == s or s > 2048) and len(bin(c).rstrip("0")) - 2 <= 11


def check(rows, got, shards):
    """Rows are whole, slots gapless, groups undivided; returns the shards' sizes."""
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots, of_text, loads = {}, {}, {}
    texts = {zlib.crc32((t or "").encode()): t or "" for _, t in rows}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        of_text.setdefault(texts[r.text_crc32], set()).add(r.shard)
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of_text.values())
    assert set(loads) <= set(range(shards))
    return loads


def test_edge_rows_in_even_shards(spark):
    rng = random.Random(5)
    rows = [(i, "w" * rng.randint(0, 900)) for i in range(600)]
    rows += [(1000 + i, "hot " * 300) for i in range(300)]  # a group of most bytes
    rows += [(None, "x"), (None, None), (5, None), (6, ""), (7, "é" * 5), (7, "é" * 5), (8, "long " * 20000)]
    docs = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "doc_id long, text string, size int, shard string, digest int")
    loads = check(rows, best_fit_shards(docs, shards=8).collect(), 8)
    hot = max(loads.values())
    assert hot == 300 * 1208 and len(loads) == 8
    rest = sorted(loads.values())[:-2]  # the very long text has a shard of its own
    assert max(rest) - min(rest) < 0.003 * max(rest)


def test_fixed_capacity_and_kept_columns(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, "w" * rng.randint(0, 3000)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = best_fit_shards(docs, capacity=10_000, keep=("text",))
    got = placed.collect()
    loads = check(rows, got, 300)
    assert max(loads.values()) <= 10_000 and sorted(loads) == list(range(len(loads)))
    least = -(-sum(loads.values()) // 10_000)
    assert least <= len(loads) <= least + 1
    sharding.write_shards(placed, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((r.doc_id, r.row.text, r.shard) for r in back.collect()) == sorted((r.doc_id, dict(rows)[r.doc_id], r.shard) for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert best_fit_shards(docs, shards=24).collect() == [] and best_fit_shards(docs, capacity=10).collect() == []
    with pytest.raises(ValueError):
        best_fit_shards(docs)
