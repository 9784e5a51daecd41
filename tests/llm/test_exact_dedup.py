import hashlib
import random
import re

from matchloom.llm import exact_dedup as x
from matchloom.llm.exact_dedup import exact_dedup, keep_one_of_each

SCHEMA = "doc_id long, text string, keep_id string, salt int"


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t, *_ in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["a b", "ab", " a\tb\n", "a\u00a0b", "", None, "   ", "é🎉x", "é 🎉 x", "long " * 20000]
    rows = [(i, rng.choice(texts), "clash", 1) for i in range(300)] + [(None, "ab", "x", 1), (None, "solo", "x", 2), (7, "a b", "x", 3), (7, "a b", "x", 3)]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_kept_rows_have_all_columns(spark):
    df = spark.createDataFrame([(1, "a b", "k", 0), (2, "ab", "k", 0), (None, "n", "k", 0)], SCHEMA)
    out = keep_one_of_each(df)
    assert out.columns == df.columns and sorted((r.doc_id for r in out.collect()), key=str) == [1, None]
    assert exact_dedup(df.filter("false")).count() == 0


def test_one_row_of_each_group_stays(spark):
    # a winning null id keeps no other row without an id; a row that shares a winner's id is judged by its own text
    rows = [(None, "a"), (None, "a"), (None, "b"), (1, "b"), (5, "z"), (5, "b"), (7, "q"), (7, "q "), (8, None), (9, "  ")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, keep_id string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in x.keep_one_of_each(df).collect())
    assert got == sorted([(True, 0, "a"), (False, 1, "b"), (False, 5, "z"), (False, 7, "q "), (False, 9, "  ")])
    assert x.keep_one_of_each(df).columns == df.columns
    assert x.keep_one_of_each(df.filter("false")).count() == 0


def test_very_long_texts_are_compared_whole(spark):
    long = "word " * 400_000
    df = spark.createDataFrame([(1, long + "a"), (2, long + "b"), (3, long + " b")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in x.exact_dedup(df).collect()} == {(1, 1, True), (2, 3, False), (3, 3, True)}
