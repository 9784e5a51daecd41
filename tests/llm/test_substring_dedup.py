import hashlib
import random

import pytest
from pyspark.sql import functions as F

from matchloom.llm import substring_dedup as s
from matchloom.llm.substring_dedup import strip_repeats

SCHEMA = "doc_id long, text string, kept_sha256 string"


def brute(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        if i is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 30))
    passages = [[word() for _ in range(rng.randint(50, 90))] for _ in range(4)] + [["x", "y"] * 60]
    rows = []
    for i in range(90):
        words = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            words[at:at] = p[a : a + rng.randint(40, 90)]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows + [(200, None), (201, ""), (202, " \x0b\n"), (3, rows[3][1]), (None, rows[4][1]), (203, "é ü " * 80), (204, "é ü " * 80)]


@pytest.mark.parametrize("most", [1000, 2])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(s, "SHARD_PASSAGES", most)
    rows = corpus(most)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in s.substring_dedup(df).collect()), key=repr)
    assert got == brute(rows, 50)
    assert sum(r[2] for r in got) > 500


def test_stripped_texts_have_the_kept_words_and_all_columns(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = s.strip_repeats(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in out.collect()), key=repr)
    assert got == sorted(((i, h) for i, _, _, h in brute(rows, 50)), key=repr)
    untouched = {i: t for i, t in rows if i in (200, 201, 202)}
    assert {r.doc_id: r.text for r in out.filter("doc_id between 200 and 202").collect()} == untouched


def test_empty_table(spark):
    assert s.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_repeated_ids_and_a_passage_in_a_third_of_all_rows(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 3000))
    everywhere = " ".join(word() for _ in range(55))
    rows = [(i, " ".join(word() for _ in range(60)) + (" " + everywhere if i % 3 == 0 else "")) for i in range(120)]
    long = [word() for _ in range(6000)]
    rows += [(300, " ".join(long)), (301, " ".join(long[2000:4000] + [word()] + long[:500])), (302, "z " * 5000)]
    rows += [(303, " ".join(long[100:170])), (303, " ".join(long[3000:3100] + [word() for _ in range(70)])), (303, " ".join(long[100:170]))]
    monkeypatch.setattr(s, "BYTES_AT_A_TIME", 20_000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in s.substring_dedup(df).collect()), key=repr)
    assert got == brute(rows, 50)


def test_automaton_tells_the_smallest_document_of_each_window():
    a = s.SuffixAutomaton()
    a.add([1, 2, 3, 4, 5], 7)
    a.add([9, 2, 3, 4, 8], 9)
    a.settle()
    assert list(a.matches([9, 2, 3, 4, 8], 3)) == [(0, 9), (1, 7), (2, 9)]
    assert s.stretches(a.matches([1, 2, 3, 4, 5], 3), 7) == []
    assert s.stretches(iter([(1, 4), (2, 4), (3, 5), (7, 4)]), 9) == [{"start": 1, "count": 2, "first": 4}, {"start": 3, "count": 1, "first": 5}, {"start": 7, "count": 1, "first": 4}]


def test_stripping_keeps_columns_that_clash(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "a " + passage, 3, 4, 5), (2, "b " + passage, 6, 7, 8)], "doc_id long, text string, __id int, __mark int, windows int")
    got = {r.doc_id: r for r in strip_repeats(docs).collect()}
    assert (got[1].text, got[1]["__id"], got[1].windows) == ("a " + passage, 3, 5) and (got[2].text, got[2]["__mark"]) == ("b", 7)
