import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchloom.llm import packing

TEXTS = ["", None, " ", "  a  b ", "a \n b\n\n  c", "x" * 5000, "<|endoftext|> a<|endoftext|>b", "\x00\x01 é́ ﬁ 你好 🎉🎉  …\u3000a\u00a0 b", "a\x1c b \x85c", "\t\tif x:\n    y = 1\n", "word " * 9000]


def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.fixture(scope="module")
def packed(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice(["the", "of", "ünd", "x1,"]) for _ in range(rng.randint(0, 3000)))) for i in range(120)] + [(None, "no id"), (0, "again")]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, piece string, offset int")
    return rows, packing.pack_documents(df, capacity=512).collect()


def test_pieces_hold_the_ids(packed):
    rows, got = packed
    ids_of, want = reference(), []
    for doc_id, text in rows:
        ids = ids_of(text)
        cuts = [0, *range(len(ids) % 512 or 512, len(ids), 512), len(ids)]
        cuts = sorted(set(cuts))
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)


def test_sequences_are_gapless_and_few(packed):
    _, got = packed
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    least = -(-sum(r.length for r in got) // 512)
    assert len(sequences) <= 1.02 * least + 2


def test_program_prices_and_patterns():
    config = packing.best_configuration(np.array([1.0, 2.5, 0.1]), np.array([2, 4, 1]), 9)
    assert config == {1: 2, 2: 1}
    histogram = {60: 1000, 40: 1000, 30: 500, 10: 700}
    patterns = packing.pack_histogram(histogram, 100, 10)
    back = {}
    for pattern, times in patterns:
        assert sum(k * n for k, n in pattern.items()) <= 100
        for k, n in pattern.items():
            back[k] = back.get(k, 0) + n * times
    assert back == histogram and sum(t for _, t in patterns) <= 1230
    assert packing.pack_histogram({}) == []


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_program_packs_what_best_fit_loses():
    # best fit decreasing needs 110 sequences, 90 are enough
    histogram = {1032: 60, 528: 60, 520: 60, 496: 120}
    left = np.zeros(2049, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    alone, _ = packing.pack_by_program(left, 2048, 8, 2048, False, 0.0, None)
    _, by_program = packing.pack_by_program(left, 2048, 8, 2048, False, 1.0, packing.configured(left, 2048, 8, packing.ROUNDS))
    patterns = packing.pack_histogram(histogram)
    assert sum(n for _, n in alone) == 110 and sum(n for _, n in patterns) <= 91 and by_program >= 85
    rng = np.random.default_rng(4)
    lengths, counts = np.unique(rng.integers(400, 1100, 3000), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    left[:] = 0
    left[lengths] = counts
    alone, _ = packing.pack_by_program(left, 2048, 8, 2048, False, 0.0, None)
    assert sum(n for _, n in packing.pack_histogram(histogram)) < sum(n for _, n in alone)
