import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from matchloom.llm import toxicity as t


def corpus(spark, n=1500):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ba", "ne", "ti", "lo", "ru"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        sentences = [[word() for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 12))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            rng.choice(sentences)[0:0] = [rng.choice(["scoundrel", "villain,", "VILLAIN"])]
        docs.append((i, ". ".join(" ".join(s) for s in sentences) + ".", "x"))
        if i % 4 != 3:
            labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy_and_location(spark):
    docs, labels, truth = corpus(spark)
    rows = t.toxicity(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    judged = [r for r in held if r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in judged) / len(judged) > 0.98
    for r in rows:
        spans = list(zip(r.offending[::2], r.offending[1::2]))
        assert (r.predicted == 1) == bool(spans)
        assert all("villain" in texts[r.doc_id][a:b].lower() or "scoundrel" in texts[r.doc_id][a:b] for a, b in spans)


def test_held_out_labels_are_never_used(spark):
    docs, labels, _ = corpus(spark, 400)
    turned = labels.withColumn("toxic", F.when(t.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda ls: sorted((r.doc_id, r.score) for r in t.toxicity(docs, ls).collect())
    assert score(labels) == score(turned)


def test_odd_inputs(spark):
    docs, labels, _ = corpus(spark, 300)
    odd = spark.createDataFrame([(None, "villain.", "x"), (900, None, "x"), (901, "", "x"), (901, "", "x"), (902, "ne ti. " * 30000, "x")], "doc_id long, text string, score string")
    got = t.toxicity(docs.unionByName(odd), labels).filter("doc_id is null or doc_id >= 900").collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got if r.doc_id in (900, 901, 902)] == [0] * 4
    none = t.toxicity(docs, labels.filter("false"))
    assert none.select("score").distinct().count() == 1
    assert t.toxicity(docs.filter("false"), labels).count() == 0
    assert t.reject_toxic(docs, labels).columns == docs.columns


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 30).astype(float)
    doc = np.sort(rng.integers(0, 30, 50))
    sen, fea = np.repeat(np.arange(50), 2), rng.integers(0, 6, 100)
    theta = rng.normal(size=8) * 0.5
    _, gradient = t.likelihood(theta, doc, sen, fea, y)
    for i in range(8):
        step = np.zeros(8)
        step[i] = 1e-6
        rise = (t.likelihood(theta + step, doc, sen, fea, y)[0] - t.likelihood(theta - step, doc, sen, fea, y)[0]) / 2e-6
        assert abs(rise - gradient[i]) < 1e-6


def test_scores_by_the_formula(spark):
    # every sentence of the whole text by hand, over random texts, very long ones and empty ones
    rng = random.Random(12)
    model = t.NoisyOrModel({"bad": 2.0, "awful": 3.0, "meanie": 1.5}, bias=-1.0, leak=0.02, shift=0.3)
    words = ["good", "bad", "Awful!", "meanie.", "day", "sun,", "rain.", "bad?", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in [0, 1, 5, 30, 400] * 8] + [None, "good " * 200_000 + "awful."]

    def by_hand(text):
        clean = 1 - 0.02
        for sentence in re.findall(r"[^.!?\n]+[.!?\n]*", (text or "").lower()):
            hits = {w.strip(".,!?") for w in sentence.split()} & set(model.weights)
            if hits:
                clean *= 1 - 1 / (1 + math.exp(-(-1.0 + sum(model.weights[h] for h in hits))))
        p = min(max(1 - clean, 1e-9), 1 - 1e-9)
        return 1 / (1 + math.exp(-(math.log(p / (1 - p)) + 0.3)))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.found.score for r in df.select("doc_id", t.scored(df["text"], model).alias("found")).collect()}
    assert all(abs(got[i] - by_hand(x)) < 1e-9 for i, x in enumerate(texts))


def test_a_very_long_text_does_not_end_the_sample(spark, monkeypatch):
    from matchloom.llm import toxicity as module

    monkeypatch.setattr(module, "SAMPLE_CHARS", 20_000)
    rng = np.random.default_rng(1)
    filler = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, n))
    rows = [(i, f"{filler(8)} {'vile scum' if i % 2 else 'kind words'} {filler(8)}.") for i in range(200)]
    rows += [(1000 + i, "vile scum " * 4000) for i in range(200)]  # each beyond the bound
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("vile" in text)) for i, text in rows], "doc_id long, toxic int")
    model = module.fit_toxicity(docs, labels)
    assert "vile" in model.weights and model.score([s for _, _, s in model.sentences("you vile scum.")]) > 0.5
