"""The pipeline against its stages' brute-force rules, on planted documents."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from matchloom.llm import near_dedup, toxicity


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ba", "ne", "ti", "lo", "ru", "ka"]) for _ in range(rng.randint(2, 5)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    docs = {i: text(rng.randint(60, 120)) for i in range(200)}
    for i in range(0, 40):
        docs[i] = docs[i] + " villain scoundrel."
    docs[300] = docs[100].replace(" ", "  ", 1)  # an exact copy with more characters
    docs[301] = docs[101].replace(" ", " changed ", 1)  # a near copy
    passage = text(70)
    docs[302], docs[303] = text(150) + " " + passage, text(150) + " " + passage + " " + text(30)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(400, None, None, None, None), (401, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "substring dedup", "packing"]

    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    clean = stage["toxicity"](spark, df, str(tmp_path))
    assert ids(clean) == ids(df) - set(range(40)) and clean.columns == df.columns
    exact = stage["exact dedup"](spark, df, str(tmp_path))
    assert ids(df) - ids(exact) == {100, 401} or ids(df) - ids(exact) == {100, 400}
    near = stage["near dedup"](spark, df, str(tmp_path))
    assert ids(df) - ids(near) == {300, 301, 401} and near.columns == df.columns
    cut = {r.doc_id: r.text for r in stage["substring dedup"](spark, df, str(tmp_path)).collect()}
    assert passage not in cut[303] and passage in cut[302] and cut[5] == docs[5] and cut[400] is None

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {i for i in ids(df) if i >= 40} - {100, 301, 401}
    assert {r.doc_id: r.piece for r in out}[302] == 0


def by_hand(rows, labels, model):
    """The texts that the first four stages leave, by each stage's rule on its own input."""
    rejected = {i for i, t in rows if model.score([s for *_, s in model.sentences(t or "")]) >= 0.5}
    rows = [(i, t) for i, t in rows if i not in rejected]
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i, t))
    rows = sorted((i, t) for _, i, t in map(min, groups.values()))
    words = {i: (t or "").encode().split() for i, t in rows}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in words:
        for j in words:
            if i < j and near_dedup.similar(words[i], words[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    rows = [(i, t) for i, t in rows if root(i) == i]
    first = {}
    for i, _ in rows:
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    out = {}
    for i, t in rows:
        gone = set()
        for k in range(len(words[i]) - 49):
            if first[tuple(words[i][k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        if gone:
            spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            stretches = []
            for k, span in enumerate(spans):
                if k not in gone:
                    stretches += [[span[0], span[1]]] if k - 1 in gone or k == 0 else []
                    stretches[-1][1] = span[1]
            t = " ".join(t[a:b] for a, b in stretches)
        out[i] = t or ""
    return out


def test_run_against_the_rules_by_hand(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ba", "ne", "ti", "lo", "ru", "ka"]) for _ in range(rng.randint(2, 5)))
    passage = [[word() for _ in range(rng.randint(55, 80))] for _ in range(3)]
    docs = []
    for i in range(150):
        text = [word() for _ in range(rng.choice([0, 5, 40, 90, 160]))]
        if rng.random() < 0.3:
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(passage)
        text = rng.choice([" ", "\n"]).join(text)
        if i < 40:
            text += " villain scoundrel."
        elif docs and rng.random() < 0.25:
            text = rng.choice(docs)[1] or ""
            text = text.replace(" ", "  ", 1) if rng.random() < 0.5 else text.replace(" ", " extra ", 1)
        docs.append((i, text))
    docs += [(200, None), (201, ""), (202, "word " * 3000)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), i) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, class_id long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(150)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    want = by_hand(docs, labels, toxicity.fit_toxicity(df, labels))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for i, text in want.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        cuts = sorted({0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)})
        pieces |= {(i, k): (b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
    assert len(want) < 110 and any(len(want[i].split()) < len((t or "").split()) for i, t in docs if i in want)
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 2048) + 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
