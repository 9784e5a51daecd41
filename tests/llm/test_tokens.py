import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, models, normalizers

from matchloom.llm import piece_codec, token_counts
from matchloom.llm.piece_model import piece_model

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    alphabet = "ab ▁.,\n\té你🎉<s>/0xA \u00a0"
    return [None, "", " ", "  two  spaces ", "</s><s> <0x0A>", "\x00\x01", "a" * 3000, "\n\n\n", "ﬁ ﾊﾝ e\u0301", "the cat. The, dog!? (x) 3.14 ..."] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1), (3, "x", 1)], "doc_id long, text string, n_tokens int")


def test_codec_agrees_with_the_library(docs, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = piece_codec.encode_and_decode(docs, PATH, check_every=1, with_output=True).collect()
    by = {r.doc_id: r for r in got[: len(texts)]}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        rows = [r for r in got if r.doc_id == i and r.ids_sha256 == want]
        assert rows and rows[0].n_tokens == len(ids) and rows[0].decoded == library.decode(ids), text
    assert len(got) == len(texts) + 2 and by


def test_list_and_heap_agendas_merge_alike(texts):
    ids = piece_codec.PartIds(piece_model(PATH))
    for text in texts:
        for part in ids.model.parts.findall(ids.model.normalised(text or "")):
            assert ids._merged_list(part) == ids._merged_heap(part)


def test_generations_of_remembered_parts(monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED_PARTS", 3)
    ids = piece_codec.PartIds(piece_model(PATH))
    first = [ids[p] for p in ("▁a", "▁b", "▁c", "▁d", "▁a")]
    assert first[0] == first[4] and len(ids) <= 3


def test_counts_agree_with_a_unigram_tokenizer(docs, texts):
    model = piece_model(PATH)
    tokenizer = Tokenizer(models.Unigram(vocab=list(zip(model.pieces, model.scores)), unk_id=0, byte_fallback=True))
    tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    want = sorted([(i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) if t else 0) for i, t in enumerate(texts)] + [(-1, len(tokenizer.encode("x").ids)), (3, len(tokenizer.encode("x").ids))])
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, PATH).collect())
    assert got == want


def test_empty_tables(docs):
    assert piece_codec.encode_and_decode(docs.filter("false"), PATH).count() == 0
    assert token_counts.token_counts(docs.filter("false"), PATH).count() == 0


def test_counts_with_fractional_scores():
    rng = random.Random(11)
    pieces = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), *{"".join(rng.choice("▁abc") for _ in range(rng.randint(1, 4))) for _ in range(60)}, "▁", "a", "b"]
    pieces = list(dict.fromkeys(pieces))
    scores = [-round(rng.uniform(1, 9), 3) for _ in pieces]

    class Model:
        normalised = staticmethod(lambda text: "▁" + text.replace(" ", "▁") if text else "")
        parts = None

    Model.pieces, Model.scores = pieces, scores
    tokenizer = Tokenizer(models.Unigram(vocab=list(zip(pieces, scores)), unk_id=0, byte_fallback=True))
    tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    counts = token_counts.PartCounts(Model)
    for _ in range(300):
        text = "".join(rng.choice("abc  é") for _ in range(rng.randint(1, 120)))
        assert counts.of(text) == len(tokenizer.encode(text).ids), text
