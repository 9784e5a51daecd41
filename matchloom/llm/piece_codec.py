"""Encoding and decoding with merge-type sentencepiece vocabularies."""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.piece_model import PieceModel, piece_model
from matchloom.session import table

#: Parts whose ids a worker remembers in each of two generations.
REMEMBERED_PARTS = 400_000
#: Parts of more symbols keep their agenda in a heap, shorter ones in a list.
LIST_SYMBOLS = 48


class PartIds(dict):
    """Token ids, as little-endian 32-bit bytes, of the parts of a text."""

    def __init__(self, model: PieceModel):
        self.model, self.older, self._id_of = model, {}, model.id_of
        self._pack = [struct.Struct(f"<{n}I") for n in range(32)]
        self._score = {p: model.scores[i] for p, i in model.id_of.items() if len(p) > 1}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED_PARTS:
            self.older = dict(self)
            self.clear()
        out = self.older.get(part)
        if out is None:
            symbols = self._merged_list(part) if len(part) <= LIST_SYMBOLS else self._merged_heap(part)
            ids = [self._id_of.get(s) for s in symbols]
            if None in ids:
                ids = [i for s, known in zip(symbols, ids) for i in ([known] if known is not None else [self.model.byte_ids[b] for b in s.encode()])]
            out = self._pack[len(ids)].pack(*ids) if len(ids) < len(self._pack) else struct.pack(f"<{len(ids)}I", *ids)
        if len(part) < 64:
            self[part] = out
        return out

    def _merged_list(self, part: str) -> list[str]:
        """Merges the adjacent pair of the highest score, the leftmost of equals, until no pair is a piece."""
        score, none = self._score, -np.inf
        symbols = list(part)
        agenda = [score.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := max(agenda)) != none:
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = score.get(symbols[i - 1] + symbols[i], none)
            if i < len(agenda):
                agenda[i] = score.get(symbols[i] + symbols[i + 1], none)
        return symbols

    def _merged_heap(self, part: str) -> list[str]:
        """The same merges, with the agenda in a heap by score and place, and neighbours in links."""
        score = self._score
        symbols: list[str] = list(part)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (s := score.get(symbols[left] + symbols[right])) is not None:
                heapq.heappush(agenda, (-s, left, right, symbols[left] + symbols[right]))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            if after[left] != right or symbols[left] + symbols[right] != joined or not symbols[left] or not symbols[right]:
                continue
            symbols[left], symbols[right] = joined, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            propose(before[left], left)
            propose(left, after[left])
        return [s for s in symbols if s]

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.model.parts.findall(self.model.normalised(text))))


@lru_cache(maxsize=2)
def part_ids(path: str) -> PartIds:
    return PartIds(piece_model(path))


def encode_and_decode(docs: DataFrame, path: str, check_every: int = 1, id_col: str = "doc_id", text_col: str = "text", with_output: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_output also ids and decoded.

    Ids carry the begin and end ids. In every Arrow batch the first row and then every check_every-th (1, by default: all) is
    also encoded by the sentencepiece library, and a difference raises: with 1, no wrong ids are returned quietly. The
    decoded text is the library's decode of the ids. Null text: empty, which has the begin and end ids only. Very long texts are
    encoded whole. Repeated rows each return their row; an empty table returns none. Other columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_output

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = part_ids(path)
        model = ids_of.model
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (model.begin_id, model.end_id))
        hexed = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            counts, ids_hex, text_hex, all_ids, texts = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                data = begin + ids_of.of(text) + end
                ids = np.frombuffer(data, dtype="<u4").tolist()
                if row % check_every == 0 and model.library.encode(text, add_bos=True, add_eos=True) != ids:
                    raise ValueError(f"ids differ from the library's for row {batch.column(0)[row]}")
                decoded = model.library.decode(ids)
                counts.append(len(ids))
                ids_hex.append(hexed(data))
                text_hex.append(hexed(decoded.encode()))
                if with_output:
                    all_ids.append(ids)
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_output:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
