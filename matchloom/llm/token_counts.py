"""Token counts under a unigram vocabulary, without producing the tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.piece_model import PieceModel, piece_model
from matchloom.session import table

#: Parts whose counts a worker remembers in each of two generations.
REMEMBERED_PARTS = 400_000
#: What an unknown character scores below the vocabulary's lowest score.
UNKNOWN_PENALTY = 10.0


class PartCounts(dict):
    """Numbers of tokens of the parts of a text, by the best segmentation of each part.

    No piece spans two parts, so the best segmentation of a text is that of its parts. Whole-number scores, as merge-type
    vocabularies have, add up exactly, so ties fall alike in a part and in the whole text; with any other scores the whole
    text is one part, and sums are rounded in the tokenizer's own order.
    """

    def __init__(self, model: PieceModel):
        import ahocorasick

        self.model, self.older = model, {}
        self._matches = ahocorasick.Automaton()
        for piece, score in zip(model.pieces, model.scores):
            self._matches.add_word(piece, (len(piece), score))
        self._matches.make_automaton()
        self._single = {p for p in model.pieces if len(p) == 1}
        self._unknown = min(model.scores) - UNKNOWN_PENALTY
        self._parts = model.parts if all(float(score).is_integer() for score in model.scores) else re.compile("(?s).+")

    def __missing__(self, part: str) -> int:
        if len(self) >= REMEMBERED_PARTS:
            self.older = dict(self)
            self.clear()
        count = self.older.get(part)
        if count is None:
            count = self._count(part)
        if len(part) < 64:
            self[part] = count
        return count

    def _count(self, part: str) -> int:
        """Viterbi that carries only the best score and its number of pieces.

        Of equal scores the one whose last piece starts first wins. A character that is no piece by itself may also
        stand alone, as unknown, and then counts its UTF-8 bytes.
        """
        n, single = len(part), self._single
        score: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        settled = n if single.issuperset(part) else 0  # before this place, unknown characters have had their choice
        for end, (length, value) in self._matches.iter(part):  # by end; of one end the longest first
            while settled < end:
                self._stand_alone(part[settled], settled, score, count)
                settled += 1
            total = score[end + 1 - length] + value
            if score[end + 1] is None or total > score[end + 1]:
                score[end + 1], count[end + 1] = total, count[end + 1 - length] + 1
        for i in range(settled, n):
            self._stand_alone(part[i], i, score, count)
        return count[n]

    def _stand_alone(self, char: str, at: int, score: list[float | None], count: list[int]) -> None:
        if char not in self._single and (score[at + 1] is None or score[at] + self._unknown > score[at + 1]):
            score[at + 1], count[at + 1] = score[at] + self._unknown, count[at] + len(char.encode())

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, self._parts.findall(self.model.normalised(text))))


@lru_cache(maxsize=2)
def part_counts(path: str) -> PartCounts:
    return PartCounts(piece_model(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_chars.

    n_tokens is what a unigram tokenizer with the vocabulary's pieces and scores and with byte fallback gives for the
    whole text, without begin and end ids. Null and empty texts have none. Repeated rows each return their row.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = part_counts(path)
        for batch in batches:
            texts = [text.as_py() or "" for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([counts.of(t) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())],
                ["doc_id", "n_tokens", "n_chars"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(counted, "doc_id long, n_tokens long, n_chars long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
