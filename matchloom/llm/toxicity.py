"""Toxicity by multiple-instance learning: document labels train sentence scores, which noisy-or combines."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import table

#: Most labelled documents that a model is fitted on, and their most characters in all, per label; more are left unused.
SAMPLE_PER_LABEL, SAMPLE_CHARS = 4000, 20_000_000
#: Evidence must appear in so many toxic sample documents, and be so many standard errors more frequent there.
LEAST_DOCUMENTS, LEAST_Z, LEAST_LOG_ODDS = 5, 5.0, 2.0
MOST_EVIDENCE = 20_000
#: Word beginnings that count as evidence of their own.
STEMS = (4, 5, 6)

_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…«»“”‘’¿¡"


def features(token: str) -> list[str]:
    """What a token between white space says: its word, and the beginnings of the word."""
    word = token.strip(_EDGE)
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)] if len(word) > 1 else []


@dataclass
class NoisyOrModel:
    """P(document) = 1 - (1 - leak) * prod over its sentences with evidence of (1 - sigmoid(bias + sum of weights))."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    leak: float = 0.01
    shift: float = 0.0  #: log odds of the labels among all labelled rows less those in the sample

    def __post_init__(self) -> None:
        self._known: dict[str, tuple[str, ...]] = {}

    def evidence(self, token: str) -> tuple[str, ...]:
        found = self._known.get(token)
        if found is None:
            if len(self._known) >= 500_000:
                self._known.clear()
            found = self._known[token] = tuple(f for f in features(token) if f in self.weights)
        return found

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and score of each sentence that holds evidence, in text order."""
        lowered = text.lower()
        if not any(map(self.evidence, set(lowered.split()))):
            return []
        same = len(lowered) == len(text)
        out = []
        for m in _SENTENCE.finditer(text):
            found = {f for t in set((lowered[m.start() : m.end()] if same else m[0].lower()).split()) for f in self.evidence(t)}
            if found:
                out.append((m.start(), m.end(), _sigmoid(self.bias + sum(self.weights[f] for f in found))))
        return out

    def score(self, scores: list[float]) -> float:
        log_clean = math.log1p(-self.leak) + sum(math.log1p(-min(s, 1 - 1e-9)) for s in scores)
        p = min(max(-math.expm1(log_clean), 1e-9), 1 - 1e-9)
        return _sigmoid(math.log(p / (1 - p)) + self.shift)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def without_copies(texts: list[str], labels: list[int]) -> tuple[list[str], list[int]]:
    """Leaves out texts that share one of four smallest word triples with an earlier one.

    A group of copies is one observation: counted each time, the chance words of its text would pass as evidence.
    """
    seen: set[tuple[int, int]] = set()
    kept: tuple[list[str], list[int]] = ([], [])
    for text, label in zip(texts, labels):
        words = text.lower().split()
        triples = [zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))]
        marks = {(k, min(t * odd % 2**32 for t in triples)) for k, odd in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))}
        if not marks & seen:
            kept[0].append(text)
            kept[1].append(label)
        seen |= marks
    return kept


def likelihood(theta: np.ndarray, doc: np.ndarray, sen: np.ndarray, fea: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The documents' mean log likelihood, less a small penalty of the weights, and its gradient.

    theta: weights, bias, log odds of the leak. doc: the document of each sentence; sen, fea: sentence and feature of each hit.
    """
    w, bias, leak = theta[:-2], theta[-2], 1 / (1 + np.exp(-theta[-1]))
    p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sen, w[fea], minlength=len(doc)), -30, 30)))
    clean = np.exp(np.log1p(-leak) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)))
    toxic = np.clip(1 - clean, 1e-9, 1)
    pull = np.where(y == 1, clean / toxic, -1.0)  # d log likelihood / d (- log clean)
    slope = pull[doc] * p
    gradient = np.concatenate([np.bincount(fea, slope[sen], minlength=len(w)) / len(y) - 1e-4 * w, [slope.sum() / len(y), (pull * leak).sum() / len(y)]])
    value = np.where(y == 1, np.log(toxic), np.log(np.maximum(clean, 1e-300))).mean() - 0.5e-4 * (w * w).sum()
    return float(value), gradient


def fit_noisy_or(texts: list[str], labels: list[int], shift: float = 0.0, rounds: int = 300) -> NoisyOrModel:
    """Fits weights, bias and leak by gradient ascent of the documents' likelihood.

    Evidence is chosen first: features much more frequent in toxic than in clean documents. Without both labels or
    without evidence the model is its prior alone.
    """
    y = np.array(labels, dtype=float)
    prior = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.01
    if not len(y) or y.min() == y.max():
        return NoisyOrModel(leak=min(max(prior, 1e-3), 1 - 1e-3), shift=0.0)
    found: dict[str, list[str]] = {}

    def of(token: str) -> list[str]:
        out = found.get(token)
        if out is None:
            out = found[token] = features(token)
        return out

    seen = {0: Counter(), 1: Counter()}
    for text, label in zip(texts, labels):
        seen[int(label)].update({f for t in set(text.lower().split()) for f in of(t)})
    n1, n0 = y.sum(), len(y) - y.sum()
    chosen = []
    for f, a in seen[1].items():
        if a >= LEAST_DOCUMENTS:
            p1, p0 = (a + 0.5) / (n1 + 1), (seen[0][f] + 0.5) / (n0 + 1)
            odds = math.log(p1 / (1 - p1)) - math.log(p0 / (1 - p0))
            z = (a / n1 - seen[0][f] / n0) / math.sqrt((a + seen[0][f]) / (n1 + n0) * (1 / n1 + 1 / n0))
            if odds >= LEAST_LOG_ODDS and z >= LEAST_Z:
                chosen.append((-z, f))
    names = [f for _, f in sorted(chosen)[:MOST_EVIDENCE]]
    model = NoisyOrModel({f: 0.0 for f in names}, shift=shift)
    at = {f: i for i, f in enumerate(names)}
    document, sentence, feature, k = [], [], [], 0
    for d, text in enumerate(texts):
        for m in _SENTENCE.finditer(text.lower()):
            hits = {at[f] for t in set(m[0].split()) for f in of(t) if f in at}
            if hits:
                document.append(d)
                sentence += [k] * len(hits)
                feature += sorted(hits)
                k += 1
    doc, sen, fea = (np.array(x, dtype=np.int64) for x in (document, sentence, feature))
    theta = np.concatenate([np.full(len(names), 1.0), [-1.0, -3.0]])  # weights, bias, log odds of the leak
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        _, g = likelihood(theta, doc, sen, fea, y)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        theta[:-2] = np.maximum(theta[:-2], 0)  # evidence speaks for toxicity only
    model.weights = dict(zip(names, map(float, theta[:-2])))
    model.bias, model.leak = float(theta[-2]), float(1 / (1 + np.exp(-theta[-1])))
    return model


def held_out(row_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.pmod(F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> NoisyOrModel:
    """A model from the labelled rows that are not held out.

    At most SAMPLE_PER_LABEL rows and SAMPLE_CHARS characters of each label, the first by a hash of their id, come to the driver; the counts that
    set the prior are those of all labelled rows. Only ids and labels choose the sample; only texts are inputs. A text that no longer fits
    the characters left is passed over and the next one is taken, so very long texts never end the sample. Of the words and
    word parts that tell the labels apart, the MOST_EVIDENCE most telling ones have a weight.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    counts = {r["__y"]: r["n"] for r in usable.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts, ys = [], []
    for y in (0, 1):
        sample = usable.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE_PER_LABEL)
        # at most SAMPLE_PER_LABEL ids: a proven bound for the broadcast
        own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")
        chars = 0
        own = own.filter(F.coalesce(F.char_length("__text"), F.lit(0)) <= SAMPLE_CHARS)
        for r in own.select("__id", "__text").sort(F.xxhash64("__id"), "__id", "__text").limit(2 * SAMPLE_PER_LABEL).toLocalIterator():
            text = r["__text"] or ""
            if chars + len(text) > SAMPLE_CHARS:
                continue
            chars += len(text)
            texts.append(text)
            ys.append(y)
    texts, ys = without_copies(texts, ys)
    n1, n0, k1 = counts.get(1, 0), counts.get(0, 0), sum(ys)
    shift = math.log(n1 / n0) - math.log(k1 / (len(ys) - k1)) if n1 and n0 and 0 < k1 < len(ys) else 0.0
    return fit_noisy_or(texts, ys, shift)


def scored(text: Column, model: NoisyOrModel) -> Column:
    """struct(score, offending): the text's score, and start, end of each sentence that is itself likelier toxic.

    Offsets count code points. Null and empty texts have the score of no evidence.
    """

    @F.pandas_udf("score double, offending array<int>")
    def score(texts: pd.Series) -> pd.DataFrame:
        scores, spans = [], []
        for text in texts:
            found = model.sentences(text) if text else []
            scores.append(model.score([s for _, _, s in found]))
            spans.append([at for start, end, s in found if s >= 0.5 for at in (start, end)])
        return pd.DataFrame({"score": scores, "offending": spans})

    return score(text)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    model = fit_toxicity(docs, labels, id_col, text_col)
    return docs.filter(scored(F.col(text_col), model)["score"] < threshold)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, offending (start and end of each offending sentence, in turn).

    Rows with null or empty text have the score of no evidence; repeated rows each return their row; without usable
    labels every row has the prior as its score; an empty table returns no rows. Other columns are ignored.
    """
    model = fit_toxicity(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), scored(F.col(text_col), model).alias("found"))
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("found.score").alias("score"),
        (F.col("found.score") >= 0.5).cast("int").alias("predicted"),
        F.col("found.offending").alias("offending"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
