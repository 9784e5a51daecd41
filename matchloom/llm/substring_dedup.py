"""Removal of long passages that an earlier document has, by suffix automata over the passages' shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.operators.scratch import written
from matchloom.session import table

#: Words of an anchor, by whose smallest hash a window is dealt out.
ANCHOR = 6
#: A run of windows with one anchor is cut after so many windows.
LONGEST_RUN = 256
#: Bytes of text that are hashed at a time; a longer text is hashed alone.
BYTES_AT_A_TIME = 1 << 21
#: Passages that are handed on at a time.
PASSAGES_AT_A_TIME = 4000
#: Words of the passages that share an automaton; the last anchor may exceed it by SHARD_PASSAGES passages at most.
SHARD_WORDS = 40_000
#: Different passages of one anchor that an automaton holds. Anchors with more are dealt anew by other anchors; if they have
#: more even then, they are split into several automata, and every passage of the anchor is read by each.
SHARD_PASSAGES = 1000
#: Passages of such an anchor, the first by id, that tell which word sequences are common to it.
REFERENCES = 64
#: Shares into which the rows of a passage are dealt in joins.
SALTS = 16
#: With at most so many anchors that are dealt anew, what is common to each is broadcast; with more it is joined.
BROADCAST_ANCHORS = 10_000

OCCURRENCES = "anchor long, doc_id long, mark long, start int, count int"
#: Different passages: the smallest and the largest document that has each.
PASSAGES = "anchor long, passage binary, first long, last long, words string"
#: Stretches of a passage's windows that first is the smallest document to have.
PARTS = "array<struct<start:int,count:int,first:long>>"


@lru_cache(maxsize=1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, and the powers of an odd base and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    rng = np.random.Generator(np.random.PCG64(20))
    powers = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, dtype=np.uint64), dtype=np.uint64)])
    return rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), powers(base), powers(pow(base, -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts that lie in data one after another, and the number of its text."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    edge[0] = True
    before = np.concatenate([[True], gap[:-1]]) | edge[:-1]
    after = np.concatenate([gap[1:], [True]]) | edge[1:]
    starts, stops = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    values, up, down = _tables(max(len(data), BYTES_AT_A_TIME))
    total = np.concatenate([[np.uint64(0)], np.cumsum(values[data] * up[: len(data)], dtype=np.uint64)])
    return mixed((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64)), np.searchsorted(ends, starts, side="right")


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """The hash of each sequence of ANCHOR words."""
    grams = np.zeros(max(0, len(words) - ANCHOR + 1), dtype=np.uint64)
    for j in range(ANCHOR):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(grams)]
    return mixed(grams)


def runs(data: np.ndarray, ends: np.ndarray, window: int, common: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows that have the same anchor: anchor, text, first word, windows.

    A window's anchor is the smallest hash of the ANCHOR-word sequences in it, so equal windows have equal anchors.
    Hashes in common count as larger than all others.
    """
    words, text = word_hashes(data, ends)
    n = len(words) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    low, reach, width = gram_hashes(words), 1, window - ANCHOR + 1
    if common is not None:
        low = (low >> np.uint64(1)) | (np.isin(low, common).astype(np.uint64) << np.uint64(63))
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[:n], low[width - reach : width - reach + n])
    valid = text[:n] == text[window - 1 :]
    change = np.ones(n, dtype=bool)
    change[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1]) | (text[1:n] != text[: n - 1])
    bounds = np.flatnonzero(change)
    count = np.diff(np.append(bounds, n))
    bounds, count = bounds[valid[bounds]], count[valid[bounds]]
    if len(count) and count.max() > LONGEST_RUN:
        cuts = -(-count // LONGEST_RUN)
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        bounds = np.repeat(bounds, cuts) + nth * LONGEST_RUN
        count = np.minimum(np.repeat(count, cuts) - nth * LONGEST_RUN, LONGEST_RUN)
    first = np.searchsorted(text, text[bounds], side="left")
    return low[bounds].view(np.int64), text[bounds], bounds - first, count


def passage_name(words: bytes) -> bytes:
    """Equal passages have equal names, others different ones: a cryptographic digest of the words."""
    return hashlib.blake2b(words, digest_size=16).digest()


def occurrences(rows: DataFrame, window: int) -> DataFrame:
    """The runs of all rows (doc_id, mark, text), whole texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(2).cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_A_TIME, side="right")) - 1)
                part = slice(int(offsets[at]), int(offsets[to]))
                if part.stop > part.start:
                    anchor, row, first, count = runs(data[part], offsets[at + 1 : to + 1] - offsets[at], window)
                    numbers = (anchor, ids[at + row], marks[at + row], first.astype(np.int32), count.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], ["anchor", "doc_id", "mark", "start", "count"])
                at = to

    return rows.filter("doc_id is not null").select("doc_id", "mark", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, OCCURRENCES)


class SuffixAutomaton:
    """All substrings of the passages added, each with the smallest document that has it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int, link: int, follow: dict[int, int], first: int | None) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), None)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], doc_id: int) -> None:
        """Passages come by rising doc_id, so the first to reach a state is its smallest."""
        link, length, follow = self.link, self.length, self.next
        last = 0
        for word in words:
            q = follow[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                new = self._state(length[last] + 1, 0, {}, None)
                p = last
                while p >= 0 and word not in follow[p]:
                    follow[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = follow[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = new
            if self.first[last] is None:
                self.first[last] = doc_id

    def settle(self) -> None:
        """Hands each state's smallest document on to its suffixes."""
        first, link = self.first, self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[state]
            if up > 0 and first[state] is not None and (first[up] is None or first[state] < first[up]):
                first[up] = first[state]

    def matches(self, words: list[int], window: int) -> Iterator[tuple[int, int]]:
        """Streams a passage: the start of each of its windows that the automaton knows, and the smallest document that has it."""
        follow, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in follow[state]:
                state = link[state]
                matched = length[state]
            if word in follow[state]:
                state = follow[state][word]
                matched += 1
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if matched >= window:
                yield i - window + 1, first[state]


def stretches(windows: Iterator[tuple[int, int]], below: int) -> list[dict[str, int]]:
    """Start, count and first of each stretch of consecutive windows with one smallest document, if that is below the given one."""
    out: list[dict[str, int]] = []
    for start, first in windows:
        if first < below:
            if out and start == out[-1]["start"] + out[-1]["count"] and first == out[-1]["first"]:
                out[-1]["count"] += 1
            else:
                out.append({"start": start, "count": 1, "first": first})
    return out


def streamed(passages: DataFrame, window: int) -> DataFrame:
    """anchor, passage, parts of passages (PASSAGES) that hold windows which a smaller document than their last has.

    Passages lie by anchor, and whole anchors are gathered to reference shards of about SHARD_WORDS words. A shard's
    suffix automaton is built from its passages, and each of them is then streamed through it for matching statistics.
    Equal windows have equal anchors, so a passage can match its own shard only: no automaton is sent elsewhere. An
    anchor of more passages than SHARD_PASSAGES is split into several shards, all of which its passages stream through.
    """

    def settle(shard: list[tuple]) -> list[tuple[int, bytes, list[dict[str, int]]]]:
        numbers: dict[str, int] = {}
        read = sorted(((first, last, a, p, own, [numbers.setdefault(w, len(numbers)) for w in words.split(" ")]) for a, _, own, p, first, last, words in shard), key=lambda r: r[:2])
        automaton = SuffixAutomaton()
        for first, _, _, _, own, words in read:
            if own:
                automaton.add(words, first)
        automaton.settle()
        found = ((a, p, stretches(automaton.matches(words, window), last)) for _, last, a, p, _, words in read)
        return [f for f in found if f[2]]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            a, p, parts = zip(*rows) if rows else ((), (), ())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("count", pa.int32()), ("first", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.binary()), pa.array(parts, kind)], ["anchor", "passage", "parts"])

        shard: list[tuple] = []
        anchor: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if anchor and row[:2] != anchor[-1][:2]:
                    shard += anchor
                    size += sum(r[6].count(" ") + 1 for r in anchor)
                    anchor = []
                    if size >= SHARD_WORDS:
                        yield out(settle(shard))
                        shard, size = [], 0
                anchor.append(row)
        yield out(settle(shard + anchor))

    several = passages.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD_PASSAGES).select("anchor", F.ceil(F.col("n") / F.lit(0.5 * SHARD_PASSAGES)).cast("int").alias("shards"))
    split = passages.join(several, "anchor", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = split.withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).withColumn("own", F.col("shard") == F.pmod(F.xxhash64("passage"), F.col("shards")))
    lying = dealt.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    return lying.select("anchor", "shard", "own", "passage", "first", "last", "words").mapInArrow(match, f"anchor long, passage binary, parts {PARTS}")


def streamed_anew(passages: DataFrame, window: int) -> DataFrame:
    """What streamed() returns, for anchors of very many passages: dealt anew by anchors that avoid common words.

    The word sequences that the first REFERENCES passages of an anchor share are common to it. Windows that reach
    beyond a common passage thus get anchors from outside it, which few others have, and those inside are the same
    words everywhere.
    """

    @F.pandas_udf("array<long>")
    def shared_grams(groups):
        out = []
        for texts in groups:
            seen = [np.unique(gram_hashes(word_hashes(d, np.array([len(d)]))[0])) for d in (np.frombuffer(t.encode(), dtype=np.uint8) for t in texts)]
            grams, n = np.unique(np.concatenate(seen), return_counts=True)
            out.append(grams[n > 1].view(np.int64))
        return pd.Series(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, names, texts = [], [], [], []
            for row, (anchor, words, common) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 4, 5)))):
                data = np.frombuffer(words.encode(), dtype=np.uint8)
                found = runs(data, np.array([len(data)]), window, np.array(common, dtype=np.int64).view(np.uint64))
                own = mixed(found[0].view(np.uint64) ^ np.array([anchor], dtype=np.int64).view(np.uint64)).view(np.int64)
                split = words.split(" ")
                for a, start, count in zip(own.tolist(), found[2].tolist(), found[3].tolist()):
                    rows.append(row)
                    numbers.append((a, start))
                    texts.append(" ".join(split[start : start + count + window - 1]))
                    names.append(passage_name(texts[-1].encode()))
            take = pa.array(rows, pa.int64())
            anew, start = zip(*numbers) if numbers else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(4)), pa.array(anew, pa.int64()), pa.array(names, pa.binary()), pa.array(start, pa.int32()), pa.array(texts, pa.string())],
                ["anchor", "passage", "first", "last", "anew", "part", "at", "words"],
            )

    nth = F.row_number().over(Window.partitionBy("anchor").orderBy("first", "passage"))
    some = passages.select("anchor", "first", "passage", "words", nth.alias("nth")).filter(F.col("nth") <= REFERENCES)
    common = some.groupBy("anchor").agg(F.collect_list("words").alias("texts")).select("anchor", shared_grams("texts").alias("common"))
    schema = "anchor long, passage binary, first long, last long, anew long, part binary, at int, words string"
    found = passages.join(F.broadcast(common) if common.count() <= BROADCAST_ANCHORS else common, "anchor").select("anchor", "passage", "first", "last", "words", "common")
    found = written(found.mapInArrow(cut, schema))
    again = different(found.select(F.col("anew").alias("anchor"), F.col("part").alias("passage"), "first", "last", "words"))
    parts = streamed(again, window).select(F.col("anchor").alias("anew"), F.col("passage").alias("part"), F.explode("parts").alias("in"))
    back = dealt_parts(found.drop("words"), parts, ["anew", "part"], "passage").filter(F.col("in.first") < F.col("last"))
    moved = F.struct((F.col("at") + F.col("in.start")).alias("start"), F.col("in.count").alias("count"), F.col("in.first").alias("first"))
    return back.groupBy("anchor", "passage").agg(F.collect_list(moved).alias("parts"))


def different(rows: DataFrame) -> DataFrame:
    """The different passages (PASSAGES) among rows of the same columns, of anchors that more than one document has."""
    passages = rows.groupBy("anchor", "passage").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("words").alias("words"))
    shared = passages.groupBy("anchor").agg(F.min("first").alias("low"), F.max("last").alias("high")).filter("low < high").select("anchor")
    return passages.join(shared, "anchor")


def dealt_parts(rows: DataFrame, parts: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """rows joined with the parts of their passages; a passage's rows are dealt over SALTS tasks by the column spread."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"]).drop("salt")


def repeated_windows(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, mark, windows: per row that has any, the array of (start, count) of windows to remove.

    1. Every row's windows are dealt into runs by anchor; anchors that one document alone has are done with.
    2. The words of the other runs are cut from the texts. Equal passages are combined: they are one reference, with its
       smallest and its largest document. A passage that a third of all rows have is a row a map task.
    3. The references make shards by anchor; each shard's suffix automaton reads the passages for matching statistics:
       the stretches of windows that it knows, each with the smallest document that has them.
    4. Every row whose passage holds a stretch loses it if that document is smaller than the row's own.
    """
    found = occurrences(rows, window)
    several = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor")
    per_row = found.join(several, "anchor").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "start", "count")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_: list[tuple[int, int, int, int, bytes, str]] = []

        def out() -> pa.RecordBatch:
            schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("anchor", pa.int64()), ("start", pa.int32()), ("passage", pa.binary()), ("words", pa.string())])
            columns = zip(*rows_) if rows_ else ((),) * 6
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for doc_id, mark, text, wanted in zip(*batch.columns):
                split = text.as_py().encode().split()
                for r in wanted.as_py():
                    words = b" ".join(split[r["start"] : r["start"] + r["count"] + window - 1])
                    rows_.append((doc_id.as_py(), mark.as_py(), r["anchor"], r["start"], passage_name(words), words.decode()))
                    if len(rows_) >= PASSAGES_AT_A_TIME:
                        yield out()
                        rows_.clear()
        yield out()

    texts = rows.join(per_row, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", "text", "runs")
    streams = written(texts.mapInArrow(cut, "doc_id long, mark long, anchor long, start int, passage binary, words string"))
    passages = written(different(streams.select("anchor", "passage", F.col("doc_id").alias("first"), F.col("doc_id").alias("last"), "words")))
    many = written(passages.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD_PASSAGES).select("anchor"))
    parts = streamed(passages.join(many, "anchor", "left_anti"), window)
    if not many.isEmpty():
        parts = parts.unionByName(streamed_anew(passages.join(many, "anchor", "left_semi"), window))
    gone = dealt_parts(streams.drop("words"), parts.select("anchor", "passage", F.explode("parts").alias("in")), ["anchor", "passage"], "doc_id").filter(F.col("in.first") < F.col("doc_id"))
    return written(gone.groupBy("doc_id", "mark").agg(F.collect_list(F.struct((F.col("start") + F.col("in.start")).alias("start"), F.col("in.count").alias("count"))).alias("windows")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))


def kept_words(words: list[bytes], windows: Sequence | None, window: int) -> tuple[np.ndarray, list[bytes]]:
    """Which words stay, and those words."""
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for w in () if windows is None else windows:
        edges[w["start"]] += 1
        edges[w["start"] + w["count"] + window - 1] -= 1
    stays = np.cumsum(edges[:-1]) == 0
    return stays, [words[i] for i in np.flatnonzero(stays)]


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256.

    A word goes if it lies in a stretch of window words, all of one text, that also stands in a document with a
    smaller id; texts are judged as they came. Null and empty texts have no words. Rows without an id neither lose
    words nor make others lose any. Repeated rows (same id) never match each other; each returns its row. Empty
    table: no rows. Other columns are ignored.
    """
    rows = _keyed(docs, id_col, text_col)
    windows = repeated_windows(rows, window)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digests = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode().split()
                kept = kept_words(words, found, window)[1] if found is not None else words
                total.append(len(words))
                gone.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = rows.join(windows, ["doc_id", "mark"], "left").select("doc_id", "text", "windows")
    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns, texts without the words that substring_dedup() removes.

    A text that loses nothing stays as it is; otherwise each stretch that stays keeps its own white space, and
    stretches are joined by one space. No row is dropped, even if nothing of its text stays.
    """
    rows = _keyed(docs, id_col, text_col)
    windows = repeated_windows(rows, window).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "windows")

    @F.pandas_udf("string")
    def stripped(texts, found):
        return texts.combine(found, lambda text, w: text if w is None or text is None else _without(text, w, window))

    # the row travels in one struct, so its columns clash with none of the join's
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(F.col(text_col)).alias("own_mark"))
    joined = whole.join(windows, (F.col("own_id") == F.col("__id")) & (F.col("own_mark") == F.col("__mark")), "left")
    text = F.col("row")[text_col]
    new = F.when(F.col("windows").isNull(), text).otherwise(stripped(text, F.col("windows")))
    return joined.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def _without(text: str, windows: Sequence, window: int) -> str:
    data = text.encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    gap = np.concatenate([[True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    stays = np.concatenate([[False], kept_words([b""] * len(starts), windows, window)[0], [False]])
    opens, closes = np.flatnonzero(~stays[:-1] & stays[1:]), np.flatnonzero(stays[:-1] & ~stays[1:]) - 1
    return " ".join(data[starts[a] : ends[b]].decode() for a, b in zip(opens, closes))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
