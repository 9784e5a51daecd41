"""Packing tokenised documents into as few fixed-length sequences as possible."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.operators.scratch import written
from matchloom.session import table

#: Shares, at least, into which the pieces of one length are dealt to be numbered, and the pieces for which one more is made.
SHARES, PIECES_PER_SHARE = 64, 500_000
#: Rounds of multiplicative weights of the first program, and of each later one on what rounding down has left.
ROUNDS, ROUNDS_LEFT = 1200, 250
#: Ways to use the rounded configurations: the tokens of a sequence that may stay free, whether the smallest slot is left to
#: best fit, and the share of the program that is used. The whole histogram is packed in each way; the fewest sequences win,
#: and of equals the way that stands first. Where small pieces abound, half of the program leaves best fit those it ends with.
WAYS = ((2048, False, 1.0), (0, True, 1.0), (0, False, 0.5))
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(ranks_path: str) -> tiktoken.Encoding:
    """The byte-pair encoding of a rank file; a text's literal <|endoftext|> is the one id after the ranks."""
    import public_tokenizers

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def token_pieces(docs: DataFrame, ranks_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32.

    A document is the ids of its whole text (null: empty) and then end_id. One that is longer than capacity is cut
    into pieces of that length, of which the first may be shorter. Texts go through one at a time, so memory is
    bounded by the longest text.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(ranks_path).encode_to_numpy, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = memoryview(encode(text.as_py() or "", allowed_special="all").astype("<u4").tobytes() + end)
                total = len(ids) // 4
                at, size, k = 0, total % capacity or capacity, 0
                while at < total:
                    size = min(size, total)
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, size, k = at + size, capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def best_configuration(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> dict[int, int]:
    """Unbounded knapsack by dynamic programming: the multiset of types of the highest total price within capacity."""
    price_at = np.full(capacity + 1, -np.inf)
    type_at = np.full(capacity + 1, -1)
    for t in np.argsort(prices, kind="stable"):
        price_at[sizes[t]], type_at[sizes[t]] = prices[t], t
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=int)
    for c in range(1, capacity + 1):
        totals = price_at[1 : c + 1] + best[c - 1 :: -1]
        k = int(totals.argmax())
        best[c], last[c] = (totals[k], k + 1) if totals[k] > best[c - 1] else (best[c - 1], 0)
    taken: dict[int, int] = {}
    c = capacity
    while c > 0:
        if last[c]:
            t = int(type_at[last[c]])
            taken[t] = taken.get(t, 0) + 1
        c -= last[c] or 1
    return taken


def configuration_lp(counts: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int = 2000, rate: float = 0.5) -> list[tuple[dict[int, int], float]]:
    """Fractional solution of the configuration linear program by multiplicative weights.

    Minimise the number of sequences such that the configurations used cover every type's count. Each round prices
    the types by their weights, takes the best configuration from the knapsack, uses it until the first of its types
    is covered once more, and lowers the weights of what it covered.
    """
    covered, use = np.zeros(len(counts)), {}
    for _ in range(rounds):
        weights = np.exp(-rate * (covered - covered.min()))
        config = best_configuration(weights / weights.sum() / counts, sizes, capacity)
        types, times = np.array(list(config)), np.array(list(config.values()))
        step = float((counts[types] / times).min())
        covered[types] += step * times / counts[types]
        key = tuple(sorted(config.items()))
        use[key] = use.get(key, 0.0) + step
    scale = max(1.0, float(np.average(covered, weights=counts * sizes)))
    return sorted(((dict(key), x / scale) for key, x in use.items()), key=lambda c: (-c[1], sorted(c[0].items())))


def pack_by_program(left: np.ndarray, capacity: int, grain: int, waste: int, spare_last: bool, share: float, first: list | None) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Patterns that hold the pieces left (by length), and how many sequences of them the program has made.

    Each configuration of the program is used as often as its share, rounded down, with the largest exact lengths of its
    slots; what room is left is filled by best fit, and a sequence of which more than waste tokens stay free is not made.
    Then the program of the pieces that are left is solved and used likewise, as long as that makes any; not if only a
    share of the first one is used. The rest is packed by best fit, largest first. first: the configurations to begin with;
    None: best fit alone.
    """
    left = left.copy()
    patterns: list[tuple[dict[int, int], int]] = []

    def largest(low: int, limit: int, taken: dict[int, int]) -> int:
        """The largest length in low..limit of which one is left beside those taken; 0 if there is none."""
        free = left[low : limit + 1].copy()
        for length, times in taken.items():
            if low <= length <= limit:
                free[length - low] -= times
        found = np.flatnonzero(free > 0)
        return int(found[-1]) + low if len(found) else 0

    def fill(slots: list[tuple[int, int]], quota: int, waste: int) -> None:
        """Uses slots (shortest and longest length) up to quota times."""
        while quota > 0:
            taken: dict[int, int] = {}
            room = capacity
            for low, high in slots:
                if length := largest(low, min(high, room), taken) if room >= low else 0:
                    taken[length] = taken.get(length, 0) + 1
                    room -= length
            while room and (length := largest(1, room, taken)):
                taken[length] = taken.get(length, 0) + 1
                room -= length
            if not taken or room > waste:
                return
            times = min([quota, *(int(left[length]) // n for length, n in taken.items())])
            patterns.append((taken, times))
            for length, n in taken.items():
                left[length] -= n * times
            quota -= times

    configurations = first or []
    while configurations:
        made = len(patterns)
        for slots, x in configurations:
            fill(slots[:-1] if spare_last else slots, int(share * x), waste)
        configurations = configured(left, capacity, grain, ROUNDS_LEFT) if len(patterns) > made and share == 1 else []
    by_program = sum(times for _, times in patterns)
    while left.any():
        fill([], int(left.sum()), capacity)
    return patterns, by_program


def configured(left: np.ndarray, capacity: int, grain: int, rounds: int) -> list[tuple[list[tuple[int, int]], float]]:
    """The program's configurations for the pieces left, each as slots of a grain of lengths, largest first, and its use."""
    lengths = np.flatnonzero(left)
    if not len(lengths):
        return []
    sizes, at = np.unique(-(-lengths // grain), return_inverse=True)
    counts = np.zeros(len(sizes))
    np.add.at(counts, at, left[lengths])
    found = configuration_lp(counts, sizes, capacity // grain, rounds)
    return [(sorted(((int(sizes[t]) * grain - grain + 1, int(sizes[t]) * grain) for t, n in config.items() for _ in range(n)), reverse=True), x) for config, x in found]


def pack_histogram(histogram: dict[int, int], capacity: int = 2048, grain: int = 8) -> list[tuple[dict[int, int], int]]:
    """Patterns (count by length) and how often each is used; together they hold every piece exactly once.

    Lengths are grouped into grains for the linear program, whose solution is rounded and used by pack_by_program() in each
    of WAYS; best fit alone is tried as well. The fewest sequences win. Work and result depend on the number of distinct
    lengths (at most capacity), not on the rows.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    full = [({capacity: 1}, int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    program = configured(left, capacity, grain, ROUNDS)
    least = -(-int(left @ np.arange(capacity + 1)) // capacity)
    best = None
    for waste, spare_last, share, first in (*((*way, program) for way in WAYS), (capacity, False, 0.0, None)):
        patterns, _ = pack_by_program(left, capacity, grain, waste, spare_last, share, first)
        used = sum(times for _, times in patterns)
        if best is None or used < best[0]:
            best = used, patterns
        if used == least:
            break
    return full + best[1]


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32) of 1..capacity tokens.

    Only the length histogram, at most capacity rows, goes to the driver, and only the patterns come back. The
    pieces of one length are numbered in shares, so a length that most pieces have is dealt over many tasks; a
    piece's number within its length then tells its sequence and its place there.

    Ties: pieces of equal length take their numbers by doc_id, piece and checksum. Empty table: no rows.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = max(SHARES, sum(histogram.values()) // PIECES_PER_SHARE)
    starts, firsts, eachs, bases, uppers = [], [], [], [], []
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in pack_histogram(histogram, capacity):
        base = 0
        for length, n in sorted(pattern.items(), reverse=True):
            lo = used.get(length, 0)
            used[length] = lo + n * times
            starts.append((length << 44) + lo)
            uppers.append(lo)
            firsts.append(sequence)
            eachs.append(n)
            bases.append(base)
            base += n * length
        sequence += times
    order = np.argsort(np.array(starts, dtype=np.int64))
    start_at, lo_at, first_at, each_at, base_at = (np.array(x, dtype=np.int64)[order] for x in (starts, uppers, firsts, eachs, bases))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(start_at, (length.to_numpy() << 44) + number.to_numpy(), side="right") - 1
        nth = number.to_numpy() - lo_at[k]
        return pd.DataFrame({"sequence_id": first_at[k] + nth // each_at[k], "offset": base_at[k] + nth % each_at[k] * length.to_numpy()})

    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)).cast("int"))
    before = (
        dealt.groupBy("length", "share")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "share", (F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).alias("before"))
    )
    own = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = dealt.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "share"])
    return numbered.withColumn("at", place("length", F.col("before") + F.col("own"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset"
    )


def pack_documents(docs: DataFrame, ranks_path: str | None = None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises, cuts and packs documents; see token_pieces() and pack(). Repeated rows are packed as often as they occur."""
    import public_tokenizers

    return pack(written(token_pieces(docs, ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity, 0, id_col, text_col)), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
