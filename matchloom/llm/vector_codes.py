"""Product codes of vectors: each part of a vector is named by the nearest entry of its codebook, found in an annulus of norms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.vectors import matrix, usable, whole, width
from matchloom.session import table

#: Parts of a vector, entries of a part's codebook, rounds of refining them, and the factor by which components are scaled.
PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256.0
#: Entries of the nearest norms that are compared first; the best of them bounds the annulus.
PROBES = 4
#: Scaled components up to which squared distances are whole numbers of 64 bits with room for an index.
LARGEST = 1 << 24
#: Shares into which the rows of a label are dealt where they meet its sum.
SALTS = 16


class Annuli:
    """A codebook whose entries are sorted by norm."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        self.index = np.argsort(squares, kind="stable")
        self.entries, self.norms = entries[self.index], np.sqrt(squares[self.index].astype(float))

    def _keys(self, parts: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Squared distance and index of the entries at some places from some rows, as one number that orders by both."""
        distance = np.zeros(len(row), dtype=np.int64)
        for column in range(parts.shape[1]):
            gap = parts[row, column] - self.entries[place, column]
            distance += gap * gap
        return distance * len(self.index) + self.index[place]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each row's nearest entry, ties to the lower index; and how many were compared.

        An entry whose norm differs from a row's by more than the best distance known is further away than that: the entry
        of the nearest norms gives a distance, a binary search the places whose norms are in reach, bounds included (and
        widened by what rounding can take), and only those are compared.
        """
        n, size = len(parts), len(self.index)
        norms = np.sqrt((parts * parts).sum(axis=1).astype(float))
        probes = min(PROBES, size)
        first = np.clip(np.searchsorted(self.norms, norms) - probes // 2, 0, size - probes)
        place = (first[:, None] + np.arange(probes)).ravel()
        best = self._keys(parts, np.repeat(np.arange(n), probes), place).reshape(n, probes).min(axis=1)
        reach = np.sqrt((best // size).astype(float))
        slack = 1e-9 * (1 + norms + reach)
        low = np.searchsorted(self.norms, norms - reach - slack, "left")
        many = np.searchsorted(self.norms, norms + reach + slack, "right") - low
        starts = np.cumsum(many) - many
        place = np.arange(many.sum()) + np.repeat(low - starts, many)
        best = np.minimum.reduceat(self._keys(parts, np.repeat(np.arange(n), many), place), starts) if n else best
        return best % size, best // size, len(place) + n * probes


def _parts(vectors: pa.ListArray, codebooks: np.ndarray) -> np.ndarray:
    """The parts of a batch's vectors: part, row, component."""
    parts, _, components = codebooks.shape
    values = matrix(vectors, parts * components)
    if len(values) and max(values.max(), -float(values.min())) > LARGEST:
        raise ValueError(f"scaled components above {LARGEST}: use a smaller factor")
    return np.ascontiguousarray(values.reshape(len(values), parts, components).transpose(1, 0, 2))


def _sums(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """part, entry, n, s0, s1, ...: number and component sums of the parts that are nearest to an entry, a row for each
    that is used in a task."""
    parts, size, components = codebooks.shape
    names = [f"s{c}" for c in range(components)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(entries) for entries in codebooks]
        counts, sums = np.zeros((parts, size), dtype=np.int64), np.zeros((components, parts, size), dtype=np.int64)
        for batch in batches:
            for p, rows in enumerate(_parts(batch.column(0), codebooks)):
                index = annuli[p].nearest(rows)[0]
                counts[p] += np.bincount(index, minlength=size)
                for c in range(components):  # whole numbers below 2**53 in each batch
                    sums[c, p] += np.bincount(index, rows[:, c], minlength=size).astype(np.int64)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (p, e, counts[p, e], *sums[:, p, e])], ["part", "entry", "n", *names])

    found = rows.select("v").mapInArrow(add, "part long, entry long, n long, " + ", ".join(f"{name} long" for name in names))
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in names))


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, factor: float, *others: str) -> DataFrame:
    """vec_id, v, and the other columns, of the rows with usable vectors; v: the scaled components."""
    return vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), whole(F.col(vector_col), factor).alias("v"), *others)


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Codebooks of whole numbers: part, entry, component.

    They start as the parts of the vectors of the smallest ids, as many as entries, in their order. Each round names
    every part's nearest entry and replaces each entry by its parts' componentwise mean, rounded down; unused entries stay.
    A round is one pass whose tasks return at most a row per part and entry; their sums, of that fixed number, reach the driver.

    Left out: vectors that are null or hold null or non-finite components. Null id: in the means, never a first entry.
    Repeated ids: one first entry, of the least vector; every row counts in the means. Vectors that the parts do not divide, and shorter
    ones, end in zeros. Fewer ids than entries: fewer entries. Empty table: no entries. Other columns are ignored.
    """
    rows = whole_vectors(vectors, id_col, vector_col, factor)
    components = max(1, -(-width(rows, "v") // parts))
    named = rows.filter("vec_id is not null")
    ids = [r[0] for r in named.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return np.zeros((parts, 0, components), dtype=np.int64)
    first = named.filter(F.col("vec_id") <= F.lit(ids[-1])).groupBy("vec_id").agg(F.min("v").alias("v")).collect()
    by_id = {r["vec_id"]: r["v"] for r in first}
    codebooks = np.zeros((parts, len(ids), components), dtype=np.int64)
    for e, i in enumerate(ids):
        codebooks[:, e] = np.array(by_id[i] + [0] * (parts * components - len(by_id[i])), dtype=np.int64).reshape(parts, components)
    for _ in range(rounds):
        sums = _sums(rows, codebooks).collect()
        for r in sums:
            codebooks[r["part"], r["entry"]] = [r[f"s{c}"] // r["n"] for c in range(components)]
    return codebooks


def coded(vectors: DataFrame, codebooks: np.ndarray, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, code (a byte a part), error (squared distances to the named entries, summed), and row, a struct of the kept columns.

    One pass without a shuffle. Rows with unusable vectors are left out, as are all rows where there are no entries; null
    ids stay null and repeated rows each return a row. At most 256 entries. Empty table: no rows.
    """
    parts, size, _ = codebooks.shape
    if size > 256:
        raise ValueError("a code has a byte a part: at most 256 entries")
    rows = whole_vectors(vectors, id_col, vector_col, factor, F.struct(F.lit(0).alias("_"), *keep).alias("row"))
    schema = rows.select("vec_id", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), "row").schema

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(entries) for entries in codebooks]
        for batch in batches:
            codes, error = np.zeros((len(batch), parts), dtype=np.uint8), np.zeros(len(batch), dtype=np.int64)
            for p, rows in enumerate(_parts(batch.column(1), codebooks)):
                codes[:, p], distance, _ = annuli[p].nearest(rows)
                error += distance
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), batch.column(2)], ["vec_id", "code", "error", "row"])

    return (rows if size else rows.limit(0)).mapInArrow(name, schema)


def decoded(codes: DataFrame, codebooks: np.ndarray, factor: float = FACTOR) -> DataFrame:
    """vec_id and vector, of the rows (vec_id, code): the middle of the steps that the named entries stand for."""
    schema = codes.select("vec_id", F.array(F.lit(0.0)).alias("vector")).schema

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([list(c) for c in batch.column(1).to_pylist()], dtype=np.int64).reshape(len(batch), len(codebooks))
            vectors = (np.concatenate([codebooks[p][codes[:, p]] for p in range(len(codebooks))], axis=1) + 0.5) / factor
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(restore, schema)


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def summed_by(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds the sum of a value over the rows of equal keys, nulls together.

    Sums combine in the map tasks; each is sent to the shares of its key that have rows, so a hot key is dealt out.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), F.lit(SALTS)).cast("int"))
    sums = dealt.groupBy(F.col(key).alias("of")).agg(F.sum(value).alias(name), F.bit_or(F.expr("shiftleft(1, salt)")).alias("used"))
    sums = sums.select("of", name, F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(used, s) & 1) = 1)")).alias("share"))
    return dealt.join(sums, F.col("salt").eqNullSafe(F.col("share")) & F.col(key).eqNullSafe(F.col("of"))).drop("salt", "share", "of")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    codebooks = fit_codebooks(vectors)
    rows = coded(vectors, codebooks, keep=("label",)).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "row.label")
    return summed_by(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))


def _round_sql(number: int, last: bool) -> str:
    """A round over the parts p: the nearest entry of the codebook cN as entry and error, and unless it is the last, the next codebook."""
    gap = " + ".join(f"(p.x[{i}] - c.e[{i}]) * (p.x[{i}] - c.e[{i}])" for i in range(1, 5))
    mean = ", ".join(f"CAST(floor(CAST(sum(a.x[{i}]) AS DOUBLE) / count(a.x)) AS BIGINT)" for i in range(1, 5))
    nearest = f"""
a{number} AS (
  SELECT p.vec_id, p.part, any_value(p.x) AS x, min(({gap}) * 64 + c.entry) AS k
  FROM p JOIN c{number} c ON p.part = c.part GROUP BY p.vec_id, p.part)"""
    following = f""",
c{number + 1} AS (
  SELECT c.part, c.entry, CASE WHEN count(a.x) = 0 THEN any_value(c.e) ELSE [{mean}] END AS e
  FROM c{number} c LEFT JOIN a{number} a ON a.part = c.part AND a.k % 64 = c.entry
  GROUP BY c.part, c.entry)"""
    return nearest + ("" if last else following)


OP13_SQL = f"""
WITH v AS (
  SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT vec_id, CAST(r.part AS BIGINT) AS part, q[4 * r.part + 1 : 4 * r.part + 4] AS x
  FROM v, range(16) r(part)),
c0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e
  FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
{_round_sql(0, False)}, {_round_sql(1, False)}, {_round_sql(2, True)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', k % 64), '' ORDER BY part) AS code, CAST(sum(k // 64) AS BIGINT) AS error
  FROM a2 GROUP BY vec_id)
SELECT coded.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM coded JOIN v ON coded.vec_id = v.vec_id
"""
