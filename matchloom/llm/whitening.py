"""Whitening of vectors by the singular value decomposition of their centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.vectors import matrix, usable, whole, width
from matchloom.operators.scratch import written
from matchloom.session import table

#: Entries become floor(FACTOR * c) + OFFSET, so that sums and deviations are exact whole numbers.
FACTOR, OFFSET = 64.0, 1_000_000
#: Components that are returned at most.
COMPONENTS = 16
#: Singular values below this share of the largest are rounding: their eigenvalues are below 1e-12 of the largest.
LEAST_SINGULAR = 1e-6


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening.

    n: vectors of the fit list; sums: their sums by dimension; axes: a unit eigenvector of their covariance a row;
    eigenvalues: falling; total: the trace of the covariance; identity_error: largest absolute entry of the whitened fit
    list's covariance less the identity.
    """

    n: int
    sums: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    total: float
    identity_error: float = 0.0

    def whitened(self, vectors: np.ndarray) -> np.ndarray:
        """The vectors, a row each, less the mean, on the axes, each by its deviation; n * x - sums is exact."""
        return (self.n * vectors - self.sums) / self.n @ self.axes.T / np.sqrt(self.eigenvalues)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, the entries as whole numbers, of the rows with usable vectors; shorter ones end in zero entries."""
    rows = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), whole(F.col(vector_col), FACTOR, OFFSET).alias("x"))
    columns = width(rows, "x")
    return rows.withColumn("x", F.when(F.size("x") == columns, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(columns) - F.size("x")))))


def deviation(x: Column, n: int, sums: np.ndarray) -> Column:
    """The sum over dimensions of (n * x - sums)**2, a whole number; an error where it exceeds 64 bits."""
    gaps = F.zip_with(x, F.array(*(F.lit(int(s)) for s in sums)).cast("array<bigint>"), lambda v, s: v * F.lit(n).cast("long") - s)
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap * gap)


def _summed(fit: DataFrame, columns: int, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of an array made of each batch's vectors: an array a task, added up by place in Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(values(matrix(batch.column(0), columns)).ravel() for batch in batches if len(batch))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    found = fit.select("x").mapInArrow(add, "place long, value double").groupBy("place").agg(F.sum("value")).collect()
    return np.array([value for _, value in sorted(map(tuple, found))])


def _covariance(fit: DataFrame, whitening: Whitening) -> np.ndarray:
    """The covariance of the whitened fit list, divisor n: first its mean, then the products of what is left of it."""
    columns, size = len(whitening.sums), len(whitening.eigenvalues)
    mean = _summed(fit, columns, lambda x: whitening.whitened(x).sum(axis=0)) / whitening.n

    def products(x: np.ndarray) -> np.ndarray:
        centred = whitening.whitened(x) - mean
        return centred.T @ centred

    return _summed(fit, columns, products).reshape(size, size) / whitening.n


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the different vectors x of the rows, each taken once; None if they do not differ.

    The fit list is written, as each step reads it: exact sums by dimension, the decomposition of its centred rows by MLlib
    (whose tasks add up products of a row with itself; the square of the dimensions reaches the driver), the total variance
    from the exact deviations, and the covariance of the whitened rows. All singular values are asked for, as MLlib then solves densely to double
    precision instead of iterating to a tolerance; an eigenvalue is a squared singular value by n.

    Repeated vectors: once, however many rows hold them; they combine in the map tasks. Empty table or a single vector: None.
    """
    fit = written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("rows")).select("x"))
    columns = width(fit, "x")
    n = fit.count()
    if n < 2 or not columns:
        return None
    sums = np.array(fit.agg(*(F.sum(F.col("x")[d]) for d in range(columns))).first(), dtype=np.int64)
    total = fit.agg(F.sum(deviation(F.col("x"), n, sums).cast("decimal(38,0)"))).first()[0]
    literals = F.array(*(F.lit(int(s)) for s in sums)).cast("array<bigint>")
    centred = F.zip_with("x", literals, lambda v, s: (v * F.lit(n).cast("long") - s).cast("double") / F.lit(float(n)))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("row")))).computeSVD(columns, computeU=False, rCond=LEAST_SINGULAR)
    singular = found.s.toArray()[:components]
    whitening = Whitening(n, sums, found.V.toArray().T[: len(singular)], singular**2 / n, int(total) / n**3)
    covariance = _covariance(fit, whitening)
    return Whitening(n, sums, whitening.axes, whitening.eigenvalues, whitening.total, float(np.abs(covariance - np.eye(len(singular))).max()))


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """The rows vec_id, x, deviation, whitened (an entry per component), and the whitening they are made by.

    Entries are taken as whole numbers, floor(FACTOR * c) + OFFSET; the whitening is fitted on the different vectors, and
    applied to every row in Arrow batches, without a shuffle.

    Left out: vectors that are null or hold null or non-finite entries. Shorter vectors end in zero entries. Null ids stay
    null; repeated rows each return a row, the same for equal vectors. Components are fewer where the vectors span
    less; their signs are those of the decomposition, the same for all rows. Without two different vectors: no rows. Empty table: no rows. Other
    columns are ignored.
    """
    rows = whole_vectors(vectors, id_col, vector_col)
    whitening = fit_whitening(rows, components)
    if whitening is None:
        return rows.limit(0).withColumn("deviation", F.lit(0).cast("long")).withColumn("whitened", F.array().cast("array<double>")), None
    columns = len(whitening.sums)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(whitening.whitened(np.concatenate(x.to_numpy()).reshape(-1, columns)))) if len(x) else pd.Series([], dtype=object)

    return rows.withColumn("deviation", deviation(F.col("x"), whitening.n, whitening.sums)).withColumn("whitened", project("x")), whitening


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, whitening = whitened(table(spark, sf_dir, "embeddings"))
    n, error, shares = (whitening.n, whitening.identity_error, whitening.eigenvalues / whitening.total) if whitening else (0, 0.0, [])
    explained = F.array(*(F.lit(float(s)) for s in shares)).cast("array<double>")
    placed = rows.select("vec_id", "deviation", F.posexplode(F.arrays_zip(F.col("whitened"), explained.alias("explained"))).alias("place", "of"))
    return placed.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "of.whitened", "of.explained", F.lit(error).alias("identity_error")
    )
