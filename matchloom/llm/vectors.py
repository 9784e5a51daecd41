"""Vectors of a table as whole numbers, in expressions and in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor non-finite entries."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def whole(vector: Column, factor: float, offset: int = 0) -> Column:
    """floor(factor * x) + offset of each entry x, as double before it is multiplied."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long") + F.lit(offset).cast("long"))


def width(vectors: DataFrame, vector_col: str) -> int:
    """Entries of the longest vector; 0 for an empty table."""
    return vectors.agg(F.max(F.size(vector_col))).first()[0] or 0


def matrix(vectors: pa.ListArray, columns: int) -> np.ndarray:
    """The vectors of an Arrow batch, none of them null, a row each; missing entries of shorter ones are 0."""
    lengths, values = np.asarray(vectors.value_lengths()), vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == columns).all():
        return values.reshape(len(vectors), columns)
    out = np.zeros((len(vectors), columns), dtype=values.dtype)
    row = np.repeat(np.arange(len(vectors)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out
