"""Blends of components of which some may be missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_present(weights: dict[str, float]) -> Column:
    """The weighted mean of the components that are not null; null if none is."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return F.when(total > 0, value / total)
