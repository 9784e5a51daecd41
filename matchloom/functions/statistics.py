"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson_interval(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a proportion."""
    centre = (wins + z * z / 2) / (n + z * z)
    half = z * F.sqrt(wins * (n - wins) / n + z * z / 4) / (n + z * z)
    return centre - half, centre + half


def ratio_standard_error(n: str, k: str, d: str, kk: str, dd: str, kd: str) -> Column:
    """Standard error of sum(k) / sum(d) by the delta method, from counts, sums and second moments."""
    n_, k_, d_, kk_, dd_, kd_ = (F.col(c).cast("double") for c in (n, k, d, kk, dd, kd))
    r = k_ / F.nullif(d_, F.lit(0.0))
    variance = n_ / F.nullif(n_ - 1, F.lit(0.0)) * (kk_ - 2 * r * kd_ + r * r * dd_) / (d_ * d_)
    return F.when((n_ >= 2) & (d_ > 0) & (variance > 0), F.sqrt(variance))
