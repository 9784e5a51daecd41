"""What box scores say of a player before plus-minus does: a walk-forward ridge, and its blend with the measured value."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.hierarchy import spread
from matchloom.operators.scratch import written

#: The penalties that are tried, and the rows that a fold must learn from.
PENALTIES = tuple(float(10.0**e) for e in np.arange(-3.0, 4.01, 0.25))
LEAST_ROWS = 30


@dataclass(frozen=True)
class Sums:
    """Weighted sums of a set of rows: n, of the weights, by feature, of products, of the target, with the target, of its square."""

    n: float
    w: float
    x: np.ndarray
    xx: np.ndarray
    y: float
    xy: np.ndarray
    yy: float

    def __add__(self, other: Sums) -> Sums:
        return Sums(*(a + b for a, b in zip(vars(self).values(), vars(other).values())))

    def ridge(self, penalty: float) -> tuple[float, np.ndarray, float, float]:
        """Intercept, weights, degrees of freedom and cross-validation score of a ridge; the intercept is not penalised."""
        mean, middle = self.x / self.w, self.y / self.w
        gram, cross = self.xx - self.w * np.outer(mean, mean), self.xy - self.w * mean * middle
        inverse = np.linalg.inv(gram + penalty * np.eye(len(mean)))
        beta = inverse @ cross
        df = 1.0 + float(np.trace(inverse @ gram))
        rss = self.yy - self.w * middle**2 - 2 * beta @ cross + beta @ gram @ beta
        return middle - float(mean @ beta), beta, df, float(rss / self.w / max(1 - df / self.n, 1e-6) ** 2)

    def best(self) -> tuple[float, float, np.ndarray, float]:
        """The penalty of the least score (the smaller of equals), its intercept, weights and degrees of freedom."""
        scored = [(self.ridge(p), p) for p in PENALTIES]
        (intercept, beta, df, _), penalty = min(scored, key=lambda s: (s[0][3], s[1]))
        return penalty, intercept, beta, df


def weighted(targets: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with weight, 1 / (se**2 + tau2), and the fitted spread tau2 by key: observations as draws from the population that is fitted."""
    fitted = written(spread(targets.select(*by, F.col("y").alias("mean"), (F.col("se") * F.col("se")).alias("variance")), by))
    return targets.join(F.broadcast(fitted.select(*by, "tau2")), by).withColumn("weight", 1 / (F.col("se") * F.col("se") + F.col("tau2"))), fitted


def walk_forward(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows with prior and prior_se, each season by the ridge of all earlier ones; and season, n, penalty, df of each fit.

    rows: season, x0, x1, ..., y, weight. One aggregate gives every season's weighted sums (features squared a season); a fold's sums are those of the
    seasons before it, so nothing is read twice, and penalties are tried on sums alone. prior_se is the root of the fold's weighted residual variance and the
    weights' uncertainty. Seasons with fewer than LEAST_ROWS earlier rows have no prior.
    """
    x = [F.col(f"x{i}") for i in range(size)]
    w, y = F.col("weight"), F.col("y")
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = rows.groupBy("season").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("y"), F.sum(w * y * y).alias("yy"), *(F.sum(w * c).alias(f"x{i}") for i, c in enumerate(x)), *(F.sum(w * c * y).alias(f"xy{i}") for i, c in enumerate(x)),
        *(F.sum(w * x[i] * x[j]).alias(f"xx{i}_{j}") for i, j in pairs),
    )
    past, fits = None, []
    for r in sorted(sums.collect(), key=lambda r: r["season"]):
        if past is not None and past.n >= LEAST_ROWS:
            penalty, intercept, beta, df = past.best()
            mean = past.x / past.w
            gram = past.xx - past.w * np.outer(mean, mean)
            residual = past.yy - past.y**2 / past.w - 2 * beta @ (past.xy - mean * past.y) + beta @ gram @ beta
            around = float(residual / max(past.n - df, 1.0))
            cover = around * np.linalg.inv(gram + penalty * np.eye(size))
            fits.append((r["season"], int(past.n), penalty, df, intercept, beta.tolist(), mean.tolist(), cover.ravel().tolist(), around / past.w))
        xx = np.zeros((size, size))
        for i, j in pairs:
            xx[i, j] = xx[j, i] = r[f"xx{i}_{j}"]
        own = Sums(r["n"], r["w"], np.array([r[f"x{i}"] for i in range(size)]), xx, r["y"], np.array([r[f"xy{i}"] for i in range(size)]), r["yy"])
        past = own if past is None else past + own
    kind = dict(rows.dtypes)["season"]
    table = rows.sparkSession.createDataFrame(fits, f"season {kind}, n long, penalty double, df double, intercept double, beta array<double>, mean array<double>, cover array<double>, level double")
    met = rows.join(F.broadcast(table), "season")
    gap = [F.col(f"x{i}") - F.col("mean")[i] for i in range(size)]
    value = sum((F.col("beta")[i] * x[i] for i in range(size)), F.col("intercept"))
    spread_ = sum((F.col("cover")[i * size + j] * gap[i] * gap[j] for i in range(size) for j in range(size)), F.col("level"))
    return met.select(*rows.columns, value.alias("prior"), F.sqrt(spread_).alias("prior_se")), table.select("season", "n", "penalty", "df")


def blended(rows: DataFrame, variance: float | None = None) -> DataFrame:
    """Adds skill, skill_se and prior_share: prior and measured value y, each by the inverse of its variance.

    variance: that of the prior; by default that of its forecasts' errors over all rows that have both, which were made out of fold and hold the measured
    values' own errors too, so it leans to the measured side. A row without prior, or without a value with a positive se, has the other one.
    """
    if variance is None:
        variance = rows.agg(F.var_samp(F.col("y") - F.col("prior"))).first()[0]
    p = F.when(F.col("prior").isNotNull(), 1 / F.lit(variance)) if variance else F.lit(None).cast("double")
    m = F.when(F.col("y").isNotNull() & (F.col("se") > 0), 1 / (F.col("se") * F.col("se")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = zero(p) + zero(m)
    return rows.withColumns({"skill": F.try_divide(zero(p * F.col("prior")) + zero(m * F.col("y")), both), "skill_se": F.try_divide(F.lit(1.0), F.sqrt(both)), "prior_share": F.try_divide(zero(p), both)})
