"""Series of maps: which are admitted, what a race without memory would give, and momentum beside unmeasured quality."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.scratch import forget, written

#: Wins that decide a series, and nodes of the quadrature over a series' unmeasured quality.
TARGET, NODES = 3, 24
#: Half the 95 % quantile of chi-square with one degree of freedom.
HALF_CHI2 = 3.841459 / 2
#: What is counted of a race, for one that happened and for one that is enumerated.
EVENTS = ["first_side_won", "first_map_winner_won", "sweep", "decider", "reverse_sweep"]


def admitted(maps: DataFrame, target: int = TARGET) -> DataFrame:
    """series, reason, path: why a series is left out (null: admitted), and its results as an array of 1 and 0.

    maps: series, ordinal, winner, first, score1, score2; winner is null where a map is undecided, first is the side that
    score1 counts. A series is admitted if its maps are its result. Reasons in their order: undecided_map, ordinal_gap
    (ordinals are not 1, 2, ... once each), score_mismatch (the maps do not add up to the scores), best_of_n for another
    format. Series without two different scores are not decided and are no rows.
    """
    won = F.col("winner") == F.col("first")
    wins = F.count_if(won)
    last = F.greatest(F.any_value("score1"), F.any_value("score2"))
    n = F.count(F.lit(1))
    reason = (
        F.when(F.count("winner") < n, "undecided_map")
        .when((F.count_distinct("ordinal") < n) | ~F.coalesce((F.min("ordinal") == 1) & (F.max("ordinal") == n), F.lit(False)), "ordinal_gap")
        .when((wins != F.any_value("score1")) | (n - wins != F.any_value("score2")), "score_mismatch")
        .when(last != target, F.concat(F.lit("best_of_"), (2 * last - 1).cast("string")))
    )
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", won.cast("int").alias("won")))), lambda m: m["won"])
    decided = maps.filter("score1 <> score2")
    return decided.groupBy("series").agg(reason.alias("reason"), in_order.alias("path"))


def race_paths(target: int = TARGET) -> list[tuple[int, ...]]:
    """Every race to target wins, as results of the first side."""
    out = set()
    for results in itertools.product((1, 0), repeat=2 * target - 1):
        ends = (n for n in range(target, 2 * target) if target in (sum(results[:n]), n - sum(results[:n])))
        out.add(results[: next(ends)])
    return sorted(out)


def race_events(path: Column, target: int = TARGET) -> dict[str, Column]:
    """The events of a race, 1 or 0, from its results in order."""
    wins = F.aggregate(path, F.lit(0), lambda n, x: n + x)
    won = (wins == target).cast("int")
    lost_first = F.forall(F.slice(path, 1, target - 1), lambda x: x != won)
    found = [won == 1, F.element_at(path, 1) == won, (wins == 0) | (wins == F.size(path)), F.size(path) == 2 * target - 1, lost_first]
    return {name: value.cast("int").alias(name) for name, value in zip(EVENTS, found)}


def race_chances(rotations: DataFrame, keys: list[str], a: float = 1.0, sigma: float = 0.0, target: int = TARGET) -> DataFrame:
    """keys and the chance of each event, of races whose maps have no memory.

    rotations: keys, logits: the first side's strength on each of the 2 * target - 1 maps of the rotation. A map is won with
    probability sigmoid(a * logit + sigma * u), u standard normal, one for a whole series, averaged over the nodes. Every race is a
    product of its maps' chances; an event's chance is the sum over the races that have it, one expression of a row.
    """
    nodes, weights = gauss_hermite() if sigma else (np.zeros(1), np.ones(1))
    node = F.explode(F.array(*(F.struct(F.lit(float(u)).alias("u"), F.lit(float(w)).alias("w")) for u, w in zip(nodes, weights)))).alias("node")
    most = 2 * target - 1
    each = rotations.select(*keys, node, *(F.col("logits")[i].alias(f"x{i}") for i in range(most)))
    chances = each.select(*keys, F.col("node.w").alias("w"), *((1 / (1 + F.exp(-(a * F.col(f"x{i}") + sigma * F.col("node.u"))))).alias(f"p{i}") for i in range(most)))
    parts = []
    for i in range(len(EVENTS)):
        races = [math.prod((F.col(f"p{n}") if x else 1 - F.col(f"p{n}") for n, x in enumerate(path)), start=F.col("w")) for path in race_paths(target) if path_events(path, target)[i]]
        parts.append(F.sum(sum(races[1:], races[0])).alias(EVENTS[i]))
    return chances.groupBy(*keys).agg(*parts)


def path_events(path: tuple[int, ...], target: int = TARGET) -> tuple[bool, ...]:
    """The events of a race, in the order of EVENTS."""
    won = sum(path) == target
    return won, path[0] == won, len(path) == target, len(path) == 2 * target - 1, all(x != won for x in path[: target - 1])


def gauss_hermite(n: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of the mean of a function of a standard normal value."""
    nodes, weights = np.polynomial.hermite_e.hermegauss(n)
    return nodes, weights / math.sqrt(2 * math.pi)


def _terms(batch: pa.RecordBatch, points: np.ndarray) -> np.ndarray:
    """By point: the batch's log-likelihood, its gradient in (a, sigma, gamma) and its Hessian's upper half.

    With quality integrated out, the gradient is the mean, over the nodes' posterior weights, of the gradient given the
    node, and the Hessian the mean Hessian and the gradients' covariance.
    """
    nodes, weights = gauss_hermite()
    lengths = np.asarray(batch.column(0).value_lengths())
    row = np.repeat(np.arange(len(batch)), lengths)
    strength, won = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(float) for i in range(2))
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    before = np.concatenate([[0.0], 2 * won[:-1] - 1])
    before[first] = 0.0
    out = np.zeros((len(points), 10))
    for k, (a, sigma, gamma) in enumerate(points):
        eta = (a * strength + gamma * before)[:, None] + sigma * nodes
        p = 1 / (1 + np.exp(-eta))
        by_series = lambda x: np.add.reduceat(x, first, axis=0)
        given = by_series(won[:, None] * eta - np.logaddexp(0, eta))
        top = given.max(axis=1, keepdims=True)
        joint = np.exp(given - top) * weights
        total = joint.sum(axis=1)
        post = joint / total[:, None]
        slope = [strength[:, None], nodes[None, :], before[:, None]]
        rest, bend = won[:, None] - p, -p * (1 - p)
        g = [by_series(rest * s) for s in slope]
        mean = [(post * x).sum(axis=1) for x in g]
        out[k, 0] = (np.log(total) + top[:, 0]).sum()
        out[k, 1:4] = [m.sum() for m in mean]
        pairs = [(i, j) for i in range(3) for j in range(i, 3)]
        out[k, 4:] = [((post * (by_series(bend * slope[i] * slope[j]) + g[i] * g[j])).sum(axis=1) - mean[i] * mean[j]).sum() for i, j in pairs]
    return out


def log_likelihoods(series: DataFrame, points: list[tuple[float, float, float]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Per point (a, sigma, gamma): log-likelihood, gradient and Hessian of all series, by one aggregate.

    series: strength, won: arrays of a series' maps in order. A task returns ten sums a point.
    """
    grid = np.array(points, dtype=float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((_terms(batch, grid) for batch in batches if len(batch)), np.zeros((len(grid), 10)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid))), *(pa.array(total[:, i]) for i in range(10))], ["point", *(f"s{i}" for i in range(10))])

    schema = "point long, " + ", ".join(f"s{i} double" for i in range(10))
    found = series.select("strength", "won").mapInArrow(sums, schema).groupBy("point").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(10))).collect()
    out = []
    for r in sorted(found, key=lambda r: r["point"]):
        h = np.zeros((3, 3))
        h[np.triu_indices(3)] = r[5:]
        out.append((r["s0"], np.array(r[2:5]), h + np.triu(h, 1).T))
    return out


@dataclass(frozen=True)
class Momentum:
    """Weights of strength (a) and of the previous map (gamma), spread of unmeasured quality (sigma), log-likelihood."""

    a: float
    sigma: float
    gamma: float
    loglik: float

    @property
    def point(self) -> tuple[float, float, float]:
        return self.a, self.sigma, self.gamma


#: Shares of Newton's step that are tried at once.
STEPS = (1.0, 0.5, 0.25, 1 / 16, 1 / 256)


def fit_momentum(series: DataFrame, fixed_gamma: float | None = None, start: tuple[float, float, float] = (1.0, 0.5, 0.0), tol: float = 1e-7, rounds: int = 100) -> Momentum:
    """Maximum likelihood of P(map won) = sigmoid(a * strength + u + gamma * (1 after a won map, -1 after a lost one)),
    u ~ Normal(0, sigma**2) one for a series, over whole sequences from the first map.

    Newton's method, on the concave side by the eigenvalues' sizes; a round is one pass over the series, which tries several
    shares of the step at once. fixed_gamma: the previous map's weight is held (0: no momentum). Ends when no step of
    tol is left; a failure to do so in the given rounds is an error.
    """
    free = [0, 1] if fixed_gamma is not None else [0, 1, 2]
    at = np.array(start, dtype=float)
    if fixed_gamma is not None:
        at[2] = fixed_gamma
    value, gradient, hessian = log_likelihoods(series, [tuple(at)])[0]
    for _ in range(rounds):
        sizes, axes = np.linalg.eigh(hessian[np.ix_(free, free)])
        step = np.zeros(3)
        step[free] = axes @ (axes.T @ gradient[free] / np.maximum(np.abs(sizes), 1e-8))
        step *= min(1.0, 2.0 / max(1e-300, np.abs(step).max()))
        if np.abs(step).max() < tol:
            return Momentum(float(at[0]), abs(float(at[1])), float(at[2]), value)
        tried = [tuple(at + s * step) for s in STEPS]
        found = log_likelihoods(series, tried)
        best = max(range(len(tried)), key=lambda k: found[k][0])
        if found[best][0] < value:  # within rounding of the top
            return Momentum(float(at[0]), abs(float(at[1])), float(at[2]), value)
        at, (value, gradient, hessian) = np.array(tried[best]), found[best]
    raise ArithmeticError(f"no maximum within {rounds} rounds")


def gamma_interval(series: DataFrame, best: Momentum, tol: float = 1e-3) -> tuple[float, float]:
    """The 95 % profile-likelihood interval of the previous map's weight.

    A bound is where the best log-likelihood with the weight held falls to HALF_CHI2 below the maximum. The other two are
    refitted from the last fit at every weight tried; brackets start from the curvature and are halved to tol.
    """

    def short(gamma: float, start: Momentum) -> tuple[float, Momentum]:
        fitted = fit_momentum(series, gamma, start.point, tol=1e-5)
        return fitted.loglik - (best.loglik - HALF_CHI2), fitted

    hessian = log_likelihoods(series, [best.point])[0][2]
    spread = math.sqrt(max(1e-6, float(np.linalg.pinv(-hessian)[2, 2])))
    bounds = []
    for direction in (-1, 1):
        near, near_left, far = best.gamma, HALF_CHI2, best.gamma + direction * 1.96 * spread
        left, fitted = short(far, best)
        while left > 0:
            near, near_left, far = far, left, far + direction * spread
            left, fitted = short(far, fitted)
        while abs(far - near) > tol:
            share = min(0.9, max(0.1, near_left / (near_left - left)))  # the secant, kept inside the bracket
            middle = near + share * (far - near)
            there, fitted = short(middle, fitted)
            if abs(there) < 1e-4:
                near = far = middle
            elif there > 0:
                near, near_left = middle, there
            else:
                far, left = middle, there
        bounds.append((near + far) / 2)
    return bounds[0], bounds[1]


def momentum(series: DataFrame) -> dict[str, float]:
    """The fit with momentum, without it, their likelihood ratio, and the interval of the previous map's weight.

    series: strength, won. It is written once, as each step reads it.
    """
    rows = written(series.select(F.transform("strength", lambda x: x.cast("double")).alias("strength"), F.transform("won", lambda x: x.cast("double")).alias("won")).filter("size(won) > 0"))
    null = fit_momentum(rows, 0.0)
    full = fit_momentum(rows, None, null.point)
    low, high = gamma_interval(rows, full)
    n = rows.count()
    forget(rows)
    return {"n": n, "a": full.a, "sigma": full.sigma, "gamma": full.gamma, "low": low, "high": high, "loglik": full.loglik, "null_a": null.a, "null_sigma": null.sigma, "null_loglik": null.loglik}
