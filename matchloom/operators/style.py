"""Styles of play: what players do at their own level, the components that are shared structure, and groups among them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.ordering import numbered
from matchloom.operators.scratch import shuffles_removed, written

#: The least share of a season's subjects that have a feature, replicates of the parallel analysis and their percentile, restarts and rounds of k-means.
SEASON_SHARE, HORN_REPLICATES, HORN_PERCENTILE, RESTARTS, MOST_ROUNDS = 0.40, 200, 95.0, 20, 200
#: Places of a dealt column that a task holds (8 bytes each a feature), and entries that are moved at once (650 MB).
WIDTH, MOVED = 1 << 16, 50_000_000


def basis(values: DataFrame, ratings: DataFrame) -> tuple[DataFrame, list[str]]:
    """The complete cases (subject, rating, x0, x1, ...) and the names of their features.

    values: season, subject (a player's season), feature, z; ratings: subject, rating. A feature is eligible if in every season at least SEASON_SHARE of the
    subjects have it, so the basis means the same in each; a subject needs all eligible features and a rating. Features are a catalogue of bounded length and become columns.
    """
    values = written(values.filter("z is not null"))
    sizes = values.groupBy("season").agg(F.count_distinct("subject").alias("n"))
    seasons = sizes.count()
    shares = values.groupBy("season", "feature").agg(F.count_distinct("subject").alias("have")).join(sizes, "season")
    names = [r["feature"] for r in shares.filter(F.col("have") >= SEASON_SHARE * F.col("n")).groupBy("feature").agg(F.count(F.lit(1)).alias("s")).filter(F.col("s") == seasons).orderBy("feature").collect()]
    wide = values.groupBy("subject").agg(*(F.max(F.when(F.col("feature") == name, F.col("z"))).alias(f"x{i}") for i, name in enumerate(names)))
    return wide.join(ratings.select("subject", "rating"), "subject").dropna(), names


def residuals(rows: DataFrame, size: int) -> tuple[DataFrame, float]:
    """subject and x0, ... after the rating is taken out of every feature, of mean 0 and deviation 1; and the share of variance that it explained.

    Feature and rating are standardised, so the slope is their correlation: one aggregate gives all moments. A feature without spread is 0.
    """
    moments = rows.agg(F.avg("rating").alias("m"), F.stddev_pop("rating").alias("s"), *(f(f"x{i}").alias(f"{n}{i}") for i in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop))), *(F.covar_pop(f"x{i}", "rating").alias(f"c{i}") for i in range(size))).first()
    q = (F.col("rating") - moments["m"]) / (moments["s"] or 1.0)
    out, explained, total = [], 0.0, 0
    for i in range(size):
        spread = moments[f"s{i}"] or 0.0
        if spread == 0.0:
            out.append(F.lit(0.0).alias(f"x{i}"))
            continue
        r = moments[f"c{i}"] / spread / (moments["s"] or 1.0) if moments["s"] else 0.0
        explained, total = explained + r * r, total + 1
        left = math.sqrt(1 - r * r)
        z = (F.col(f"x{i}") - moments[f"m{i}"]) / spread - r * q
        out.append((z / left if left > 1e-9 else F.lit(0.0)).alias(f"x{i}"))
    return rows.select("subject", *out), explained / total if total else 0.0


def _products(rows: DataFrame, key: str, size: int) -> dict[int, np.ndarray]:
    """By key (a small number), the sums of products of all pairs of x0, ...: a matrix a key and task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, x = batch.column(0).to_numpy(zero_copy_only=False), np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(size)], axis=1)
            for k in np.unique(keys).tolist():
                own = x[keys == k]
                total[k] = total.get(k, 0.0) + own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))], ["k", "s"])

    return _matrices(rows.select(F.col(key).cast("int"), *(f"x{i}" for i in range(size))).mapInArrow(add, "k int, s array<double>"), size)


def _matrices(made: DataFrame, size: int) -> dict[int, np.ndarray]:
    """The sums of the matrices (k, s) by key."""
    summed = made.select("k", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in summed.collect():
        out.setdefault(r["k"], np.zeros(size * size))[r["i"]] = r["v"]
    return {k: v.reshape(size, size) for k, v in out.items()}


def _dealt_products(placed: DataFrame, size: int, maps: list[tuple[int, int, int, int]], prime: int) -> dict[int, np.ndarray]:
    """By replicate, the sums of products of all pairs of x0, ... after each column i of replicate k is dealt anew by its map (k, i, a, b) of the places, modulo prime.

    A task sends each entry to the WIDTH places that hold its new one, packed by replicate; a task there lays them out and multiplies. So many replicates go at a time that at most
    MOVED entries are on their way, whose files are removed before the next.
    """
    entry = np.dtype([("place", "<i4"), ("i", "u1"), ("v", "<f8")])
    by_replicate: dict[int, list[tuple[int, int, int]]] = {}
    for k, i, a, b in maps:
        by_replicate.setdefault(k, []).append((i, a, b))

    def deal(some: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place, x = batch.column(0).to_numpy() - 1, [batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(size)]
                for k in some:
                    keys, packed = [], []
                    slot = np.concatenate([(a * place + b) % prime for _, a, b in by_replicate[k]])
                    all_entries = np.empty(len(slot), entry)
                    all_entries["place"], all_entries["i"] = slot % WIDTH, np.repeat([i for i, _, _ in by_replicate[k]], len(place))
                    all_entries["v"] = np.concatenate([x[i] for i, _, _ in by_replicate[k]])
                    order = np.argsort(slot // WIDTH, kind="stable")
                    parts, starts = np.unique((slot // WIDTH)[order], return_index=True)
                    for part, own in zip(parts.tolist(), np.split(all_entries[order], starts[1:])):
                        keys.append(part)
                        packed.append(own.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], ["k", "part", "entries"])

        return run

    def multiply(rows: pa.Table) -> pa.Table:
        x = np.zeros((WIDTH, size))
        for one in rows["entries"]:
            own = np.frombuffer(one.as_py(), entry)
            x[own["place"], own["i"]] = own["v"]
        return pa.table({"k": rows["k"][:1], "s": pa.array([(x.T @ x).ravel()], pa.list_(pa.float64()))})

    out: dict[int, np.ndarray] = {}
    numbers, at_once = list(by_replicate), max(1, MOVED // max(1, prime * size))
    for start in range(0, len(numbers), at_once):
        moved = placed.select("place", *(f"x{i}" for i in range(size))).mapInArrow(deal(numbers[start : start + at_once]), "k int, part long, entries binary")
        with shuffles_removed(placed.sparkSession):
            out |= _matrices(moved.groupBy("k", "part").applyInArrow(multiply, "k int, s array<double>"), size)
    return out


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def components(rows: DataFrame, size: int, replicates: int = HORN_REPLICATES) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """subject, s0, s1, ... of the components that are more than chance; their loadings; all eigenvalues; and the null's percentiles.

    rows: residuals(). The covariance is summed in Spark, its eigenvectors are taken on the driver (features squared). The null deals every column anew, each by a map i -> a * i + b modulo a
    prime of its own a and b, of the rows' places (the column filled up with means to the prime's length): this keeps a column's own distribution and breaks what it shares with
    others, without sorting. Components are retained whose eigenvalue is above the null's HORN_PERCENTILE of the same rank, at least one; the largest loading is positive.
    """
    placed = written(numbered(rows, [*(f"x{i}" for i in range(size)), "subject"], "place"))
    n = placed.count()
    prime, rng = next_prime(max(n, 2)), np.random.default_rng(n)
    values, axes = np.linalg.eigh(_products(placed.withColumn("k", F.lit(0)), "k", size)[0] / max(1, n - 1))
    values, axes = values[::-1], axes[:, ::-1].T
    maps = [(r, i, int(rng.integers(1, prime)), int(rng.integers(0, prime))) for r in range(replicates) for i in range(size)]
    null = np.array([np.linalg.eigvalsh(c / max(1, n - 1))[::-1] for c in _dealt_products(placed, size, maps, prime).values()])
    bound = np.percentile(null, HORN_PERCENTILE, axis=0)
    kept = max(1, int((values > bound).sum()))
    loadings = axes[:kept] * np.sign(np.take_along_axis(axes[:kept], np.abs(axes[:kept]).argmax(axis=1)[:, None], axis=1))
    scores = [sum((F.col(f"x{i}") * float(loadings[c, i]) for i in range(size)), F.lit(0.0)).alias(f"s{c}") for c in range(kept)]
    return placed.select("subject", *scores), loadings, values, bound


def _pass(points: DataFrame, size: int, width: int, keys: int, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What sums(points of a batch) gives, an array keys x width, added up over tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((keys, width))
        for batch in batches:
            if len(batch):
                total += sums(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(size)], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(total.ravel())], ["v"])

    made = points.select(*(f"s{i}" for i in range(size))).mapInArrow(_numbered(add), "i long, v double")
    out = np.zeros(keys * width)
    for r in made.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(keys, width)


def _numbered(add: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in add(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(0)], ["i", "v"])

    return run


def k_means(points: DataFrame, size: int, k: int, restarts: int = RESTARTS) -> tuple[np.ndarray, float]:
    """Centres and inertia of the best of several k-means runs over the rows (subject, s0, s1, ...).

    The first centres are drawn as k-means++ draws them: every row has an exponential waiting time whose rate is its squared distance from the centres so far, from a digest of its subject, and the least time
    wins, an exact draw by one aggregate. All restarts go through the same passes: a pass sums rows by restart and nearest centre. An empty centre stays where it is.
    """
    rows = written(points)
    names = [f"s{i}" for i in range(size)]
    centres = np.zeros((restarts, 0, size))
    for c in range(k):
        gap = lambda r: F.least(*g) if len(g := [sum(((F.col(s) - float(centres[r, j, i])) ** 2 for i, s in enumerate(names)), F.lit(0.0)) for j in range(c)]) > 1 else g[0] if g else F.lit(1.0)  # noqa: B023, E731
        time = lambda r: F.try_divide(-F.ln((F.pmod(F.xxhash64("subject", F.lit(1000 * r + c)), F.lit(2**52)) + 1) / F.lit(float(2**52 + 1))), gap(r))  # noqa: B023, E731
        picked = rows.agg(*(F.min_by(F.struct(*names), F.struct(F.coalesce(time(r), F.lit(float("inf"))), *names)).alias(f"r{r}") for r in range(restarts))).first()
        fresh = np.array([[picked[f"r{r}"][s] for s in names] for r in range(restarts)])
        centres = np.concatenate([centres, fresh[:, None, :]], axis=1)
    inertia = np.zeros(restarts)
    for _ in range(MOST_ROUNDS):
        held = centres.copy()

        def sums(x: np.ndarray) -> np.ndarray:
            out = np.zeros((restarts * k, size + 2))
            for r in range(restarts):
                d = ((x[:, None, :] - held[r][None]) ** 2).sum(axis=2)  # noqa: B023
                near = d.argmin(axis=1)
                out[r * k : (r + 1) * k, 0] = np.bincount(near, minlength=k)
                for i in range(size):
                    out[r * k : (r + 1) * k, 1 + i] = np.bincount(near, x[:, i], minlength=k)
                out[r * k : (r + 1) * k, -1] = np.bincount(near, d.min(axis=1), minlength=k)
            return out

        found = _pass(rows, size, size + 2, restarts * k, sums).reshape(restarts, k, size + 2)
        inertia = found[:, :, -1].sum(axis=1)
        moved = np.where(found[:, :, :1] > 0, found[:, :, 1:-1] / np.maximum(found[:, :, :1], 1), centres)
        still = np.allclose(moved, centres, rtol=1e-9, atol=1e-12)
        centres = moved
        if still:
            break
    best = int(inertia.argmin())
    return centres[best], float(inertia[best])


def silhouette(points: DataFrame, size: int, centres: np.ndarray) -> float | None:
    """The mean silhouette by squared distances; None for a single group.

    The mean squared distance of a row to a group follows from the group's number, sum, and sum of squares, so one pass gathers those and another compares; no pairs are made. A row
    alone in its group counts 0.
    """
    k = len(centres)
    if k < 2:
        return None

    def near(x: np.ndarray) -> np.ndarray:
        return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)

    def groups(x: np.ndarray) -> np.ndarray:
        own = near(x)
        return np.stack([np.bincount(own, minlength=k), *(np.bincount(own, x[:, i], minlength=k) for i in range(size)), np.bincount(own, (x * x).sum(axis=1), minlength=k)], axis=1)

    g = _pass(points, size, size + 2, k, groups)
    n, total, squares = g[:, 0], g[:, 1:-1], g[:, -1]

    def widths(x: np.ndarray) -> np.ndarray:
        own, at = near(x), np.arange(len(x))
        apart = n * (x * x).sum(axis=1)[:, None] - 2 * x @ total.T + squares
        a = apart[at, own] / np.maximum(n[own] - 1, 1)
        others = np.where((np.arange(k)[None] == own[:, None]) | (n[None] == 0), np.inf, apart / np.maximum(n, 1))
        b = others.min(axis=1)
        top = np.maximum(a, b)
        s = np.where((n[own] > 1) & np.isfinite(b) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
        return np.array([[s.sum(), len(s)]])

    s = _pass(points, size, 2, 1, widths)[0]
    return float(s[0] / s[1]) if s[1] else None


def groups(points: DataFrame, size: int, most: int = 7, restarts: int = RESTARTS) -> DataFrame:
    """k, inertia, silhouette of the best k-means of each number of groups."""
    rows = written(points)
    out = []
    for k in range(1, most + 1):
        centres, inertia = k_means(rows, size, k, restarts)
        out.append((k, inertia, silhouette(rows, size, centres)))
    return points.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double")
