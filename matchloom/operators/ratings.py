"""Online ratings, their backtests, and regressions whose heavy sums are Spark aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.hierarchy import same, spread
from matchloom.operators.scratch import forget, written

#: Fixed values of the Elo and Glicko-2 systems.
ELO_START, ELO_SCALE, ELO_K = 1500.0, 400.0, 32.0
GLICKO_START, GLICKO_RD, GLICKO_VOL, GLICKO_SCALE, GLICKO_TAU = 1500.0, 350.0, 0.06, 173.7178, 0.5

#: Least rows of a span of a pool and most spans of one; rows and fits whose products a task makes at once (512 KB).
SPAN, SPANS, ROWS_AT_ONCE, FITS_AT_ONCE = 8192, 32, 1024, 64


def elo_expected(a: float, b: float) -> float:
    return 1 / (1 + 10 ** ((b - a) / ELO_SCALE))


def folded_in_order(df: DataFrame, pool: str, order: list[str], step: Callable, schema: str) -> DataFrame:
    """Streams each pool's rows in order through step(state, rows), which returns output rows as a DataFrame.

    Rows are dealt by pool and sorted, and batches are folded as they come: a task keeps one pool's state (a rating per
    side), never its rows. A pool is a league whose sides meet only each other, so pools are folded side by side.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), {}
        for batch in batches:
            for key, rows in batch.groupby(pool, sort=False, dropna=False):
                if key != at:
                    at, state = key, {}
                yield step(state, rows)

    return df.repartition(pool).sortWithinPartitions(pool, *order).mapInPandas(fold, schema)


def elo(series: DataFrame, k: float = ELO_K) -> DataFrame:
    """pool, series, p, rating_a, rating_b: the forecast before and both ratings after each decided series.

    series: pool, series, at, a, b, a_won (null: undecided, not rated); order is at, series.
    """

    def step(ratings: dict, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for pool, key, a, b, won in rows[["pool", "series", "a", "b", "a_won"]].itertuples(index=False):
            ra, rb = ratings.get(a, ELO_START), ratings.get(b, ELO_START)
            p = elo_expected(ra, rb)
            shift = k * (float(won) - p)
            ratings[a], ratings[b] = ra + shift, rb - shift
            out.append((pool, key, p, ra + shift, rb - shift))
        return pd.DataFrame(out, columns=["pool", "series", "p", "rating_a", "rating_b"])

    kinds = dict(series.dtypes)
    schema = f"pool {kinds['pool']}, series {kinds['series']}, p double, rating_a double, rating_b double"
    return folded_in_order(series.filter("a_won is not null"), "pool", ["at", "series"], step, schema)


def _new_variance(surprise: float, spread: float, old: float, tau: float) -> float:
    """The variance of strength whose log balances a period's surprise against its distance from the old one.

    surprise: squared estimated change; spread: variance of the rating and of that estimate together. The balance falls
    from plus to minus infinity in the log, so a bracket is widened around the old log and then halved.
    """

    def balance(log: float) -> float:
        x = math.exp(log)
        return x * (surprise - spread - x) / (2 * (spread + x) ** 2) - (log - math.log(old)) / tau**2

    reach = tau
    while not balance(math.log(old) - reach) > 0 > balance(math.log(old) + reach):
        reach *= 2
    low, high = math.log(old) - reach, math.log(old) + reach
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if balance(middle) > 0 else (low, middle)
    return math.exp((low + high) / 2)


def glicko2_update(r: float, rd: float, vol: float, games: list[tuple[float, float, float]], tau: float = GLICKO_TAU) -> tuple[float, float, float]:
    """Rating, deviation and volatility after a period of games (opponent's rating and deviation, score)."""
    strength, variance = (r - GLICKO_START) / GLICKO_SCALE, (rd / GLICKO_SCALE) ** 2
    if games:
        faced = np.array(games, dtype=float)
        damping = 1 / np.sqrt(1 + 3 * (faced[:, 1] / (GLICKO_SCALE * math.pi)) ** 2)
        expected = 1 / (1 + np.exp(damping * ((faced[:, 0] - GLICKO_START) / GLICKO_SCALE - strength)))
        information, pull = float((damping**2 * expected * (1 - expected)).sum()), float((damping * (faced[:, 2] - expected)).sum())
        vol = math.sqrt(_new_variance((pull / information) ** 2, variance + 1 / information, vol * vol, tau))
        variance = 1 / (1 / (variance + vol * vol) + information)
        strength += variance * pull
    else:
        variance += vol * vol
    return GLICKO_START + GLICKO_SCALE * strength, min(GLICKO_RD, GLICKO_SCALE * math.sqrt(variance)), vol


def glicko2(series: DataFrame, tau: float = GLICKO_TAU) -> DataFrame:
    """pool, period, side, rating, deviation, volatility of every side seen so far, after each period.

    series: pool, period, a, b, a_won. All of a period's series use the ratings at its start; idle sides only grow
    their deviation. A task holds one period's series of a pool.
    """

    def flush(state: dict) -> list[tuple]:
        if state.get("period") is None:
            return []
        ratings, games = state["ratings"], state["games"]
        before = dict(ratings)
        start = (GLICKO_START, GLICKO_RD, GLICKO_VOL)
        for side in {*before, *games}:
            ratings[side] = glicko2_update(*before.get(side, start), [(*before.get(o, start)[:2], s) for o, s in games.get(side, ())], tau)
        return [(state["pool"], state["period"], side, *x) for side, x in sorted(ratings.items())]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        columns = ["pool", "period", "side", "rating", "deviation", "volatility"]
        for batch in batches:
            out = []
            for pool, period, a, b, won in batch[["pool", "period", "a", "b", "a_won"]].itertuples(index=False):
                if state.get("pool") != pool or state.get("period") != period:
                    out += flush(state)
                    state = {"pool": pool, "period": period, "ratings": state["ratings"] if state.get("pool") == pool else {}, "games": {}}
                state["games"].setdefault(a, []).append((b, float(won)))
                state["games"].setdefault(b, []).append((a, 1 - float(won)))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(flush(state), columns=columns)

    kinds = dict(series.dtypes)
    schema = f"pool {kinds['pool']}, period {kinds['period']}, side {kinds['a']}, rating double, deviation double, volatility double"
    rated = series.filter("a_won is not null").repartition("pool").sortWithinPartitions("pool", "period", "series")
    return rated.mapInPandas(fold, schema)


def backtest(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: n, brier, log_loss, accuracy of predictions (p, won); p of one half or more predicts a win."""
    y = F.col("won").cast("double")
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"),
        F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"),
        F.avg(((F.col("p") >= 0.5) == F.col("won")).cast("double")).alias("accuracy"),
    )


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, share_won: predictions by equal bins of p, the last one closed above."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return predictions.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("won").cast("double")).alias("share_won"))


def logistic(df: DataFrame, features: list[str], target: str, l2: float = 1.0, rounds: int = 50, tol: float = 1e-9) -> np.ndarray:
    """Intercept and weights of a logistic regression with an unpenalised intercept, by Newton's method.

    Each round is one aggregate of the gradient and the upper half of the Hessian over the written features, so the input
    is made once and only (features + 1)**2 / 2 sums reach the driver. Fit by standardised features, or choose l2 accordingly.
    """
    df = written(df.select(*features, target))
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    beta = np.zeros(len(x))
    penalty = np.diag([0.0] + [l2] * len(features))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((xi * float(b) for xi, b in zip(x, beta)), F.lit(0.0))))
        rows = df.select(*(xi.alias(f"x{i}") for i, xi in enumerate(x)), p.alias("p"), F.col(target).cast("double").alias("y"))
        w = F.col("p") * (1 - F.col("p"))
        pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
        sums = rows.agg(
            *(F.sum(F.col(f"x{i}") * (F.col("y") - F.col("p"))).alias(f"g{i}") for i in range(len(x))), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}") * w).alias(f"h{i}_{j}") for i, j in pairs)
        ).first()
        g = np.array([sums[f"g{i}"] or 0.0 for i in range(len(x))]) - penalty @ beta
        h = np.zeros((len(x), len(x)))
        for i, j in pairs:
            h[i, j] = h[j, i] = sums[f"h{i}_{j}"] or 0.0
        step = np.linalg.solve(h + penalty + 1e-12 * np.eye(len(x)), g)
        beta += step
        if np.abs(step).max() < tol:
            break
    return beta


def standardised(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """The features less their mean, by their sample deviation, each among the rows of the same keys."""
    moments = df.groupBy(*keys).agg(*(f(c).alias(f"__{c}_{n}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    return df.join(moments, keys).withColumns({c: F.try_divide(F.col(c) - F.col(f"__{c}_m"), F.col(f"__{c}_s")) for c in features}).select(*df.columns)


def newton_step(keys: list[str], size: int, l2: float, tol: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A step of the fits (keys, n, __b0, ...) whose sums __g0, ... and __h0_0, ... are those of logistic_by(): the next weights, and whether these have settled."""
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            beta = batch[[f"__b{i}" for i in range(size)]].to_numpy()
            g, h = batch[[f"__g{i}" for i in range(size)]].to_numpy(copy=True), np.zeros((len(batch), size, size))
            for i, j in pairs:
                h[:, i, j] = h[:, j, i] = batch[f"__h{i}_{j}"]
            g[:, 1:] -= l2 * beta[:, 1:]
            h[:, range(1, size), range(1, size)] += l2
            h += 1e-12 * np.eye(size)
            settled = np.abs(g).max(axis=1) <= tol * np.maximum(batch["n"].to_numpy(), 1.0)
            new = beta + np.where(settled[:, None], 0.0, np.linalg.solve(h, g[:, :, None])[:, :, 0])
            out = pd.concat([batch[[*keys, "n"]], pd.DataFrame(new, columns=[f"__b{i}" for i in range(size)], index=batch.index)], axis=1)
            yield out.assign(__settled=settled)

    return step


def logistic_by(df: DataFrame, keys: list[str], features: list[str], target: str, l2: float = 1.0, weight: str | None = None, tol: float = 1e-10, rounds: int = 200) -> DataFrame:
    """keys, n, intercept and a weight per feature: the regression of logistic() for every group of rows at once.

    target: a result, or the number of results that are 1 in a row that stands for weight results. A round is one aggregate of the
    sums of the groups that have not settled; the groups' weights, a row each, are the state between rounds. A group settles when no entry of
    its gradient is above tol times its results, so one whose results are all alike settles too; an error if rounds run out.
    Rows with a null feature are left out.
    """
    names = ["intercept", *features]
    times = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = written(df.dropna(subset=[*keys, *features, target]).select(*keys, *(F.col(f).cast("double").alias(f) for f in features), F.col(target).cast("double").alias("__y"), times.alias("__t")))
    x = [F.lit(1.0), *(F.col(f) for f in features)]
    size = len(x)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    state = rows.groupBy(*keys).agg(F.sum("__t").alias("n"), *(F.lit(0.0).alias(f"__b{i}") for i in range(size)))
    schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes) + ", n double, " + ", ".join(f"__b{i} double" for i in range(size)) + ", __settled boolean"

    step = newton_step(keys, size, l2, tol)
    done: list[DataFrame] = []
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((xi * F.col(f"__b{i}") for i, xi in enumerate(x)), F.lit(0.0))))
        seen = rows.join(state, keys).withColumn("__p", p).withColumn("__w", F.col("__t") * F.col("__p") * (1 - F.col("__p")))
        sums = seen.groupBy(*keys, "n", *(f"__b{i}" for i in range(size))).agg(
            *(F.sum(xi * (F.col("__y") - F.col("__t") * F.col("__p"))).alias(f"__g{i}") for i, xi in enumerate(x)), *(F.sum(x[i] * x[j] * F.col("__w")).alias(f"__h{i}_{j}") for i, j in pairs)
        )
        moved = written(sums.mapInPandas(step, schema))
        done.append(moved.filter("__settled"))
        state = moved.filter("not __settled").drop("__settled")
        if state.isEmpty():
            break
    else:
        raise ArithmeticError(f"groups without settled weights after {rounds} rounds")
    forget(rows)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found.select(*keys, F.col("n").cast("long").alias("n"), *(F.col(f"__b{i}").alias(name) for i, name in enumerate(names)))


def logistic_of_prefixes(df: DataFrame, ends: DataFrame, features: list[str], target: str, l2: float = 1.0, tol: float = 1e-10, rounds: int = 200) -> DataFrame:
    """pool, block, n, intercept and a weight per feature: logistic_by() of the rows (pool, place, features, target) below each end (pool, block, end).

    A task holds a span of a pool's rows and the weights of all ends beyond it, whose sums are products of matrices: no row is copied to the ends.
    There are still as many terms a round as rows of all prefixes. A pool has at most SPANS spans.
    """
    size = 1 + len(features)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    b, g, h = [f"__b{i}" for i in range(size)], [f"__g{i}" for i in range(size)], [f"__h{i}_{j}" for i, j in pairs]
    plain = df.dropna(subset=["pool", "place", *features, target]).select("pool", "place", *(F.col(f).cast("double").alias(f) for f in features), F.col(target).cast("double").alias("__y"))
    width = df.groupBy("pool").agg(F.greatest(F.lit(SPAN), F.ceil((F.max("place") + 1) / SPANS)).alias("width"))
    rows = written(plain.join(width, "pool").withColumn("span", F.expr("place div width")).drop("width"))
    keys = ["pool", "block", "end", "width"]
    state = ends.select("pool", "block", F.col("end").cast("long").alias("end")).join(width, "pool").withColumns({c: F.lit(0.0) for c in b})
    types = dict(state.dtypes)

    def sums(own: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        own, fits = own.sort_values("place"), fits.sort_values("end")
        place, end, beta = own["place"].to_numpy(), fits["end"].to_numpy(), fits[b].to_numpy()
        x, y = np.column_stack([np.ones(len(own)), own[features].to_numpy()]), own["__y"].to_numpy()[:, None]
        sum_g, sum_h = np.zeros((len(fits), size)), np.zeros((len(fits), len(pairs)))
        for at in range(0, len(own), ROWS_AT_ONCE):
            part = slice(at, at + ROWS_AT_ONCE)
            here = x[part]
            products = np.column_stack([here[:, i] * here[:, j] for i, j in pairs])
            for start in range(np.searchsorted(end, place[at], side="right"), len(fits), FITS_AT_ONCE):
                some = slice(start, start + FITS_AT_ONCE)
                p = here @ -beta[some].T
                with np.errstate(over="ignore"):
                    np.exp(p, out=p)
                p += 1
                np.reciprocal(p, out=p)
                if place[part][-1] >= end[start]:
                    inside = place[part][:, None] < end[some]
                    p *= inside
                    sum_g[some] += (y[part] * inside).T @ here - p.T @ here
                else:
                    sum_g[some] += (y[part].T @ here) - p.T @ here
                p -= p * p
                sum_h[some] += p.T @ products
        out = pd.concat([fits[["pool", "block", "end", "width", *b]].reset_index(drop=True), pd.DataFrame({"n": np.searchsorted(place, end).astype(float)}), pd.DataFrame(sum_g, columns=g), pd.DataFrame(sum_h, columns=h)], axis=1)
        return out[out["n"] > 0]

    given = ", ".join(f"{c} {types[c]}" for c in keys)
    doubles = lambda *names: ", ".join(f"{c} double" for c in names)
    done: list[DataFrame] = []
    for _ in range(rounds):
        asked = state.withColumn("span", F.explode(F.expr("sequence(0, (end - 1) div width)")))
        made = rows.groupBy("pool", "span").cogroup(asked.groupBy("pool", "span")).applyInPandas(sums, f"{given}, {doubles(*b, 'n', *g, *h)}")
        total = made.groupBy(*keys, *b).agg(*(F.sum(c).alias(c) for c in ("n", *g, *h)))
        moved = written(total.mapInPandas(newton_step(keys, size, l2, tol), f"{given}, {doubles('n', *b)}, __settled boolean"))
        done.append(moved.filter("__settled"))
        state = moved.filter("not __settled").drop("__settled", "n")
        if state.isEmpty():
            break
    else:
        raise ArithmeticError(f"prefixes without settled weights after {rounds} rounds")
    forget(rows)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found.select("pool", "block", F.col("n").cast("long").alias("n"), *(F.col(c).alias(name) for c, name in zip(b, ["intercept", *features])))


def form(series: DataFrame, last: int = 5) -> DataFrame:
    """The series (pool, series, at, a, b, a_won) with form and h2h: what was known of the two sides before it.

    form: side a's share of wins in its last series less side b's; h2h: side a's share of the earlier series against b, less
    one half. A side without a past counts as one half.
    """
    side = lambda x, y, won: F.struct(F.col(x).alias("side"), F.col(y).alias("other"), won.cast("double").alias("won"))
    both = series.select("pool", "series", "at", F.inline(F.array(side("a", "b", F.col("a_won")), side("b", "a", ~F.col("a_won")))))
    recent = Window.partitionBy("pool", "side").orderBy("at", "series").rowsBetween(-last, -1)
    met = Window.partitionBy("pool", "side", "other").orderBy("at", "series").rowsBetween(Window.unboundedPreceding, -1)
    known = both.select("pool", "series", "side", F.coalesce(F.avg("won").over(recent), F.lit(0.5)).alias("recent"), (F.coalesce(F.avg("won").over(met), F.lit(0.5)) - 0.5).alias("h2h"))
    of = lambda x: known.select("pool", "series", F.col("side").alias(x), F.col("recent").alias(f"__{x}"), *(["h2h"] if x == "a" else []))
    joined = series.join(of("a"), ["pool", "series", "a"]).join(of("b"), ["pool", "series", "b"])
    return joined.select(*series.columns, (F.col("__a") - F.col("__b")).alias("form"), "h2h")


def walk_forward(df: DataFrame, period: str, features: list[str], target: str) -> DataFrame:
    """The rows with p, each by a regression of all earlier periods' rows; the first period has no forecast and is left out.

    Periods are few (seasons): a row is copied to each later period, and all periods are fitted at once.
    """
    later = df.select(F.col(period).alias("__at")).distinct()
    past = df.join(F.broadcast(later), F.col(period) < F.col("__at")) if later.count() <= 1000 else df.join(later, F.col(period) < F.col("__at"))
    weights = logistic_by(past.select(F.col("__at").alias(period), *features, target), [period], features, target)
    named = weights.select(period, *(F.col(c).alias(f"__w_{c}") for c in ["intercept", *features]))
    score = sum((F.col(f"__w_{c}") * F.col(c) for c in features), F.col("__w_intercept"))
    return df.join(named, period).withColumn("p", 1 / (1 + F.exp(-score))).select(*df.columns, "p")


def empirical_bayes(means: DataFrame, cohort: list[str]) -> DataFrame:
    """Adds mu, tau2, shrinkage and posterior to rows (cohort, mean, variance of the mean): a normal-normal model.

    The cohorts' spread is fitted until it settles, see hierarchy.spread(); a row's posterior keeps the share of its distance
    from mu that its variance leaves.
    """
    fitted = spread(means, cohort).select(*cohort, "mu", "tau2")
    both = means.alias("m").join(fitted.alias("f"), same("m", "f", cohort)).select("m.*", "f.mu", "f.tau2")
    weight = F.coalesce(F.try_divide(F.col("tau2"), F.col("tau2") + F.col("variance")), F.lit(0.0))
    return both.withColumns({"shrinkage": weight, "posterior": F.col("mu") + weight * (F.col("mean") - F.col("mu"))})


def adjusted_p(tests: DataFrame, family: list[str], tie: list[str]) -> DataFrame:
    """Adds q_bh and q_by to rows with p: step-up false discovery rates within each family.

    Rows are dealt by ranges of (family, p), so a large family lies in many partitions: ranks and minima from the last rank
    back are made in each, and a row per family and partition carries on what the partitions before and behind it hold.
    The dealt rows are written first: range bounds come from samples, and both uses must see the same partitions.
    """
    dealt = written(tests.repartitionByRange(*family, "p", *tie).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy(*family, "__part")
    across = Window.partitionBy(*family).orderBy("__part")
    sizes = dealt.groupBy(*family, "__part").agg(F.count(F.lit(1)).alias("__c"))
    sizes = sizes.withColumns({"__before": F.sum("__c").over(across) - F.col("__c"), "__n": F.sum("__c").over(Window.partitionBy(*family))})
    ranked = dealt.withColumn("__own", F.row_number().over(own.orderBy("p", *tie))).join(sizes, [*family, "__part"])
    ranked = ranked.withColumn("__i", F.col("__own") + F.col("__before")).withColumn("__r", F.col("p") * F.col("__n") / F.col("__i"))
    # from the last rank back, so that the frame only grows
    ranked = ranked.withColumn("__q", F.min("__r").over(own.orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0)))
    ends = ranked.groupBy(*family, "__part").agg(F.min("__r").alias("__least"), F.sum(1.0 / F.col("__i")).alias("__h"))
    behind = F.min("__least").over(Window.partitionBy(*family).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumns({"__behind": behind, "__harmonic": F.sum("__h").over(Window.partitionBy(*family))}).select(*family, "__part", "__behind", "__harmonic")
    q = F.least("__q", "__behind")
    out = ranked.join(ends, [*family, "__part"]).withColumns({"q_bh": F.least(q, F.lit(1.0)), "q_by": F.least(q * F.col("__harmonic"), F.lit(1.0))})
    return out.select(*tests.columns, "q_bh", "q_by")
