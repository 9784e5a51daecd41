"""The composite player rating: features that each cohort can express, weights learnt from maps, shrunken scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators import hierarchy
from matchloom.operators.ratings import logistic_by
from matchloom.operators.resample import copies, unit_number
from matchloom.operators.scratch import forget, written

#: Rows of a title that must hold other than 0 for a column to be tracked there; the share of a cohort's rows that must report it; maps
#: that a cohort needs for weights, and a player for the scale; the rating's unit.
LEAST_NONZERO, LEAST_SHARE, LEAST_GAMES, QUALIFIED_MAPS, UNIT = 20, 0.25, 40, 8, 0.15


@dataclass(frozen=True)
class Form:
    """One way to express a quantity: a numerator and a denominator, summed over maps each, and the columns that they need."""

    key: str
    numerator: str
    denominator: str
    sources: tuple[str, ...]


#: A quantity: its forms, the best first. A cohort is given the first that its columns support.
Slot = tuple[Form, ...]


def paced(key: str, value: str, *sources: str) -> Slot:
    """Per ten minutes where map time is known, else per map."""
    own = sources or (value,)
    return Form(f"{key}_p10", value, "duration_s / 600", (*own, "duration_s")), Form(f"{key}_pm", value, "1", own)


def resolved(rows: DataFrame, slots: dict[str, tuple[Slot, ...]]) -> DataFrame:
    """season, mode, form0, form1, ...: the place of the form that fills each slot of a cohort; null where none can.

    rows: season, mode, title and the columns that forms name; a row is a player's map. A title tracks a column if at least LEAST_NONZERO of its rows hold other than 0;
    a cohort reports it if at least LEAST_SHARE of its own rows hold it. A form needs both of all its columns. One aggregate by title and one by cohort.
    """
    columns = sorted({s for mode in slots.values() for slot in mode for form in slot for s in form.sources})
    tracked = rows.groupBy("title").agg(*((F.count_if(F.coalesce(F.col(c), F.lit(0)) != 0) >= LEAST_NONZERO).alias(f"t_{c}") for c in columns))
    shares = rows.groupBy("season", "mode").agg(F.min("title").alias("title"), *((F.count(c) >= LEAST_SHARE * F.count(F.lit(1))).alias(f"r_{c}") for c in columns))
    met = shares.join(tracked, "title")
    most = max(len(m) for m in slots.values())

    def form(slot: int) -> Column:
        out = F.lit(None).cast("int")
        for mode, of_mode in slots.items():
            if slot < len(of_mode):
                found = F.lit(None).cast("int")
                for place in reversed(range(len(of_mode[slot]))):
                    holds = F.lit(True)
                    for c in of_mode[slot][place].sources:
                        holds = holds & F.col(f"t_{c}") & F.col(f"r_{c}")
                    found = F.when(holds, place).otherwise(found)
                out = F.when(F.col("mode") == mode, found).otherwise(out)
        return out

    return met.select("season", "mode", *(form(s).alias(f"form{s}") for s in range(most)))


def terms(rows: DataFrame, forms: DataFrame, slots: dict[str, tuple[Slot, ...]]) -> DataFrame:
    """The rows with n0, d0, n1, d1, ...: numerator and denominator of each slot's form (null where the cohort has none; an absent value counts as 0)."""
    most = max(len(m) for m in slots.values())

    def of(slot: int, part: str) -> Column:
        out = F.lit(None).cast("double")
        for mode, of_mode in slots.items():
            for place, form in enumerate(of_mode[slot]) if slot < len(of_mode) else ():
                out = F.when((F.col("mode") == mode) & (F.col(f"form{slot}") == place), F.coalesce(F.expr(getattr(form, part)).cast("double"), F.lit(0.0))).otherwise(out)
        return out

    met = rows.join(F.broadcast(forms), ["season", "mode"])
    return met.select("*", *(of(s, part).alias(f"{part[0]}{s}") for s in range(most) for part in ("numerator", "denominator")))


def differences(given: DataFrame, size: int) -> DataFrame:
    """season, mode, game, event, won, x0, x1, ...: per map the profile of the smaller team less the other's.

    given: terms() of rows with game, event, team, won. A profile is summed before it is divided. Maps without exactly two teams, without a winner, or with a denominator that is not
    above 0 are left out; slots that a cohort cannot fill are 0.
    """
    sides = given.groupBy("season", "mode", "game", "team").agg(F.min("event").alias("event"), F.max("won").alias("won"), *(F.sum(f"{p}{s}").alias(f"{p}{s}") for s in range(size) for p in "nd"))
    profile = F.struct("team", "won", *(F.when(F.col(f"n{s}").isNull(), 0.0).otherwise(F.when(F.col(f"d{s}") > 0, F.col(f"n{s}") / F.col(f"d{s}"))).alias(f"x{s}") for s in range(size)))
    games = sides.groupBy("season", "mode", "game").agg(F.min("event").alias("event"), F.count(F.lit(1)).alias("teams"), F.min(profile).alias("a"), F.max(profile).alias("b")).filter("teams = 2 and a.won is not null")
    out = games.select("season", "mode", "game", "event", F.col("a.won").alias("won"), *((F.col(f"a.x{s}") - F.col(f"b.x{s}")).alias(f"x{s}") for s in range(size)))
    return out.dropna(subset=[f"x{s}" for s in range(size)])


def scaled(rows: DataFrame, keys: list[str], size: int, weight: str | None = None) -> DataFrame:
    """The rows with x0, ... less their mean by their sample deviation (1 where that is 0) among the rows of equal keys, each counted weight times."""
    t = F.col(weight) if weight else F.lit(1.0)
    sums = rows.groupBy(*keys).agg(F.sum(t).alias("n_"), *(F.sum(t * F.col(f"x{s}")).alias(f"m{s}") for s in range(size)), *(F.sum(t * F.col(f"x{s}") * F.col(f"x{s}")).alias(f"q{s}") for s in range(size)))
    mean = lambda s: F.col(f"m{s}") / F.col("n_")
    spread = lambda s: F.sqrt(F.greatest(F.try_divide(F.col(f"q{s}") - F.col("n_") * mean(s) * mean(s), F.col("n_") - 1), F.lit(0.0)))
    scale = sums.select(*keys, *(mean(s).alias(f"m{s}") for s in range(size)), *(F.when(spread(s) > 1e-9 * F.greatest(F.abs(mean(s)), F.lit(1e-300)), spread(s)).otherwise(1.0).alias(f"s{s}") for s in range(size)))
    return rows.join(scale, keys).select(*(c for c in rows.columns if c not in {f"x{s}" for s in range(size)}), *(((F.col(f"x{s}") - F.col(f"m{s}")) / F.col(f"s{s}")).alias(f"x{s}") for s in range(size)))


def mode_weights(diffs: DataFrame, size: int) -> DataFrame:
    """season, mode, n, intercept, x0, x1, ...: the weights of a ridge logistic regression on each cohort's own scale, for cohorts of at least LEAST_GAMES maps."""
    counted = diffs.groupBy("season", "mode").agg(F.count(F.lit(1)).alias("games")).filter(F.col("games") >= LEAST_GAMES)
    enough = diffs.join(counted.drop("games"), ["season", "mode"], "left_semi")
    return _fitted(scaled(enough, ["season", "mode"], size), ["season", "mode"], size)


def _fitted(rows: DataFrame, keys: list[str], size: int, weight: str | None = None) -> DataFrame:
    y = F.col("won").cast("double") * (F.col(weight) if weight else F.lit(1.0))
    return logistic_by(rows.withColumn("y_", y), keys, [f"x{s}" for s in range(size)], "y_", 1.0, weight=weight)


#: Cohorts whose resampled weights are fitted together; their state, a few kilobytes a cohort, is sent to the tasks.
COHORTS_AT_ONCE = 500


def weight_intervals(diffs: DataFrame, size: int, replicates: int = 200, slaying: tuple[int, ...] = (0, 1)) -> DataFrame:
    """season, mode, draws, and low and high of each weight and of the ratio: 2.5 and 97.5 percentiles over resampled maps.

    A draw takes each map a Poisson(1) number of times, by its key, and is scaled and fitted anew. A round is one pass over the maps, whose tasks add up the sums of
    all draws of a cohort as arrays; the sums, and no maps, reach the driver, which moves the weights of up to COHORTS_AT_ONCE cohorts. Draws in which
    one side wins everything are left out. ratio: the mean size of the other weights by that of the slots in slaying (null where that is 0).
    """
    cohorts = [(r["season"], r["mode"]) for r in diffs.groupBy("season", "mode").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_GAMES).orderBy("season", "mode").collect()]
    kinds = dict(diffs.dtypes)
    names = [*(f"x{s}" for s in range(size)), "ratio"]
    rows = written(diffs.select("season", "mode", unit_number(F.col("game")).alias("u"), F.col("won").cast("double").alias("y"), *(F.col(f"x{s}").cast("double").alias(f"x{s}") for s in range(size))))
    out = []
    for block in (cohorts[i : i + COHORTS_AT_ONCE] for i in range(0, len(cohorts), COHORTS_AT_ONCE)):
        listed = diffs.sparkSession.createDataFrame([(*c, i) for i, c in enumerate(block)], f"season {kinds['season']}, mode {kinds['mode']}, c int")
        own = written(rows.join(F.broadcast(listed), ["season", "mode"]))
        fitted, usable = _drawn_weights(own, len(block), size, replicates)
        for i, (season, mode) in enumerate(block):
            w = fitted[i, usable[i], 1:]
            if len(w) < 2:
                continue
            slay = np.abs(w[:, list(slaying)]).mean(axis=1)
            others = [s for s in range(size) if s not in slaying]
            ratio = np.abs(w[:, others]).mean(axis=1)[slay > 0] / slay[slay > 0] if others else np.zeros(0)
            bounds = [float(v) for s in range(size) for v in np.percentile(w[:, s], [2.5, 97.5])]
            out.append((season, mode, len(w), *bounds, *(map(float, np.percentile(ratio, [2.5, 97.5])) if len(ratio) > 1 else (None, None))))
        forget(own)
    forget(rows)
    return diffs.sparkSession.createDataFrame(out, f"season {kinds['season']}, mode {kinds['mode']}, draws long, " + ", ".join(f"{n}_{end} double" for n in names for end in ("low", "high")))


def _drawn_weights(rows: DataFrame, cohorts: int, size: int, replicates: int, tol: float = 1e-9, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """By cohort and draw: intercept and weights, and whether the draw has maps of both results. rows: c, u, y, x0, ..."""
    numbered = np.arange(1, replicates + 1)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    def summed(width: int, sums: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """By cohort, sum and draw: what sums(cohort, copies, y, x) gives for the rows of a batch, added up."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                c, u, y, *x = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + size))
                x = np.stack(x, axis=1) if size else np.zeros((len(c), 0))
                for cohort in np.unique(c).tolist():
                    for at in np.array_split(np.flatnonzero(c == cohort), -(-int((c == cohort).sum()) // 512)):
                        found = sums(cohort, copies(u[at], numbered).astype(float), y[at], x[at])
                        total[cohort] = total.get(cohort, 0.0) + found
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))], ["c", "s"])

        made = rows.select("c", "u", "y", *(f"x{s}" for s in range(size))).mapInArrow(add, "c int, s array<double>")
        by_place = made.select("c", F.posexplode("s").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v"))
        whole = np.zeros((cohorts, width * replicates))
        for r in by_place.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).toLocalIterator():
            whole[r["c"]] = [v for _, v in r["s"]]
        return whole.reshape(cohorts, width, replicates)

    first = summed(2 + 2 * size, lambda c, w, y, x: np.concatenate([[w.sum(axis=0), y @ w], x.T @ w, (x * x).T @ w]))
    n = first[:, 0]
    usable = (first[:, 1] > 0) & (first[:, 1] < n)
    mean = first[:, 2 : 2 + size] / np.maximum(n, 1)[:, None]
    variance = (first[:, 2 + size :] - n[:, None] * mean**2) / np.maximum(n - 1, 1)[:, None]
    scale = np.where(variance > 1e-18 * np.maximum(mean**2, 1e-300), np.sqrt(np.maximum(variance, 0)), 1.0)
    beta = np.zeros((cohorts, replicates, size + 1))
    for _ in range(rounds):
        slope = beta[:, :, 1:].transpose(0, 2, 1) / scale
        level = beta[:, :, 0] - (slope * mean).sum(axis=1)

        def step(c: int, w: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
            p = 1 / (1 + np.exp(-(level[c] + x @ slope[c])))
            e, v = w * (y[:, None] - p), w * p * (1 - p)
            return np.concatenate([[e.sum(axis=0)], x.T @ e, [v.sum(axis=0)], x.T @ v, *([(x[:, i] * x[:, j]) @ v] for i, j in pairs)])

        s = summed(2 + 2 * size + len(pairs), step)
        e, ex, v, vx = s[:, 0], s[:, 1 : 1 + size], s[:, 1 + size], s[:, 2 + size : 2 + 2 * size]
        g, h = np.zeros(beta.shape), np.zeros((*beta.shape, size + 1))
        g[:, :, 0], h[:, :, 0, 0] = e, v
        g[:, :, 1:] = ((ex - mean * e[:, None]) / scale).transpose(0, 2, 1) - beta[:, :, 1:]
        h[:, :, 0, 1:] = h[:, :, 1:, 0] = ((vx - mean * v[:, None]) / scale).transpose(0, 2, 1)
        for k, (i, j) in enumerate(pairs):
            both = (s[:, 2 + 2 * size + k] - mean[:, i] * vx[:, j] - mean[:, j] * vx[:, i] + mean[:, i] * mean[:, j] * v) / (scale[:, i] * scale[:, j])
            h[:, :, i + 1, j + 1] = h[:, :, j + 1, i + 1] = both
        h[:, :, range(1, size + 1), range(1, size + 1)] += 1.0
        g[~usable] = 0.0
        if np.abs(g).max(initial=0.0) <= tol * max(1.0, float(n.max(initial=1.0))):
            return beta, usable
        h[~usable] = np.eye(size + 1)
        beta = beta + np.linalg.solve(h, g[..., None])[..., 0]
    raise ArithmeticError(f"weights of draws did not settle within {rounds} rounds")


def backtest_maps(diffs: DataFrame, size: int, order: DataFrame) -> DataFrame:
    """season, mode, game, event, won, p: each event's maps forecast from the same cohort's earlier events, scaled on those alone.

    order: event, place. Events without LEAST_GAMES earlier maps in the cohort are not forecast. The earlier maps are carried to each later event of their cohort, of
    which there are few, and all events are fitted side by side.
    """
    rows = written(diffs.join(F.broadcast(order), "event"))
    events = rows.select("season", "mode", F.col("place").alias("at")).distinct()
    past = rows.join(events, ["season", "mode"]).filter("place < at")
    enough = past.groupBy("season", "mode", "at").agg(F.count(F.lit(1)).alias("games")).filter(F.col("games") >= LEAST_GAMES).drop("games")
    past = written(past.join(enough, ["season", "mode", "at"], "left_semi"))
    keys = ["season", "mode", "at"]
    names = [f"x{s}" for s in range(size)]
    weights = _fitted(scaled(past, keys, size), keys, size).select(*keys, "intercept", *(F.col(x).alias(f"w_{x}") for x in names))
    moments = past.groupBy(*keys).agg(*(F.avg(x).alias(f"m_{x}") for x in names), *(F.stddev_samp(x).alias(f"s_{x}") for x in names))
    met = rows.withColumnRenamed("place", "at").join(weights, keys).join(moments, keys)
    z = lambda x: (F.col(x) - F.col(f"m_{x}")) / F.when(F.col(f"s_{x}") > 0, F.col(f"s_{x}")).otherwise(1.0)
    score = sum((F.col(f"w_{x}") * z(x) for x in names), F.col("intercept"))
    return met.select("season", "mode", "game", "event", "won", (1 / (1 + F.exp(-score))).alias("p"))


def sign_rules(diffs: DataFrame, size: int, forecasts: DataFrame) -> DataFrame:
    """season, mode, slot, n, accuracy, direction, model_accuracy: how well each column alone calls the forecast maps by the sign of its difference, beside the model.

    Maps on which a column ties have no say; a column that is wrong more often than right is read the other way (direction -1). A column as good as the model has leaked the result.
    """
    scored = diffs.join(forecasts.select("game", "season", "mode", "p"), ["season", "mode", "game"])
    each = scored.select("season", "mode", "won", F.inline(F.array(*(F.struct(F.lit(s).alias("slot"), F.col(f"x{s}").alias("x")) for s in range(size))))).filter("x <> 0")
    n, right = F.count(F.lit(1)), F.count_if((F.col("x") > 0) == F.col("won"))
    rules = each.groupBy("season", "mode", "slot").agg(n.alias("n"), (F.greatest(right, n - right) / n).alias("accuracy"), F.when(2 * right < n, -1).otherwise(1).alias("direction"))
    model = scored.groupBy("season", "mode").agg(F.avg(((F.col("p") > 0.5) == F.col("won")).cast("double")).alias("model_accuracy"))
    return rules.join(model, ["season", "mode"])


def player_ratings(given: DataFrame, weights: DataFrame, size: int) -> DataFrame:
    """season, mode (null: all modes), player, maps, score, k, rating.

    given: terms() of rows with player, a row a map; weights: mode_weights(). A profile is scaled by the mean and deviation of the cohort's players of at least QUALIFIED_MAPS maps,
    weighed, and scaled once more on the same players. Scores are shrunk by maps / (maps + k), k from the decomposition of the players' single maps; the
    rating over all modes weighs the shrunken scores by maps. Players with a denominator that is not above 0 over the season are left out, as are single
    maps with one from the decomposition; cohorts without weights or two qualified players have no ratings.
    """
    cohort = ["season", "mode"]
    names = [f"x{s}" for s in range(size)]
    of = lambda n, d: F.when(F.col(n).isNull(), 0.0).otherwise(F.when(F.col(d) > 0, F.col(n) / F.col(d)))
    totals = given.groupBy(*cohort, "player").agg(F.count(F.lit(1)).alias("maps"), *(F.sum(f"{p}{s}").alias(f"{p}{s}") for s in range(size) for p in "nd"))
    profiles = written(totals.select(*cohort, "player", "maps", *(of(f"n{s}", f"d{s}").alias(f"x{s}") for s in range(size))).dropna(subset=names))
    qualified = profiles.filter(F.col("maps") >= QUALIFIED_MAPS)
    scale = qualified.groupBy(*cohort).agg(F.count(F.lit(1)).alias("q"), *(F.avg(x).alias(f"m_{x}") for x in names), *(F.stddev_samp(x).alias(f"s_{x}") for x in names)).filter("q > 1").drop("q")
    model = scale.join(weights.select(*cohort, *(F.col(x).alias(f"w_{x}") for x in names)), cohort)
    z = lambda x: (F.col(x) - F.col(f"m_{x}")) / F.when(F.col(f"s_{x}") > 0, F.col(f"s_{x}")).otherwise(1.0)
    weighed = sum((F.col(f"w_{x}") * z(x) for x in names), F.lit(0.0))
    scores = written(profiles.join(F.broadcast(model), cohort).select(*cohort, "player", "maps", weighed.alias("score")))
    on = scores.filter(F.col("maps") >= QUALIFIED_MAPS).groupBy(*cohort).agg(F.avg("score").alias("mid"), F.stddev_samp("score").alias("sd"))
    single = given.select(*cohort, "player", *(of(f"n{s}", f"d{s}").alias(f"x{s}") for s in range(size))).dropna(subset=names).join(F.broadcast(model), cohort)
    k = hierarchy.components(single.select(*cohort, "player", weighed.alias("y")), cohort).select(*cohort, "k")
    kept = F.col("maps") / (F.col("maps") + F.col("k"))
    score = (F.col("score") - F.col("mid")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    shrunk = written(scores.join(on, cohort).join(k, cohort).select(*cohort, "player", "maps", score.alias("score"), "k", (score * kept).alias("shrunk")))
    own = shrunk.select(*cohort, "player", "maps", "score", "k", (1 + UNIT * F.col("shrunk")).alias("rating"))
    blend = shrunk.groupBy("season", "player").agg(F.sum("maps").alias("maps"), (1 + UNIT * F.sum(F.col("shrunk") * F.col("maps")) / F.sum("maps")).alias("rating"))
    none = F.lit(None)
    forget(profiles, scores)  # the result reads shrunk alone
    return own.unionByName(blend.select("season", none.cast(dict(own.dtypes)["mode"]).alias("mode"), "player", "maps", none.cast("double").alias("score"), none.cast("double").alias("k"), "rating"))
