"""Forecasts of rounds from who is left, refitted event by event and never on their own rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.ratings import logistic_by
from matchloom.operators.scratch import written

#: Milliseconds of regulation, elapsed regulations that count at most, and what is added to a cell's wins and twice to its number.
REGULATION_MS, MOST_ELAPSED, LAPLACE = 90_000, 2.0, 0.5
#: The regressions' features.
SPECS = {
    "diff_only": ["diff"],
    "log_ratio_only": ["log_ratio"],
    "survivors": ["log_ratio", "diff"],
    "survivors_time": ["log_ratio", "diff", "log_ratio_elapsed", "diff_elapsed"],
    "survivors_bomb": ["log_ratio", "diff", "log_ratio_bomb", "diff_bomb"],
}


def features() -> dict[str, Column]:
    """All features, from own, other (players left) and time_ms."""
    ratio, diff = F.ln("own") - F.ln("other"), (F.col("own") - F.col("other")).cast("double")
    elapsed = F.least(F.greatest(F.col("time_ms") / REGULATION_MS, F.lit(0.0)), F.lit(MOST_ELAPSED))
    late = (F.col("time_ms") > REGULATION_MS).cast("double")
    return {"log_ratio": ratio, "diff": diff, "log_ratio_elapsed": ratio * elapsed, "diff_elapsed": diff * elapsed, "log_ratio_bomb": ratio * late, "diff_bomb": diff * late}


def walk_forward(states: DataFrame, l2: float = 1.0) -> DataFrame:
    """event, round, model, loss: the mean squared error over a round's states of each model, fitted on all earlier events.

    states: event (in order), round, own, other (both above zero), time_ms, won, from both sides. Models: SPECS, state_table, coin_flip. The first
    event is learnt from and not scored; a round's loss is one value, as its states are one observation seen at several instants.

    States with equal features are first counted by event, so that what is carried to the later events, of which there are few, is cells and
    not rows; all events of a model are fitted side by side.
    """
    rows = written(states.select("event", "round", "own", "other", F.col("won").cast("double").alias("y"), *(c.alias(n) for n, c in features().items())))
    later = written(rows.select(F.col("event").alias("at")).distinct())

    def before(cells: DataFrame) -> DataFrame:
        return cells.join(later, F.col("event") < F.col("at")).drop("event")

    met = rows
    for name, columns in SPECS.items():
        cells = rows.groupBy("event", *columns).agg(F.sum("y").alias("wins"), F.count(F.lit(1)).alias("n"))
        past = before(cells).groupBy("at", *columns).agg(F.sum("wins").alias("wins"), F.sum("n").alias("times"))
        weights = logistic_by(past, ["at"], columns, "wins", l2, weight="times")
        met = met.join(F.broadcast(weights.select(F.col("at").alias("event"), F.struct("intercept", *columns).alias(f"w_{name}"))), "event", "left")
    counted = rows.groupBy("event", "own", "other").agg(F.sum("y").alias("wins"), F.count(F.lit(1)).alias("n"))
    table = before(counted).groupBy(F.col("at").alias("event"), "own", "other").agg(((F.sum("wins") + LAPLACE) / (F.sum("n") + 2 * LAPLACE)).alias("seen"))
    first = later.agg(F.min("at").alias("event"))
    met = met.join(table, ["event", "own", "other"], "left").join(F.broadcast(first), "event", "left_anti")
    chance = {name: 1 / (1 + F.exp(-sum((F.col(f"w_{name}.{c}") * F.col(c) for c in columns), F.col(f"w_{name}.intercept")))) for name, columns in SPECS.items()}
    chance |= {"state_table": F.coalesce("seen", F.lit(0.5)), "coin_flip": F.lit(0.5)}
    losses = met.groupBy("event", "round").agg(*(F.avg((p - F.col("y")) * (p - F.col("y"))).alias(name) for name, p in chance.items()))
    return losses.select("event", "round", F.explode(F.map_from_arrays(F.array(*map(F.lit, chance)), F.array(*chance))).alias("model", "loss"))


def gaps(losses: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """event, round, a, b, gap: the loss of one model less another's, for each pair."""
    by_round = losses.groupBy("event", "round").agg(F.map_from_entries(F.collect_list(F.struct("model", "loss"))).alias("of"))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))).alias("pair")
    return by_round.select("event", "round", "of", each).select("event", "round", "pair.a", "pair.b", (F.col("of")[F.col("pair.a")] - F.col("of")[F.col("pair.b")]).alias("gap"))
