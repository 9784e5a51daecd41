"""Two-level normal models of scores: true scores spread between players, maps spread around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.scratch import forget, written

#: The least share of the observed spread to start from, the spread below which a share of the mean variance counts
#: as none, and the maps at which half of a score is kept where a cohort supports no estimate.
START_SHARE, COLLAPSED_SHARE, FALLBACK_MAPS = 0.01, 0.01, 15.0
#: Rounds without agreement after which the fit is an error.
MOST_ROUNDS = 500


def spread(means: DataFrame, cohort: list[str], tol: float = 1e-10) -> DataFrame:
    """cohort, n, mu, tau2, rounds: maximum likelihood of mean ~ Normal(mu, tau2 + variance), for each cohort of rows (mean, variance).

    A round is one aggregate over the rows of the cohorts that have not settled, and takes a step of Fisher's scoring (whose
    fixed points are those of the EM algorithm), of a factor of ten at most. Where the likelihood falls all the way down, tau2 thus
    shrinks until it is below any effect (1e-9 of the mean variance), and then is 0. A cohort leaves the rounds when a step
    changes its tau2 by at most the share tol. Null keys are a cohort. One row: tau2 is 0.
    """
    keys = [F.col(k) for k in cohort]
    given = means.select(F.struct(*keys).alias("key"), F.col("mean").cast("double").alias("x"), F.col("variance").cast("double").alias("v"))
    observed = F.coalesce(F.var_samp("x"), F.lit(0.0))
    start = F.greatest(observed - F.avg("v"), START_SHARE * observed, F.lit(1e-300))
    n = F.count(F.lit(1))
    live = written(given.groupBy("key").agg(n.alias("n"), F.avg("x").alias("middle"), F.when(n > 1, start).otherwise(0.0).alias("tau2"), F.avg("v").alias("mean_v"), F.lit(0.0).alias("mu"), F.lit(0).alias("rounds")))
    centres = live.select(F.col("key").alias("of"), "middle")
    rows = written(given.join(centres, F.col("key").eqNullSafe(F.col("of"))).select("key", (F.col("x") - F.col("middle")).alias("x"), "v"))
    done = [live.filter("n < 2").select("key", "n", "mu", "tau2", "rounds")]
    live = live.filter("n > 1")
    for _ in range(MOST_ROUNDS):
        if live.isEmpty():
            break
        met = rows.join(live.drop("mu", "middle").withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of"))).withColumn("w", 1 / (F.col("tau2") + F.col("v")))
        x, w = F.col("x"), F.col("w")
        sums = met.groupBy("key", "n", "tau2", "mean_v", "rounds").agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * w).alias("ww"), F.sum(w * w * x).alias("wwx"), F.sum(w * w * x * x).alias("wwxx"))
        mu, t = F.col("wx") / F.col("w"), F.col("tau2")
        slope = F.col("wwxx") - 2 * mu * F.col("wwx") + mu * mu * F.col("ww") - F.col("w")
        step = F.least(F.greatest(t + slope / F.col("ww"), t / 10), 10 * t)
        new = F.when(t <= 1e-9 * F.col("mean_v"), 0.0).otherwise(step)
        moved = written(sums.select("key", "n", mu.alias("mu"), "mean_v", (F.col("rounds") + 1).alias("rounds"), t.alias("old"), new.alias("tau2")))
        settled = (F.abs(F.col("tau2") - F.col("old")) <= tol * F.col("old")) | (F.col("tau2") == 0)
        done.append(moved.filter(settled).select("key", "n", "mu", "tau2", "rounds"))
        live = moved.filter(~settled)
    else:
        raise ArithmeticError(f"cohorts without a settled spread after {MOST_ROUNDS} rounds")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = out.join(centres, F.col("key").eqNullSafe(F.col("of"))).select("key", "n", (F.col("mu") + F.col("middle")).alias("mu"), "tau2", "rounds")
    out = written(out)
    forget(rows)
    return out.select("key.*", "n", "mu", "tau2", "rounds")


def same(a: str, b: str, keys: list[str]) -> Column:
    """Rows of aliases a and b agree in the keys, nulls together."""
    found = F.lit(True)
    for k in keys:
        found = found & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return found


def components(scores: DataFrame, cohort: list[str]) -> DataFrame:
    """cohort, players, maps, within, between, k, estimated: the one-way decomposition of map scores for players as groups.

    scores: cohort, player, y, a row a map. within is the pooled variance around the players' means; between is what their means'
    spread leaves beyond it, by the effective number of maps of unequal groups; k = within / between is the number of maps at which half of a score
    is kept. Cohorts of one player, without repeated maps, or with a spread not above zero have FALLBACK_MAPS and are not estimated.
    """
    y = F.col("y").cast("double")
    of_player = scores.groupBy(*cohort, "player").agg(F.count(F.lit(1)).alias("m"), F.avg(y).alias("mean"), (F.coalesce(F.var_samp(y), F.lit(0.0)) * (F.count(F.lit(1)) - 1)).alias("ss"))
    m, mean = F.col("m"), F.col("mean")
    sums = of_player.groupBy(*cohort).agg(
        F.count(F.lit(1)).alias("players"), F.sum(m).alias("maps"), F.sum("ss").alias("ss"), F.sum(m * m).alias("mm"), F.avg(mean).alias("middle"), F.sum(m * mean).alias("mx"), F.sum(m * mean * mean).alias("mxx")
    )
    n, total = F.col("players"), F.col("maps")
    spread_ = F.col("mxx") - F.col("mx") * F.col("mx") / total  # the maps-weighted squares of means around the grand mean
    within = F.try_divide(F.col("ss"), total - n)
    effective = F.try_divide(total - F.col("mm") / total, n - 1)
    between = F.try_divide(F.try_divide(spread_, n - 1) - within, effective)
    usable = (n >= 2) & (total > n) & (between > 0)
    return sums.select(
        *cohort, "players", "maps", F.coalesce(within, F.lit(0.0)).alias("within"), F.coalesce(between, F.lit(0.0)).alias("between"),
        F.when(usable, within / between).otherwise(FALLBACK_MAPS).alias("k"), F.coalesce(usable, F.lit(False)).alias("estimated"),
    )


def posterior_ratings(scores: DataFrame, cohort: list[str], origin: Column | None = None) -> DataFrame:
    """cohort, player, maps, score, z, sd, shrinkage, collapsed, estimated: the players' true scores by the two-level model.

    scores: cohort, player, y, a row a map. A player's score is the mean over maps and varies by the pooled variance of maps over
    their number; spread() fits the rest. z is the posterior mean in units of the true spread, from the cohort's origin (the mean of
    the players for whom the condition holds, of all by default); sd its deviation in the same units. collapsed: the true
    spread is at most COLLAPSED_SHARE of what a season of the mean number of maps varies by, so the players cannot be told apart. A cohort without repeated maps keeps
    FALLBACK_MAPS as its ratio and is not estimated; a cohort of one player is left out.
    """
    of_player = written(scores.groupBy(*cohort, "player").agg(F.count(F.lit(1)).alias("maps"), F.avg(F.col("y").cast("double")).alias("score")))
    parts = components(scores, cohort).filter("players > 1").select(*cohort, "players", F.col("maps").alias("all_maps"), "within")
    rows = written(of_player.alias("p").join(parts.alias("c"), same("p", "c", cohort)).select("p.*", "c.players", "c.all_maps", "c.within"))
    fitted = spread(rows.filter("within > 0").select(*cohort, F.col("score").alias("mean"), (F.col("within") / F.col("maps")).alias("variance")), cohort)
    flat = rows.filter("within <= 0").groupBy(*cohort).agg(F.avg("score").alias("mu"), F.var_pop("score").alias("around"), F.avg(1 / F.col("maps")).alias("inverse"))
    asserted = F.greatest(F.col("around") / (1 + FALLBACK_MAPS * F.col("inverse")), F.lit(1e-12))
    models = fitted.select(*cohort, "mu", "tau2", F.lit(None).cast("double").alias("asserted")).unionByName(flat.select(*cohort, "mu", asserted.alias("tau2"), (FALLBACK_MAPS * asserted).alias("asserted")))
    counted = origin if origin is not None else F.lit(True)
    origins = rows.groupBy(*cohort).agg(F.coalesce(F.avg(F.when(counted, F.col("score"))), F.avg("score")).alias("origin"))
    met = rows.alias("p").join(models.alias("c"), same("p", "c", cohort)).select("p.*", "c.mu", "c.tau2", "c.asserted")
    met = met.alias("p").join(origins.alias("c"), same("p", "c", cohort)).select("p.*", "c.origin")
    sigma2 = F.coalesce("asserted", "within")
    v = sigma2 / F.col("maps")
    kept = F.col("tau2") / (F.col("tau2") + v)
    unit = F.when(F.col("tau2") > 0, F.sqrt("tau2")).otherwise(1.0)
    mean = F.col("mu") + kept * (F.col("score") - F.col("mu"))
    around = F.col("tau2") <= COLLAPSED_SHARE * F.col("within") / F.greatest(F.col("all_maps") / F.col("players"), F.lit(1.0))
    return met.select(
        *cohort, "player", "maps", "score", ((mean - F.col("origin")) / unit).alias("z"), (F.sqrt(kept * v) / unit).alias("sd"), kept.alias("shrinkage"), (F.col("asserted").isNull() & around).alias("collapsed"), F.col("asserted").isNull().alias("estimated")
    )
