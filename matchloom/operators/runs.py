"""Runs of models: publishing by run, the latest run, pruning, differences between published surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed tolerances within which two published numbers are the same.
RELATIVE, ABSOLUTE = 1e-6, 1e-9


def publish(df: DataFrame, path: str, model: str, version: str, through: str) -> None:
    """Writes a run's rows; a second run of the same model, version and date replaces the first, others stay."""
    run = df.withColumns({"model": F.lit(model), "version": F.lit(version), "through": F.lit(through)})
    run.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "version", "through").parquet(path)


def latest(runs: DataFrame, by: str = "model") -> DataFrame:
    """The newest run of each model: by created_at, then id."""
    best = F.max_by(F.struct(*runs.columns), F.struct("created_at", "id"))
    return runs.groupBy(by).agg(best.alias("r")).select("r.*")


def pruned(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Results without those of superseded runs; results of models that no run names stay."""
    keep = latest(runs).select("id", "model")
    old = runs.join(keep, ["id", "model"], "left_anti").select(F.col("id").alias("run_id"))
    return results.join(old, "run_id", "left_anti")


def upserted(current: DataFrame, incoming: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """One row per key: that of the source with the lowest rank, incoming before current where ranks are equal."""
    both = current.withColumn("__new", F.lit(1)).unionByName(incoming.withColumn("__new", F.lit(0)), allowMissingColumns=True)
    best = F.min_by(F.struct(*current.columns), F.struct(rank, "__new"))
    return both.groupBy(*keys).agg(best.alias("r")).select("r.*")


def long_numbers(df: DataFrame, keys: list[str], numbers: list[str], surface: str) -> DataFrame:
    """path, value: every number of a result table under a path of its natural keys."""
    path = F.concat_ws("/", F.lit(surface), *(F.coalesce(F.col(k).cast("string"), F.lit("all")) for k in keys))
    doubled = df.select(path.alias("p"), *(F.col(c).cast("double").alias(c) for c in numbers))
    return doubled.unpivot("p", numbers, "name", "value").filter("value is not null").select(F.concat_ws("/", "p", "name").alias("path"), "value")


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, before, after, verdict (added, removed, flipped, moved, same) of two snapshots (path, value)."""
    both = old.select("path", F.col("value").alias("before")).join(new.select("path", F.col("value").alias("after")), "path", "full_outer")
    near = F.abs(F.col("after") - F.col("before")) <= F.greatest(F.lit(ABSOLUTE), RELATIVE * F.greatest(F.abs("before"), F.abs("after")))
    verdict = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(near, "same").when(F.signum("before") * F.signum("after") < 0, "flipped").otherwise("moved")
    return both.withColumn("verdict", verdict)


def artifact(artifacts: DataFrame, runs: DataFrame, name: str) -> DataFrame:
    """model, run_id, payload: the artifact of that name of each model's newest run that has one (artifacts: run_id, name, payload)."""
    held = artifacts.filter(F.col("name") == name).join(runs.select(F.col("id").alias("run_id"), "model", "created_at"), "run_id")
    best = F.max_by(F.struct("run_id", "payload"), F.struct("created_at", "run_id"))
    return held.groupBy("model").agg(best.alias("r")).select("model", "r.*")


def last_two(runs: DataFrame) -> DataFrame:
    """model, latest, previous: ids of each model's two newest runs."""
    n = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("created_at"), F.desc("id")))
    top = runs.select("model", "id", n.alias("n")).filter("n <= 2")
    return top.groupBy("model").agg(F.max(F.when(F.col("n") == 1, F.col("id"))).alias("latest"), F.max(F.when(F.col("n") == 2, F.col("id"))).alias("previous"))
