"""Quality gates: hard checks must find no rows, soft checks count them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    name: str
    failing: Callable[[dict[str, DataFrame]], DataFrame]
    hard: bool = True


def negative(table: str, columns: list[str]) -> Callable[[dict[str, DataFrame]], DataFrame]:
    return lambda t: t[table].filter(reduce(lambda a, b: a | b, (F.col(c) < 0 for c in columns)))


def duplicated(table: str, keys: list[str]) -> Callable[[dict[str, DataFrame]], DataFrame]:
    return lambda t: t[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphaned(table: str, key: str, other: str, other_key: str) -> Callable[[dict[str, DataFrame]], DataFrame]:
    return lambda t: t[table].filter(F.col(key).isNotNull()).join(t[other].select(F.col(other_key).alias(key)), key, "left_anti")


def unaccepted(table: str, column: str, values: list[str]) -> Callable[[dict[str, DataFrame]], DataFrame]:
    return lambda t: t[table].filter(~F.col(column).isin(*values))


def report(checks: list[Check], tables: dict[str, DataFrame]) -> DataFrame:
    """check_name, hard, failing: one row per check, counted in one job."""
    counts = [c.failing(tables).agg(F.count(F.lit(1)).alias("failing")).select(F.lit(c.name).alias("check_name"), F.lit(c.hard).alias("hard"), "failing") for c in checks]
    return reduce(DataFrame.unionByName, counts)


def gate(counts: DataFrame) -> DataFrame:
    """passes, failed: whether no hard check of a report() found anything, and the names of those that did."""
    broken = F.col("hard") & (F.col("failing") > 0)
    return counts.agg((F.count_if(broken) == 0).alias("passes"), F.array_join(F.array_sort(F.collect_list(F.when(broken, F.col("check_name")))), ",").alias("failed"))


def identity_candidates(names: DataFrame) -> DataFrame:
    """a, b, reason: pairs of players whose handles are equal but for case and marks, or one edit apart.

    names: player, handle. Keys that are one edit apart share a key or what is left of it without one letter, so only keys
    that meet in these are compared; keys are compared once, whatever the number of players that have them.
    """
    from matchloom.functions.values import handle_key

    keyed = names.select("player", handle_key(F.col("handle")).alias("key")).filter("key <> ''").distinct()
    shorter = F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.concat(F.substr(F.col("key"), F.lit(1), i - 1), F.substr(F.col("key"), i + 1)))
    near = keyed.select("key").distinct().select("key", F.explode(F.array_distinct(F.array_append(shorter, F.col("key")))).alias("at"))
    a, b = near.withColumnRenamed("key", "ka"), near.withColumnRenamed("key", "kb")
    keys = a.join(b, "at").select("ka", "kb").distinct().filter(F.levenshtein("ka", "kb") <= 1)
    pairs = keys.join(keyed.select(F.col("player").alias("a"), F.col("key").alias("ka")), "ka").join(keyed.select(F.col("player").alias("b"), F.col("key").alias("kb")), "kb").filter("a < b")
    return pairs.select("a", "b", F.when(F.col("ka") == F.col("kb"), "same key").otherwise("one edit").alias("reason"))
