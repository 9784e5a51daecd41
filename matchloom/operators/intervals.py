"""Interval and as-of joins as plans of equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "2999-12-31"


def within(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str) -> DataFrame:
    """The points that lie in a span of their keys, ends included; a null end is open. Spans' columns come along."""
    until = F.coalesce(F.col(end), F.lit(FOREVER).cast("date"))
    return points.join(spans, keys).filter((F.col(point) >= F.col(start)) & (F.col(point) <= until))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Pairs of spans (as a and b) of equal keys that have a day in common; null ends are open."""
    a, b, far = a.alias("a"), b.alias("b"), F.lit(FOREVER).cast("date")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    for c in (F.col(f"a.{start}") <= F.coalesce(F.col(f"b.{end}"), far), F.col(f"b.{start}") <= F.coalesce(F.col(f"a.{end}"), far)):
        same.append(c)
    return a.join(b, same)


def as_of(asked: DataFrame, steps: DataFrame, keys: list[str], at: str, tie: str, values: list[str]) -> DataFrame:
    """Each asked row with the values of the last step of its keys at or before its time; null if there is none.

    One shuffle by the keys: steps and asked rows stand in one stream, in which the last step's values are carried on.
    A step at the very time counts; of steps at one time the one with the largest tie counts.
    """
    packed = steps.select(*keys, at, F.lit(0).alias("__late"), F.col(tie).alias("__tie"), F.struct(*values).alias("__step"))
    rows = asked.select(*keys, at, F.lit(1).alias("__late"), F.col(tie).alias("__tie"), F.struct(*asked.columns).alias("__row"))
    stream = packed.unionByName(rows, allowMissingColumns=True)
    carried = F.last("__step", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at, "__late", "__tie").rowsBetween(Window.unboundedPreceding, 0))
    return stream.withColumn("__step", carried).filter("__late = 1").select("__row.*", "__step.*")
