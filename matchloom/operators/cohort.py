"""Scores of values against their qualified cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Qualified members that a cohort needs for z scores.
LEAST_FOR_Z = 15
#: A deviation up to which equal values may come when the sums of tasks are combined.
NO_SPREAD = 1e-9


def scored(values: DataFrame, cohort: list[str], least_for_z: int = LEAST_FOR_Z) -> DataFrame:
    """Adds z and pctl to rows with value and qualified.

    Both are measured on the cohort's qualified rows and given to every row: z by their mean and sample deviation (null
    if fewer than least_for_z), pctl as the share of them at or below the value. A cohort with fewer than two
    qualified rows or without spread gets neither. Null cohort keys (all modes) are cohorts of their own.
    """
    own = F.when(F.col("qualified"), F.col("value"))
    whole = Window.partitionBy(*cohort)
    upto = whole.orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    n, mean, spread = F.count(own).over(whole), F.avg(own).over(whole), F.stddev_samp(own).over(whole)
    usable = (n >= 2) & (spread > 0)
    return values.withColumns({
        "z": F.when(usable & (n >= least_for_z), (F.col("value") - mean) / spread),
        "pctl": F.when(usable, F.count(own).over(upto) / n),
    })


def best_scores(values: DataFrame, cohort: list[str], least_for_z: int = LEAST_FOR_Z) -> DataFrame:
    """cohort, n, scored, best: the rows of each cohort, those to which scored() gives a z, and their largest z.

    z rises with the value, so the largest value has the largest z: one aggregate, which combines before its rows are moved. Deviations of NO_SPREAD are none.
    """
    own = F.when(F.col("qualified"), F.col("value"))
    sums = values.groupBy(*cohort).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("__v"), F.count(own).alias("__q"), F.avg(own).alias("__m"), F.stddev_samp(own).alias("__s"), F.max("value").alias("__top"))
    usable = (F.col("__q") >= max(2, least_for_z)) & (F.col("__s") > NO_SPREAD)
    return sums.select(*cohort, "n", F.when(usable, F.col("__v")).otherwise(0).alias("scored"), F.when(usable, (F.col("__top") - F.col("__m")) / F.col("__s")).alias("best"))
