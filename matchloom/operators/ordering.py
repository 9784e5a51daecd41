"""Global numbering without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.scratch import written


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds each row's place, from 1, in the order of the keys.

    Rows are range-partitioned and numbered in their partition; the counts of the partitions before it, one row per
    partition, are then added. The dealt rows are written first: range bounds come from samples, so a partition that was
    dealt anew could differ.
    """
    dealt = written(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part").orderBy(*keys)
    placed = dealt.withColumn("__own", F.row_number().over(own))
    ends = placed.groupBy("__part").agg(F.max("__own").alias("__n"))
    before = ends.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__part", "__own", "__before")


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the rank of a column's value among all rows, ties sharing their mean rank.

    Equal values are counted first; only one row per value is numbered, over range partitions.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__c"))
    dealt = written(counts.repartitionByRange(column).withColumn("__part", F.spark_partition_id()))
    own = dealt.withColumn("__upto", F.sum("__c").over(Window.partitionBy("__part").orderBy(column)))
    ends = own.groupBy("__part").agg(F.max("__upto").alias("__n"))
    before = ends.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    placed = own.join(F.broadcast(before), "__part")
    ranks = placed.select(column, (F.col("__before") + F.col("__upto") - (F.col("__c") - 1) / 2.0).alias(name))
    return df.join(ranks, column)
