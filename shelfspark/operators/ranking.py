"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.sizing import lookup
from shelfspark.session import cut


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rk") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1 (Spark limits every group before the shuffle)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def distributed_positions(df: DataFrame, group: list[str], order: list[Column], name: str = "rk", parts: int | None = None) -> DataFrame:
    """Every row's position from 1 within its group, where one group may be larger than a task can sort.

    Rows are range-partitioned by group and order, so a large group spans many partitions. A row's
    position is its number within its part of the group plus the sizes of the parts before, which are as
    many as there are partitions. ``order`` should be a total order, else equal rows can't be split.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_at", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    return numbered.join(starts, [*group, "_part"]).withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_at", "_before", "_part")


def running_total(df: DataFrame, order: list[Column], value: str, name: str, parts: int | None = None) -> DataFrame:
    """The sum of ``value`` over all rows before each in a total order, without sorting the table in one task.

    Works like ``distributed_positions``: a sum within each range of rows, plus the totals of the ranges
    before, which are as many as there are partitions.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    starts = totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lookup(ranged.withColumn("_own", own), cut(starts), ["_part"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")
