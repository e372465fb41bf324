"""Deterministic samples by hashed order, the same in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.evaluation import uniform
from shelfspark.operators.ranking import distributed_positions, running_total
from shelfspark.operators.sizing import lookup
from shelfspark.session import cut

#: Ranges into which cumulated weights are cut, so that draws meet them in an equi-join.
RANGES = 1024


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows in the order of the md5 of key and seed (a sampling operator)."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), F.col(key)).limit(n)


def stratified(df: DataFrame, key: str, stratum: str, n: int, least: int = 5) -> DataFrame:
    """About ``n`` rows in proportion to the strata, but at least ``least`` of each (a sampling operator)."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), F.col(key))
    total = df.count()
    sized = df.withColumn("_rn", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(stratum)))
    return sized.where(F.col("_rn") <= F.greatest(F.lit(float(least)), F.lit(float(n)) * F.col("_n") / F.lit(max(total, 1)))).drop("_rn", "_n")


def weighted_sample(df: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """``n`` rows without replacement with odds by weight: the largest keys ln(u) / w (a sampling operator)."""
    u = F.greatest(uniform(key, F.lit("weighted")), F.lit(1e-12))
    return df.where(F.col(weight) > 0).orderBy(F.desc(F.round(F.ln(u) / F.col(weight), 9)), F.col(key)).limit(n)


def weighted_draws(df: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """``draw`` (from 1) and ``key``: ``n`` draws with replacement with odds by a whole-number weight (a sampling operator).

    A draw is a place on the weights laid end to end in the order of ``key``. Places and weights are cut into ranges
    and meet range by range. Null keys and weights that are null or not positive are never drawn.
    """
    some = df.where((F.col(weight) > 0) & F.col(key).isNotNull()).select(key, F.col(weight).cast("long").alias("_w"))
    laid = cut(running_total(some, [F.col(key)], "_w", "_lo").select(key, F.col("_lo").cast("long").alias("_lo"), (F.col("_lo") + F.col("_w")).cast("long").alias("_hi")))
    total = laid.agg(F.max("_hi")).first()[0] or 0
    width = max(1, -(-total // RANGES))
    wide = laid.withColumn("_r", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))))
    draws = df.sparkSession.range(1, n + 1 if total else 1).select(F.col("id").alias("draw"), F.floor(uniform("id", F.lit("draws")) * total).alias("_at")).withColumn("_r", F.floor(F.col("_at") / width))
    return draws.join(wide, "_r").where((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))).select("draw", key)


def quantile_map(rows: DataFrame, group: str, u: str, sample: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``value``: the empirical quantile at ``u`` of the group's sample, between neighbours in a straight line.

    The sample is numbered by a distributed sort, so a group may be of any size. Rows whose group has no sample, and
    nulls, come out without a value.
    """
    some = sample.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, F.col(value).cast("double").alias("_x"))
    at = cut(distributed_positions(some, [group], [F.col("_x")], "_i").select(group, "_i", "_x"))
    sizes = cut(at.groupBy(group).agg(F.count(F.lit(1)).alias("_n")))
    placed = lookup(rows, sizes, [group], "left").withColumn("_h", F.col(u) * (F.col("_n") - 1))
    placed = placed.withColumn("_lo", F.floor("_h") + 1).withColumn("_up", F.least(F.floor("_h") + 2, F.col("_n")))
    for end in ("_lo", "_up"):
        placed = lookup(placed, at.select(group, F.col("_i").alias(end), F.col("_x").alias(f"{end}_x")), [group, end], "left")
    return placed.withColumn("value", F.col("_lo_x") + (F.col("_h") - F.floor("_h")) * (F.col("_up_x") - F.col("_lo_x"))).drop("_n", "_h", "_lo", "_up", "_lo_x", "_up_x")
