"""Joins that look at sizes first: a broadcast behind a count of rows and bytes, measured hot keys split beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes (as text) up to which a lookup table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 16 << 20
#: Rows of one key that stay together in a task.
HOT_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows of at most ``size`` bytes in all; the bytes are summed only if the rows are few."""
    if df.count() > rows:
        return False
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= size


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores: a small file is read by one task, which costly work should not wait for. For scans (the number of tasks behind a shuffle is known only when it has run)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lookup(rows: DataFrame, mapping: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS, hot: int = HOT_ROWS, count: str | None = None) -> DataFrame:
    """``rows`` joined to ``mapping``, whatever share of ``rows`` one key holds.

    A small mapping (``limit`` rows, ``BROADCAST_BYTES``) is broadcast. Else both sides are shuffled by the key; keys that
    have more than ``hot`` rows, which are counted, are split over as many tasks as that takes, and only for
    those keys the mapping is repeated. ``mapping`` should be materialised, as it is counted first. Where it has the
    number of ``rows`` of each key, ``count`` names that column and ``rows`` aren't counted again.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup keeps the rows' side: {how}")
    if small(mapping, limit):
        return rows.join(F.broadcast(mapping), on, how)
    counts = mapping.select(*on, F.col(count).alias("_n")) if count else rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    split = counts.where(F.col("_n") > hot).select(*on, F.ceil(F.col("_n") / hot).cast("int").alias("_parts"))
    # at most one key in ``hot`` rows is split, so there are few of them
    found = [r.asDict() for r in split.limit(BROADCAST_ROWS + 1).collect()]
    if not found or len(found) > BROADCAST_ROWS:
        return rows.join(mapping, on, how)
    parts = rows.sparkSession.createDataFrame([tuple(r[c] for c in (*on, "_parts")) for r in found], split.schema)
    spread = F.coalesce("_parts", F.lit(1))
    salted = mapping.join(F.broadcast(parts), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), spread - 1))).drop("_parts")
    mixed = rows.join(F.broadcast(parts), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), spread).cast("int")).drop("_parts")
    return mixed.join(salted, [*on, "_salt"], how).drop("_salt")
