"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` (one file or one directory ``name.parquet``)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def subset(df: DataFrame, names: list[str]) -> DataFrame:
    """Of the wanted columns those the table has, in the wanted order."""
    return df.select(*[n for n in names if n in df.columns])
