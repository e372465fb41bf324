"""Query p4 (quantities in common units)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.changepoints import unit_shifts
from shelfspark.operators.units import common_units, quantities
from shelfspark.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quantity of the catalog's measures and dimensions and of the queries' measures."""
    catalog = table(spark, sf_dir, "catalog")
    parsed = table(spark, sf_dir, "parsed_queries").withColumn("_measures", F.try_element_at("attrs", F.lit("measures")))
    parts = [
        common_units(catalog, "doc_id", "locale", "attr_measures", ["title", "doc_text"], "catalog.attr_measures"),
        common_units(catalog, "doc_id", "locale", "attr_dimensions", ["title", "doc_text"], "catalog.attr_dimensions", dimension=True),
        common_units(parsed, "query_id", "locale", "_measures", ["text"], "parsed_queries.attrs.measures"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def typed_numbers(catalog: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` (the seller), ``day``, ``quantity`` and the number as typed of each measure, whatever its unit."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, seller, day, locale, entries in zip(b["doc_id"], b["seller"], b["day"], b["locale"], b["attr_measures"]):
                for i, entry in enumerate(entries):
                    out += [(doc, seller, day, i, q, float(v)) for v, q, *_ in quantities(entry or "", locale == "es") if q]
            yield pd.DataFrame(out, columns=["doc_id", "source", "day", "entry_no", "quantity", "value"])

    rows = catalog.where(F.size("attr_measures") > 0).select("doc_id", "seller", F.to_date("updated_at").alias("day"), "locale", "attr_measures")
    return rows.mapInPandas(read, "doc_id string, source string, day date, entry_no long, quantity string, value double")


def p4_changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level shifts in each seller's history of each quantity, numbers as typed, and the factors between units that explain them."""
    return unit_shifts(typed_numbers(table(spark, sf_dir, "catalog")))


QUERIES = {"p4_found": p4_found, "p4_changepoints": p4_changepoints}
SQL: dict[str, str] = {}
