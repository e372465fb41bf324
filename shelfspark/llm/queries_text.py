"""Queries p7 to p10 (texts and documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.fertility import bands, fertility, outside
from shelfspark.llm.leaks import leaked_passages
from shelfspark.llm.packing import pack, token_counts
from shelfspark.llm.repetition import repetition
from shelfspark.llm.textform import plain_forms
from shelfspark.session import cut
from shelfspark.sources.tables import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of judgments.query and catalog.title that are not in plain form."""
    queries = plain_forms(table(spark, sf_dir, "judgments"), "example_id", "query", "judgments.query")
    titles = plain_forms(table(spark, sf_dir, "catalog"), "doc_id", "title", "catalog.title")
    return queries.unionByName(titles).select("src_field", "rec_key")


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text (or piece of a text) for each kind of container."""
    return pack(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a passage of a held-out item, and the items that leaked."""
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated text of every document."""
    return repetition(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at least three tenths of whose text repeats what they said before."""
    return p10_repetition(spark, sf_dir).where(F.col("repeated_share") >= 0.3).select("doc_id").distinct()


def p10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters per token, byte fallback and token entropy of every document, and what lies outside its script's band."""
    measured = cut(fertility(table(spark, sf_dir, "documents")))
    return outside(measured, cut(bands(measured)))


QUERIES = {"p7_found": p7_found, "p8_packing": p8_packing, "p9_found": p9_found, "p10_found": p10_found, "p10_repetition": p10_repetition, "p10_fertility": p10_fertility}
SQL: dict[str, str] = {}
