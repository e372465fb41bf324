"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.plans import gate, graphs, learned, matching, relational, rows, search, streams, units

FLAGSHIP = "bm25_topk"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**search.QUERIES, **graphs.QUERIES, **learned.QUERIES, **matching.QUERIES, **relational.QUERIES, **rows.QUERIES, **streams.QUERIES, **gate.QUERIES, **units.QUERIES}
SQL: dict[str, str] = {**search.SQL, **graphs.SQL, **learned.SQL, **matching.SQL, **relational.SQL, **rows.SQL, **streams.SQL, **gate.SQL, **units.SQL}
