"""All queries of the subpackage and the SQL of those that have one."""

from __future__ import annotations

from shelfspark.llm import queries_tables, queries_text

QUERIES = {**queries_tables.QUERIES, **queries_text.QUERIES}
SQL = {**queries_tables.SQL, **queries_text.SQL}
