"""Query: the validation gate. Each check is one value and a condition on it, in SQL both engines read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.plans import graphs
from shelfspark.sources.tables import table

# name: (value, condition on v). Tables stand in braces.
CHECKS = {
    "catalog_not_empty": ("SELECT count(*) AS v FROM {catalog}", "v > 0"),
    "catalog_doc_id_unique": ("SELECT count(*) - count(DISTINCT doc_id) AS v FROM {catalog}", "v = 0"),
    "catalog_titles_present": ("SELECT sum(CASE WHEN title IS NULL OR title = '' THEN 1 ELSE 0 END) AS v FROM {catalog}", "v < 100"),
    "catalog_category_coverage": ("SELECT avg(CASE WHEN category <> 'Unknown' THEN 1e0 ELSE 0e0 END) AS v FROM {catalog}", "v > 0.4"),
    "catalog_id_has_locale": ("SELECT sum(CASE WHEN doc_id <> concat(locale, ':', product_id) THEN 1 ELSE 0 END) AS v FROM {catalog}", "v = 0"),
    "catalog_lengths_right": ("SELECT sum(CASE WHEN n_title_chars <> length(title) THEN 1 ELSE 0 END) AS v FROM {catalog}", "v = 0"),
    "title_only_has_no_more": ("SELECT sum(CASE WHEN is_title_only AND richness_chars > 0 THEN 1 ELSE 0 END) AS v FROM {catalog}", "v = 0"),
    "judgments_example_unique": ("SELECT (SELECT count(*) FROM (SELECT DISTINCT example_id, query_id, doc_id, split FROM {judgments}) a) - (SELECT count(DISTINCT example_id) FROM {judgments}) AS v", "v = 0"),
    "judgments_redelivered_share": ("SELECT 1e0 - count(DISTINCT example_id) * 1e0 / count(*) AS v FROM {judgments}", "v < 0.05"),
    "judgments_docs_in_catalog": ("SELECT count(*) AS v FROM {judgments} j WHERE NOT EXISTS (SELECT 1 FROM {catalog} c WHERE c.doc_id = j.doc_id)", "v = 0"),
    "judgments_queries_known": ("SELECT count(*) AS v FROM {judgments} j WHERE NOT EXISTS (SELECT 1 FROM {queries} q WHERE q.query_id = j.query_id)", "v = 0"),
    "no_query_in_two_splits": ("SELECT count(*) AS v FROM (SELECT query_id FROM {judgments} GROUP BY query_id HAVING count(DISTINCT split) > 1) a", "v = 0"),
    "splits_as_in_queries": ("SELECT count(*) AS v FROM {judgments} j JOIN {queries} q ON q.query_id = j.query_id WHERE q.split <> j.split", "v = 0"),
    "dev_share": ("SELECT min(f) AS v FROM (SELECT locale, avg(CASE WHEN split = 'dev' THEN 1e0 ELSE 0e0 END) AS f FROM {queries} WHERE split IN ('train', 'dev') GROUP BY locale) a", "v > 0.02 AND v < 0.3"),
    "gain_follows_label": ("SELECT sum(CASE WHEN gain <> CASE esci_label WHEN 'E' THEN 1.0 WHEN 'S' THEN 0.1 WHEN 'C' THEN 0.01 ELSE 0.0 END THEN 1 ELSE 0 END) AS v FROM {judgments}", "v = 0"),
    "gain_needs_label": ("SELECT sum(CASE WHEN esci_label IS NULL AND gain IS NOT NULL THEN 1 ELSE 0 END) AS v FROM {judgments}", "v = 0"),
    "ingested_after_judged": ("SELECT sum(CASE WHEN ingested_at < judged_at THEN 1 ELSE 0 END) AS v FROM {judgments}", "v = 0"),
    "one_row_per_query": ("SELECT count(*) - count(DISTINCT query_id) AS v FROM {queries}", "v = 0"),
    "exact_counts_right": ("SELECT count(*) AS v FROM {queries} q JOIN (SELECT query_id, count(DISTINCT example_id) AS n FROM {judgments} WHERE esci_label = 'E' GROUP BY query_id) e ON e.query_id = q.query_id WHERE e.n > q.n_e", "v = 0"),
    "slices_not_degenerate": ("SELECT avg(CASE WHEN slice_spec THEN 1e0 ELSE 0e0 END) AS v FROM {queries}", "v > 0.005 AND v < 0.8"),
    "graph_no_self_edges": ("SELECT count(*) AS v FROM {edges} WHERE src_doc = dst_doc", "v = 0"),
    "graph_edges_in_catalog": ("SELECT count(*) AS v FROM {edges} e WHERE NOT EXISTS (SELECT 1 FROM {catalog} c WHERE c.doc_id = e.dst_doc)", "v = 0"),
    "response_in_its_locale": ("SELECT sum(CASE WHEN substring(doc_id, 1, 2) <> locale THEN 1 ELSE 0 END) AS v FROM {search_response}", "v = 0"),
    "response_ingested_after_asked": ("SELECT sum(CASE WHEN ingested_at < ts_utc THEN 1 ELSE 0 END) AS v FROM {search_response}", "v = 0"),
    "request_has_one_query": ("SELECT count(*) AS v FROM (SELECT request_id FROM {search_response} GROUP BY request_id HAVING count(DISTINCT query_id) > 1) a", "v = 0"),
    "funnel_consistent": ("SELECT sum(CASE WHEN (carted AND NOT clicked) OR (bought AND NOT carted) THEN 1 ELSE 0 END) AS v FROM {shown}", "v = 0"),
    "positions_from_one": ("SELECT min(position) AS v FROM {shown}", "v = 1"),
    "more_exact_clicks_than_irrelevant": ("SELECT avg(CASE WHEN label = 'E' THEN CASE WHEN clicked THEN 1e0 ELSE 0e0 END END) - avg(CASE WHEN label = 'I' THEN CASE WHEN clicked THEN 1e0 ELSE 0e0 END END) AS v FROM {shown}", "v > 0"),
}


def validation_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The gate: uniqueness, orphans, leakage, implications and bounds against expected values, one row per check."""
    made = {"edges": lambda: graphs.product_edges(spark, sf).where("relation <> 'co_exact'"), "shown": lambda: graphs._shown_now(spark, sf)}
    known: dict[str, DataFrame] = {}
    out = None
    for name, (value, condition) in CHECKS.items():
        names = set(re.findall(r"{(\w+)}", value))
        for n in names - known.keys():
            known[n] = made[n]() if n in made else table(spark, sf, n)
        one = spark.sql(value, **{n: known[n] for n in names}).select(F.lit(name).alias("check_name"), F.round(F.col("v").cast("double"), 6).alias("v"))
        one = one.select("check_name", F.col("v").alias("value"), F.coalesce(F.expr(condition), F.lit(False)).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


class _Tables(dict):
    def __missing__(self, key: str) -> str:
        return key


_OF = _Tables(edges="(SELECT * FROM ed WHERE relation <> 'co_exact')", shown="(SELECT *, l AS label FROM i)")
QUERIES = {"validation_checks": validation_checks}
SQL = {
    "validation_checks": f"WITH {graphs._EDGES}, {graphs._RR}, {graphs._JJ}, {graphs._shown('scores')} " + " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, round(v::DOUBLE, 6) AS value, coalesce({condition}, false) AS ok FROM ({value.format_map(_OF)})" for name, (value, condition) in CHECKS.items()
    )
}
