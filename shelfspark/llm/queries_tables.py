"""Queries p1, p2, p3, p5 and p6 (catalog, queries and judgments)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.brands import map_names
from shelfspark.llm.fusion import fuse_scores
from shelfspark.llm.listings import group_pairs, product_groups
from shelfspark.llm.overlap import split_overlap
from shelfspark.llm.pairs import associated_pairs
from shelfspark.operators.sizing import lookup
from shelfspark.session import cut
from shelfspark.sources.tables import table


def _typed_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "catalog").select(F.lit("catalog.brand").alias("src_field"), F.col("doc_id").alias("rec_key"), F.col("brand").alias("value"))
    parsed = table(spark, sf_dir, "parsed_queries").select(F.lit("parsed_queries.brands").alias("src_field"), F.col("query_id").cast("string").alias("rec_key"), F.explode("brands").alias("value"))
    return catalog.unionByName(parsed).where(F.col("value").rlike(r"[^\s\p{Z}\p{Cf}]"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of brand_list that each typed brand means, -1 if the list has none."""
    brands = table(spark, sf_dir, "brand_list").select("brand_id", "brand_name", "brand_kana")
    names = cut(brands.select(F.col("brand_name").alias("value")).distinct())
    typed = _typed_brands(spark, sf_dir)
    strange = cut(lookup(typed, names, ["value"], "left_anti"))
    mapping = cut(map_names(strange.select("value"), brands).select("value", "brand_id"))
    return lookup(strange, mapping, ["value"]).select("src_field", "rec_key", "brand_id").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("query_id_held", "query_id_train").alias("query_id_a"), F.greatest("query_id_held", "query_id_train").alias("query_id_b")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train query and one of another split that ask for the same thing."""
    return _ordered(split_overlap(table(spark, sf_dir, "judgments")).query_pairs())


def p2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of those, the pairs that have a text letter for letter alike."""
    return _ordered(split_overlap(table(spark, sf_dir, "judgments")).exact_copies())


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each query's texts and how many queries of the other side ask for the same."""
    return split_overlap(table(spark, sf_dir, "judgments")).classes()


def p2_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: queries, those asked again by the other side, and their mean shared coverage."""
    queries = split_overlap(table(spark, sf_dir, "judgments")).per_query()
    return queries.groupBy("split", "source").agg(F.countDistinct("query_id").alias("n_queries"), F.countDistinct(F.when(F.col("whole"), F.col("query_id"))).alias("n_shared"), F.round(F.avg("covered"), 6).alias("mean_covered"))


SCORES = ["bm25_text", "vectors", "scores"]


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every request, ranked by all three scores."""
    ranked = fuse_scores(table(spark, sf_dir, "search_response"), SCORES)
    return ranked.select("request_id", "doc_id", "fused", "rk")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings labelled E for the same queries at least four times and six times as often as by chance."""
    rows = table(spark, sf_dir, "jj").where(F.col("esci_label") == "E")
    pairs = associated_pairs(rows, "query_id", "doc_id", min_together=4, min_lift=6)
    return pairs.select(F.col("item_a").alias("doc_id_a"), F.col("item_b").alias("doc_id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product group of every listing."""
    return product_groups(table(spark, sf_dir, "catalog"), table(spark, sf_dir, "brand_list"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of listings of one locale that offer the same product."""
    return group_pairs(cut(p6_groups(spark, sf_dir)))


P3_SQL = """
WITH f AS (
  SELECT request_id, doc_id, ingested_at,
    CASE WHEN isfinite(bm25_text) THEN bm25_text::DOUBLE END AS s1,
    CASE WHEN isfinite(vectors) THEN vectors::DOUBLE END AS s2,
    CASE WHEN isfinite(scores) THEN scores::DOUBLE END AS s3
  FROM search_response WHERE request_id IS NOT NULL AND doc_id IS NOT NULL),
r AS (
  SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY request_id, doc_id
    ORDER BY ingested_at DESC, s1 DESC NULLS LAST, s2 DESC NULLS LAST, s3 DESC NULLS LAST) = 1),
l AS (
  SELECT request_id, doc_id, 1 AS k, s1 AS x FROM r UNION ALL
  SELECT request_id, doc_id, 2, s2 FROM r UNION ALL SELECT request_id, doc_id, 3, s3 FROM r),
m AS (SELECT request_id, k, median(x) AS m, min(x) AS l FROM l WHERE x IS NOT NULL GROUP BY ALL),
d AS (
  SELECT m.request_id, m.k, m.m, m.l, CASE WHEN median(abs(x - m)) > 0 THEN median(abs(x - m)) * 1.4826 ELSE avg(abs(x - m)) * 1.2533 END AS d
  FROM l JOIN m USING (request_id, k) WHERE x IS NOT NULL GROUP BY ALL),
u AS (
  SELECT l.request_id, l.doc_id,
    ln(1 / (1 + exp(-greatest(-30, least(30, CASE WHEN d > 0 THEN (coalesce(x, l) - m) / d ELSE 0 END))))) AS u
  FROM l JOIN d ON d.request_id = l.request_id AND d.k = l.k),
g AS (SELECT request_id, doc_id, round(exp(avg(u)), 9) AS fused FROM u GROUP BY ALL),
a AS (SELECT r.request_id, r.doc_id, coalesce(fused, 0) AS fused FROM r LEFT JOIN g USING (request_id, doc_id))
SELECT request_id, doc_id, fused,
  row_number() OVER (PARTITION BY request_id ORDER BY fused DESC, doc_id) AS rk FROM a
"""
P2_EXACT_SQL = r"""
SELECT DISTINCT least(a.query_id, b.query_id) AS query_id_a, greatest(a.query_id, b.query_id) AS query_id_b
FROM (SELECT * FROM judgments WHERE split IS DISTINCT FROM 'train') a JOIN judgments b ON b.split = 'train' AND a.locale = b.locale AND a.query = b.query
WHERE regexp_matches(a.query, '[\p{L}\p{N}]')
"""
P5_SQL = """
WITH e AS (SELECT DISTINCT query_id, doc_id FROM jj WHERE esci_label = 'E' AND query_id IS NOT NULL AND doc_id IS NOT NULL),
n AS (SELECT count(DISTINCT query_id) AS n FROM e),
c AS (SELECT doc_id, count(*) AS c FROM e GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS ab FROM e a JOIN e b ON a.query_id = b.query_id AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 4)
SELECT a AS doc_id_a, b AS doc_id_b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b CROSS JOIN n
WHERE ab * n >= 6 * ca.c * cb.c
"""

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_exact": p2_exact, "p2_classes": p2_classes, "p2_overlap": p2_overlap, "p3_ranking": p3_ranking, "p5_found": p5_found, "p6_found": p6_found, "p6_groups": p6_groups}
SQL: dict[str, str] = {"p2_exact": P2_EXACT_SQL, "p3_ranking": P3_SQL, "p5_found": P5_SQL}
