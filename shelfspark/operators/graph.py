"""Product and query graphs from judged pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.ranking import top_k
from shelfspark.session import cut


def product_edges(judged: DataFrame, most_exact: int = 25) -> DataFrame:
    """``src_doc``, ``dst_doc``, ``relation``, ``support`` (queries), ``example_query_id``.

    Two E documents of a query are co_exact (src < dst); an E and an S document substitutes, an E and a C
    document complements. Of a query's E documents the first ``most_exact`` by id count (a limit of the
    operator's definition, numbered by ``rk``).
    """
    e = judged.where((F.col("esci_label") == "E") & (F.col("rk") <= most_exact)).select("query_id", F.col("doc_id").alias("src_doc"))
    co = e.join(e.withColumnRenamed("src_doc", "dst_doc"), "query_id").where("src_doc < dst_doc").withColumn("relation", F.lit("co_exact"))
    other = judged.where(F.col("esci_label").isin("S", "C")).select("query_id", F.col("doc_id").alias("dst_doc"), F.when(F.col("esci_label") == "S", "substitute").otherwise("complement").alias("relation"))
    pairs = co.select("src_doc", "dst_doc", "relation", "query_id").unionByName(e.join(other, "query_id").select("src_doc", "dst_doc", "relation", "query_id"))
    return pairs.groupBy("src_doc", "dst_doc", "relation").agg(F.countDistinct("query_id").alias("support"), F.min("query_id").alias("example_query_id"))


def category_complements(edges: DataFrame, categories: DataFrame) -> DataFrame:
    """``weight`` and share within ``src_category`` of the complement edges between known categories."""
    c = categories.where(F.col("category").isNotNull() & (F.col("category") != "Unknown")).select("doc_id", "category")
    met = edges.where("relation = 'complement'").join(c.select(F.col("doc_id").alias("src_doc"), F.col("category").alias("src_category")), "src_doc")
    met = met.join(c.select(F.col("doc_id").alias("dst_doc"), F.col("category").alias("dst_category")), "dst_doc")
    sums = met.groupBy("src_category", "dst_category").agg(F.sum("support").alias("weight"))
    return sums.withColumn("share", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("src_category")), 6))


def related_queries(judged: DataFrame, most_queries: int = 50, k: int = 20) -> DataFrame:
    """Queries that share E documents: the ``k`` best by Jaccard of each query.

    A document takes part for ``most_queries`` queries, chosen by the md5 of their id (the operator's
    definition); the set sizes are those of all E rows.
    """
    e_all = judged.where("esci_label = 'E'").select("query_id", "doc_id").distinct()
    e = top_k(e_all, ["doc_id"], [F.md5(F.col("query_id").cast("string")), F.col("query_id")], most_queries).drop("rk")
    n = e_all.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = e.join(e.withColumnRenamed("query_id", "related_query_id"), "doc_id").where("query_id <> related_query_id")
    pairs = pairs.groupBy("query_id", "related_query_id").agg(F.count(F.lit(1)).alias("n_shared"))
    sized = pairs.join(n.withColumnRenamed("n", "n1"), "query_id").join(n.select(F.col("query_id").alias("related_query_id"), F.col("n").alias("n2")), "related_query_id")
    scored = sized.withColumn("jaccard", F.round(F.col("n_shared") / (F.col("n1") + F.col("n2") - F.col("n_shared")), 6))
    return top_k(scored.drop("n1", "n2"), ["query_id"], [F.desc("jaccard"), F.asc("related_query_id")], k)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (its least node) of every node of an edge list.

    Labels go to the neighbours and to the labels' own labels, by turns, until none changes; nothing is collected.
    """
    both = cut(edges.select(F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other")))).alias("e")).select("e.*").where("node IS NOT NULL AND other IS NOT NULL").distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        jumped = labels.join(labels.select(F.col("node").alias("component"), F.col("component").alias("next")), "component").select("node", F.col("next").alias("component"), F.col("component").alias("was"))
        heard = both.join(jumped.select(F.col("node").alias("other"), F.col("component").alias("heard")), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        new = cut(jumped.join(heard, "node").select("node", F.least("component", "heard").alias("component"), "was"))
        if not new.where("component <> was").limit(1).count():
            return new.select("node", "component")
        labels = new.drop("was")
