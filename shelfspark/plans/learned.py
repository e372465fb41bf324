"""Queries: models fitted here and what they predict."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import text as T
from shelfspark.operators import models as M
from shelfspark.operators import retrieval as R
from shelfspark.plans.matching import ranking_features, search_categories
from shelfspark.session import cut
from shelfspark.sources.files import scratch
from shelfspark.sources.tables import table


#: Probability below which a department is unknown.
SURE = 0.5


def predicted_departments(spark: SparkSession, sf: str) -> DataFrame:
    """A category for every listing: its own if it has one, else the one its title makes likely, else Unknown. Fitted on four fifths of those that have one, by hash."""
    rows = table(spark, sf, "catalog").select("doc_id", F.nullif("category", F.lit("Unknown")).alias("category"), T.terms(F.col("title")).alias("terms"), (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held"))
    model = M.department_model(M.fit_rows(rows.where("category IS NOT NULL AND NOT held"), "doc_id"), "terms", "category")
    labels = model.stages[0].labels
    made = model.transform(rows.withColumn("own", F.col("category")).withColumn("category", F.coalesce("category", F.lit(labels[0]))))
    likely = F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int"))
    sure = F.array_max(vector_to_array("probability"))
    return made.select("doc_id", "held", likely.alias("predicted"), F.round(sure, 6).alias("probability"), F.coalesce("own", F.when(sure >= SURE, likely), F.lit("Unknown")).alias("department"))


def query_departments(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest department of every query text and how sure that is, fitted on the commonest category of the train queries' E listings."""
    shares = search_categories(spark, sf)
    best = shares.groupBy("query_id").agg(F.max_by("category", F.struct("p", "category")).alias("category"))
    rows = table(spark, sf, "queries").select("query_id", "split", T.terms(F.col("query")).alias("terms")).join(best, "query_id", "left")
    model = M.department_model(M.fit_rows(rows.where("category IS NOT NULL AND split = 'train'"), "query_id"), "terms", "category")
    labels = model.stages[0].labels
    made = model.transform(rows.withColumn("own", F.col("category")).withColumn("category", F.coalesce("category", F.lit(labels[0]))))
    p = vector_to_array("probability")
    return made.select("query_id", "split", F.col("own").alias("category"), F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int")).alias("predicted"), F.round(F.array_max(p), 6).alias("top"), F.round(-F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log2(x)).otherwise(0.0)), 6).alias("entropy"))


FEATURES = [
    "q_n_units", "q_n_attrs", "bm25_text", "bm25_text_norm", "cov_text", "bm25_title", "bm25_title_norm", "cov_title", "measures_match", "measures_conflict", "audience_match", "audience_conflict", "materials_match", "materials_conflict",
    "colors_match", "colors_conflict", "pack_match", "pack_conflict", "brand_match", "brand_conflict", "neg_violation", "is_sparse", "log_richness", "title_len", "cat_conf",
]


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    gains = table(spark, sf, "judgments").where("gain IS NOT NULL").groupBy("query_id", "doc_id").agg(F.max("gain").alias("gain"), F.min("split").alias("split"), F.min("esci_label").alias("esci_label"))
    return cut(ranking_features(spark, sf).join(gains, ["query_id", "doc_id"]).select("query_id", "doc_id", "gain", "split", "esci_label", *[F.col(n).cast("double").alias(n) for n in FEATURES]))


def ranked_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Judged pairs: the first ten of each query by text score reordered by boosted trees over the content features, fitted on the train split; the rest below."""
    pairs = _pairs(spark, sf)
    model = M.ranking_model(M.fit_rows(pairs.where("split = 'train'"), "doc_id"), FEATURES, "gain")
    scored = model.transform(pairs).withColumn("model", F.round("prediction", 9)).withColumn("first", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25_text"), "doc_id")))
    return M.rerank(scored, "query_id", "bm25_text", "model", "first", 10).select("query_id", "doc_id", "gain", "split", F.round("final", 9).alias("score"), "rk")


def label_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest relevance label of every judged pair and its probability."""
    pairs = _pairs(spark, sf)
    model = M.label_classifier(M.fit_rows(pairs.where("split = 'train' AND esci_label IS NOT NULL"), "doc_id"), FEATURES, "esci_label")
    labels = model.stages[0].labels
    made = model.transform(pairs.where("esci_label IS NOT NULL"))
    return made.select("query_id", "doc_id", "split", "esci_label", F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int")).alias("predicted"), F.round(F.array_max(vector_to_array("probability")), 6).alias("p"))


def dense_cosines(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of query and title vectors for every judged pair; the encoder is fitted here on titles."""
    titles = table(spark, sf, "catalog").select("doc_id", T.terms(F.col("title")).alias("terms"))
    model = M.encoder(M.fit_rows(titles, "doc_id"), "terms")
    vector = lambda rows, key: model.transform(rows).select(key, vector_to_array("vector").alias(f"v_{key}"))
    docs = vector(titles, "doc_id")
    queries = vector(table(spark, sf, "queries").select("query_id", T.terms(F.col("query")).alias("terms")), "query_id")
    pairs = table(spark, sf, "judgments").select("query_id", "doc_id").distinct().join(docs, "doc_id").join(queries, "query_id")
    sizes = R.norm(F.col("v_doc_id")) * R.norm(F.col("v_query_id"))
    return pairs.select("query_id", "doc_id", F.round(F.coalesce(R.dot(F.col("v_doc_id"), F.col("v_query_id")) / F.nullif(sizes, F.lit(0.0)), F.lit(0.0)), 6).alias("dense_cos"))


def registered_models(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of the encoder registered, the second put into service, and what the registry then lists."""
    titles = M.fit_rows(table(spark, sf, "catalog").select("doc_id", T.terms(F.col("title")).alias("terms")), "doc_id")
    registry = M.Registry(spark, scratch(spark, "models"))
    for version, size in (("1", 8), ("2", 16)):
        registry.register("encoder", version, M.encoder(titles, "terms", size), {"size": size})
    registry.promote("encoder", "2")
    return registry.listing()


QUERIES = {f.__name__: f for f in (predicted_departments, query_departments, ranked_by_model, label_probabilities, dense_cosines, registered_models)}
SQL: dict[str, str] = {}
