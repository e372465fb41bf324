"""Search from Python: one object over a data folder that keeps its analysed texts between questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import text as T
from shelfspark.operators import retrieval as R
from shelfspark.operators.spelling import correct
from shelfspark.session import cut
from shelfspark.sources.tables import table


class Engine:
    """Answers batches of query texts over the catalog of ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.catalog = table(spark, folder, "catalog")
        self._docs: dict[str, DataFrame] = {}
        self._vocabulary: DataFrame | None = None

    def _analysed(self, field: str) -> DataFrame:
        if field not in self._docs:
            self._docs[field] = R.analysed(self.catalog, "doc_id", "locale", T.terms(F.col(field)))
        return self._docs[field]

    def _words(self) -> DataFrame:
        if self._vocabulary is None:
            self._vocabulary = cut(self._analysed("title").select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        return self._vocabulary

    def search(self, texts: list[str], locale: str, k: int = 10, field: str = "doc_text", spelling: bool = True, department: str | None = None) -> DataFrame:
        """``text``, ``rk``, ``doc_id``, ``title``, ``score``, ``n_matched``, ``corrected`` and the matched ``terms`` of the best ``k`` listings of each text.

        With ``spelling``, words of slips are searched with their suggestion beside them. A ``department`` is a filter before
        the choice of the best; an unknown one has no listings. Texts without known words have no rows.
        """
        asked = self.spark.createDataFrame([(i, t, locale) for i, t in enumerate(texts)], "query long, text string, locale string")
        plain = asked.select("query", "text", "locale", T.normalize(F.col("text")).alias("normal"))
        fixed = correct(plain.select("query", "normal"), "query", "normal", self._words()) if spelling else plain.select("query", F.col("normal").alias("expanded"), F.lit(0).alias("changes"))
        rows = plain.join(fixed.select("query", "expanded", "changes"), "query")
        terms = cut(R.query_terms(rows, "query", "locale", T.terms(F.col("expanded"))))
        docs = self._analysed(field)
        if department is not None:
            docs = docs.join(self.catalog.where(F.col("category") == department).select(F.col("doc_id").alias("doc")), "doc", "left_semi").select("group", "doc", "terms")
        best = R.bm25_topk(docs, terms, k)
        words = docs.select("doc", "terms").join(best.select("doc", "query"), "doc").join(terms.groupBy("query").agg(F.collect_set("term").alias("asked")), "query")
        matched = words.select("query", "doc", F.array_sort(F.array_intersect("terms", "asked")).alias("terms"))
        out = best.join(matched, ["query", "doc"]).join(rows.select("query", "text", (F.col("changes") > 0).alias("corrected")), "query")
        return out.join(self.catalog.select(F.col("doc_id").alias("doc"), "title"), "doc").select("text", "rk", F.col("doc").alias("doc_id"), "title", "score", "n_matched", "corrected", "terms").orderBy("query", "rk")
