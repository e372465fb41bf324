"""Queries: retrieval, vectors, fusion, spelling and metrics over the search tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import text as T
from shelfspark.operators import evaluation as E
from shelfspark.operators import retrieval as R
from shelfspark.operators.ranking import top_k
from shelfspark.operators.spelling import corrections
from shelfspark.plans.sqltext import sql_nfkc, sql_terms
from shelfspark.session import cut
from shelfspark.sources.tables import table


def _index(spark: SparkSession, sf: str, field: str = "title") -> DataFrame:
    return R.bm25_index(table(spark, sf, "catalog").select("doc_id", "locale", field), "doc_id", "locale", T.terms(F.col(field)))


def _analysed(spark: SparkSession, sf: str, field: str) -> DataFrame:
    return R.analysed(table(spark, sf, "catalog").select("doc_id", "locale", field), "doc_id", "locale", T.terms(F.col(field)))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return cut(R.query_terms(table(spark, sf, "queries"), "query_id", "locale", T.terms(F.col("query"))))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best titles of every query."""
    best = R.bm25_topk(_analysed(spark, sf, "title"), _asked(spark, sf), 10)
    return best.select(F.col("query").alias("query_id"), F.col("doc").alias("doc_id"), "score", "n_matched", F.col("rk").cast("long").alias("rk"))


def bm25_two_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best texts (title, brand, colour and bullets) of every query, with the score of their titles alone and the words met there."""
    asked = _asked(spark, sf)
    best = R.bm25_topk(_analysed(spark, sf, "doc_text"), asked, 10)
    titles = R.bm25_pairs(_index(spark, sf), asked, best)
    both = best.join(titles.select("query", "doc", F.col("score").alias("title"), "terms"), ["query", "doc"], "left")
    return both.select(F.col("query").alias("query_id"), F.col("doc").alias("doc_id"), F.col("score").alias("bm25_text"), F.coalesce("title", F.lit(0.0)).alias("bm25_title"), F.coalesce(F.array_join("terms", " "), F.lit("")).alias("matched"), F.col("rk").cast("long").alias("rk"))


def bm25_query_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What a title can score at most for each query, and how many of its terms the titles know."""
    idfs = R.term_idfs(table(spark, sf, "catalog").select("doc_id", "locale", "title"), "doc_id", "locale", T.terms(F.col("title")))
    return R.max_scores(idfs, _asked(spark, sf)).withColumnRenamed("query", "query_id")


def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency of every title term."""
    posted = R.postings(table(spark, sf, "catalog"), "doc_id", "locale", T.terms(F.col("title")))
    return posted.groupBy(F.col("group").alias("locale"), "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


def title_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The thousand most frequent terms of each locale that at least two titles have."""
    some = term_statistics(spark, sf).where("df >= 2")
    return top_k(some, ["locale"], [F.desc("df"), F.asc("term")], 1000).withColumn("rk", F.col("rk").cast("long"))


def lexical_features(spark: SparkSession, sf: str) -> DataFrame:
    """For every judged pair the scores of text and title, their shares of the most a document can have, the shares of known words met, and whether the title has all."""
    asked = _asked(spark, sf)
    pairs = table(spark, sf, "judgments").select(F.col("query_id").alias("query"), F.col("doc_id").alias("doc")).where("query IS NOT NULL AND doc IS NOT NULL").distinct()
    pairs = cut(pairs.join(table(spark, sf, "queries").select(F.col("query_id").alias("query")), "query", "left_semi"))
    out = pairs
    for field, name in (("doc_text", "text"), ("title", "title")):
        index = cut(_index(spark, sf, field))
        scored = R.bm25_pairs(index, asked, pairs).drop("terms")
        most = R.max_scores(index, asked)
        out = out.join(scored, ["query", "doc"], "left").join(most, "query", "left")
        score, met = F.coalesce("score", F.lit(0.0)), F.coalesce("n_matched", F.lit(0))
        out = out.withColumn(f"bm25_{name}", score).withColumn(f"bm25_{name}_norm", F.round(F.coalesce(score / F.col("max_score"), F.lit(0.0)), 6))
        out = out.withColumn(f"cov_{name}", F.round(F.coalesce(met / F.col("n_known"), F.lit(0.0)), 6)).withColumn(f"max_{name}", F.coalesce("max_score", F.lit(0.0)))
        if name == "title":
            out = out.withColumn("all_terms_title", F.coalesce(met == F.col("n_known"), F.lit(False)))
        out = out.drop("score", "n_matched", "max_score", "n_known")
    out = out.withColumnRenamed("max_text", "q_bm25_max").drop("max_title")
    return out.withColumnRenamed("query", "query_id").withColumnRenamed("doc", "doc_id")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("vec"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("group"))


def _vector_queries(spark: SparkSession, sf: str, grouped: bool) -> DataFrame:
    rows = _vectors(spark, sf).where(F.col("vec") % 20 == 0)
    return rows.select(F.col("vec").alias("query"), F.col("v").alias("q"), F.col("group") if grouped else F.lit(None).cast("long").alias("group"))


def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of all vectors for every query vector (ids divisible by 20)."""
    found = R.knn_exact(_vector_queries(spark, sf, False), _vectors(spark, sf), 10)
    return found.select("query", "vec", "score", F.col("rk").cast("long").alias("rk"))


def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of the query's own label."""
    found = R.knn_exact(_vector_queries(spark, sf, True), _vectors(spark, sf), 5)
    return found.select("query", "vec", "score", F.col("rk").cast("long").alias("rk"))


def knn_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate nearest vectors by cells, as many as a recall of 0.9 of ``knn_exact`` takes."""
    vectors = _vectors(spark, sf)
    model = R.ivf_cells(vectors, cells=16)
    return R.ivf_search(model, _vector_queries(spark, sf, False), vectors, 10, R.ivf_probes(model, vectors, 10))


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    """Length of every vector and its cosine with the mean vector of its label."""
    v = _vectors(spark, sf)
    means = v.groupBy("group").agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("v").cast("array<double>")))).alias("mean"))
    return v.join(means, "group").select("vec", F.round(R.norm(F.col("v")), 6).alias("length"), F.round(R.dot(F.col("v"), F.col("mean")) / (R.norm(F.col("v")) * R.norm(F.col("mean"))), 6).alias("cosine"))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "search_response").groupBy("request_id", "query_id", "doc_id").agg(*[F.max(F.col(s).cast("double")).alias(s) for s in ("bm25_text", "vectors", "scores")], F.max("served_by").alias("served_by"))
    return once


def _ranks(rows: DataFrame, score: str) -> DataFrame:
    order = Window.partitionBy("request_id").orderBy(F.desc(score), F.asc("doc_id"))
    return rows.where(F.col(score).isNotNull()).select("request_id", "query_id", "doc_id", F.row_number().over(order).alias("rk"))


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal rank fusion of the text and the vector ranking of every request, best ten."""
    rows = _responses(spark, sf)
    lists = _ranks(rows, "bm25_text").unionByName(_ranks(rows, "vectors"))
    fused = R.rrf(lists.select(F.col("request_id").alias("query"), F.col("doc_id").alias("doc"), "rk"))
    best = top_k(fused, ["query"], [F.desc("score"), F.asc("doc")], 10)
    return best.select(F.col("query").alias("request_id"), F.col("doc").alias("doc_id"), "score", F.col("rk").cast("long").alias("rk"))


def z_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Convex fusion of z-scores (vectors 0.35) over the union of candidates, best ten."""
    rows = _responses(spark, sf).where(F.col("bm25_text").isNotNull() | F.col("vectors").isNotNull())
    fused = R.z_fusion(rows, "request_id", "vectors", "bm25_text", 0.35)
    return top_k(fused, ["request_id"], [F.desc("fused"), F.asc("doc_id")], 10).select("request_id", "doc_id", "fused", F.col("rk").cast("long").alias("rk"))


def rescued_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests no keyword hit answers, with their vector candidates (semantic rescue); a tenth of the requests, by hash, lose theirs to an outage."""
    rows = _responses(spark, sf).withColumn("bm25_text", F.when(E.uniform("request_id", F.lit("outage")) >= 0.1, F.col("bm25_text")))
    hits = rows.where(F.col("bm25_text") > 0).select("request_id").distinct()
    return rows.join(hits, "request_id", "left_anti").where(F.col("vectors").isNotNull()).groupBy("request_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.max_by("doc_id", F.struct("vectors", "doc_id")).alias("best_doc"))


def served_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Per method that served: requests, and those whose own retrievers gave nothing (degraded)."""
    per = _responses(spark, sf).groupBy("request_id", "served_by").agg(F.count("bm25_text").alias("n_text"), F.count("vectors").alias("n_vec"), F.count("scores").alias("n_scores"))
    level = F.when((F.col("n_scores") > 0), F.lit("full")).when((F.col("n_text") > 0) & (F.col("n_vec") > 0), "hybrid").when(F.col("n_text") > 0, "text").otherwise("vectors")
    return per.groupBy("served_by", level.alias("level")).agg(F.count(F.lit(1)).alias("n_requests"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "judgments").where(F.col("gain").isNotNull()).groupBy("query_id", "doc_id").agg(F.max("gain").alias("gain"), F.min("esci_label").alias("esci_label"))


def _served_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(_responses(spark, sf), "scores")


def ndcg_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Exact metrics of every request over its judged candidates."""
    return E.rerank_metrics(_served_ranks(spark, sf), _judged(spark, sf), "request_id")


def ndcg_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Condensed and lower-bound metrics of every request over all it returned."""
    return E.retrieval_metrics(_served_ranks(spark, sf), _judged(spark, sf), "request_id").withColumn("n_returned", F.col("n_returned").cast("long"))


def ndcg_by_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Mean condensed nDCG by locale, method, split and all of them, in one pass of grouping sets."""
    per = E.retrieval_metrics(_served_ranks(spark, sf), _judged(spark, sf), "request_id")
    q = table(spark, sf, "queries").select("query_id", "locale", "split")
    served = _responses(spark, sf).select("request_id", "served_by").distinct()
    rows = per.join(q, "query_id").join(served, "request_id")
    sets = rows.groupingSets([[], [F.col("locale")], [F.col("served_by")], [F.col("split")], [F.col("locale"), F.col("served_by")]], F.col("locale"), F.col("served_by"), F.col("split"))
    return sets.agg(F.round(F.avg("ndcg_cond"), 5).alias("ndcg_cond"), F.round(F.avg("judged"), 5).alias("judged"), F.count(F.lit(1)).alias("n"))


def paired_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Difference of text and vector rankings in condensed nDCG per query and locale (wide pivot join)."""
    rows, judged = _responses(spark, sf), _judged(spark, sf)
    runs = [E.retrieval_metrics(_ranks(rows, s), judged, "request_id").withColumn("method", F.lit(s)) for s in ("bm25_text", "vectors")]
    wide = runs[0].unionByName(runs[1]).groupBy("query_id").pivot("method", ["bm25_text", "vectors"]).agg(F.avg("ndcg_cond"))
    both = wide.where(F.col("bm25_text").isNotNull() & F.col("vectors").isNotNull()).join(table(spark, sf, "queries").select("query_id", "locale"), "query_id")
    return both.groupBy("locale").agg(F.round(F.avg(F.col("vectors") - F.col("bm25_text")), 5).alias("delta"), F.count(F.lit(1)).alias("n"))


def ndcg_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Mean condensed nDCG per method with a bootstrap interval."""
    per = E.retrieval_metrics(_served_ranks(spark, sf), _judged(spark, sf), "request_id")
    rows = per.join(_responses(spark, sf).select("request_id", "served_by").distinct(), "request_id")
    return E.bootstrap(rows, "request_id", ["served_by"], "ndcg_cond", draws=100)


def spelling_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Query words that are one slip away from a far more frequent title word."""
    vocabulary = term_statistics(spark, sf).groupBy("term").agg(F.sum("df").alias("df"))
    words = table(spark, sf, "queries").select(F.explode(T.terms(F.col("query"))).alias("term")).distinct()
    return corrections(words, vocabulary)


_R = """r AS (SELECT request_id, query_id, doc_id, max(bm25_text::DOUBLE) AS bm25_text, max(vectors::DOUBLE) AS vectors,
  max(scores::DOUBLE) AS scores, max(served_by) AS served_by FROM search_response GROUP BY ALL)"""
_J = """j AS (SELECT query_id, doc_id, max(gain) AS gain, min(esci_label) AS esci_label FROM judgments WHERE gain IS NOT NULL GROUP BY ALL)"""
def _sql_index(field: str, n: str = "") -> str:
    """The index of a field and the queries' terms, as common table expressions with the suffix ``n``."""
    return f"""docs{n} AS MATERIALIZED (SELECT locale AS g, doc_id AS doc, {sql_terms(field)} AS t FROM catalog),
tot{n} AS (SELECT g, count(*) AS n, avg(len(t)) AS avgdl FROM docs{n} GROUP BY g),
post{n} AS (SELECT g, doc, len(t) AS dl, unnest(t) AS term FROM docs{n}),
tf{n} AS MATERIALIZED (SELECT g, doc, dl, term, count(*) AS tf FROM post{n} GROUP BY ALL),
df{n} AS MATERIALIZED (SELECT g, term, count(*) AS df FROM tf{n} GROUP BY ALL),
ix{n} AS MATERIALIZED (SELECT tf.g, tf.term, doc, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf,
  ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w
  FROM tf{n} tf JOIN df{n} df ON df.g = tf.g AND df.term = tf.term JOIN tot{n} tot ON tot.g = tf.g)"""


_QF = f"""qt AS (SELECT query_id AS q, locale AS g, unnest({sql_terms('query')}) AS term FROM queries),
qf AS MATERIALIZED (SELECT q, g, term, count(*) AS qtf FROM qt GROUP BY ALL)"""
_I = f"{_sql_index('title')}, {_QF}"
_LEXICAL = f"""{_I}, {_sql_index('doc_text', '2')}, p AS (SELECT DISTINCT query_id, doc_id FROM judgments WHERE doc_id IS NOT NULL AND query_id IN (SELECT query_id FROM queries)),
  """ + ", ".join(
    f"""mx{n} AS (SELECT q, round(sum(idf * 2.2 * qtf), 6) AS mx, count(*) AS known FROM qf JOIN (SELECT DISTINCT g, term, idf FROM ix{n}) USING (g, term) GROUP BY q),
  h{n} AS (SELECT query_id, doc_id, round(sum(w * qtf), 6) AS s, count(*) AS n FROM p JOIN qf ON q = query_id JOIN ix{n} ix ON ix.g = qf.g AND ix.term = qf.term AND doc = doc_id GROUP BY ALL)"""
    for n in ("", "2")
) + """, lex AS (SELECT p.query_id, p.doc_id, coalesce(h2.s, 0) AS bm25_text, round(coalesce(coalesce(h2.s, 0) / mx2.mx, 0), 6) AS bm25_text_norm, round(coalesce(coalesce(h2.n, 0) / mx2.known, 0), 6) AS cov_text, coalesce(mx2.mx, 0) AS q_bm25_max,
    coalesce(h.s, 0) AS bm25_title, round(coalesce(coalesce(h.s, 0) / mx.mx, 0), 6) AS bm25_title_norm, round(coalesce(coalesce(h.n, 0) / mx.known, 0), 6) AS cov_title, coalesce(coalesce(h.n, 0) = mx.known, false) AS all_terms_title
    FROM p LEFT JOIN h ON h.query_id = p.query_id AND h.doc_id = p.doc_id LEFT JOIN mx ON mx.q = p.query_id LEFT JOIN h2 ON h2.query_id = p.query_id AND h2.doc_id = p.doc_id LEFT JOIN mx2 ON mx2.q = p.query_id)"""
_RANK = "s AS (SELECT request_id, query_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY {c} DESC, doc_id) AS rk FROM r WHERE {c} IS NOT NULL)"
_IDEAL = """b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS k FROM j),
i AS (SELECT query_id, sum(CASE WHEN k <= 10 THEN gain / log2(k + 1) ELSE 0 END) AS i10, sum(CASE WHEN k <= 5 THEN gain / log2(k + 1) ELSE 0 END) AS i5,
  count(*) FILTER (WHERE esci_label = 'E') AS n_e FROM b GROUP BY query_id)"""
_COND = """x AS (SELECT s.*, j.gain, j.esci_label, sum((j.gain IS NOT NULL)::INT) OVER (PARTITION BY request_id ORDER BY s.rk, s.doc_id ROWS UNBOUNDED PRECEDING) AS pos
  FROM s LEFT JOIN j USING (query_id, doc_id)),
m AS (SELECT request_id, query_id, sum(CASE WHEN gain IS NOT NULL AND pos <= 10 THEN gain / log2(pos + 1) ELSE 0 END) AS c,
  sum(CASE WHEN rk <= 10 THEN coalesce(gain, 0) / log2(rk + 1) ELSE 0 END) AS l, count(*) FILTER (WHERE gain IS NOT NULL AND rk <= 10) AS kn,
  count(*) FILTER (WHERE esci_label = 'E' AND rk <= 100) AS f, max(CASE WHEN esci_label = 'E' AND rk <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS h, count(*) AS n_returned FROM x GROUP BY ALL),
v AS (SELECT request_id, query_id, round(CASE WHEN i10 > 0 THEN c / i10 END, 6) AS ndcg_cond, round(CASE WHEN i10 > 0 THEN l / i10 END, 6) AS ndcg_low, round(kn / 10, 6) AS judged,
  round(CASE WHEN n_e > 0 THEN f / n_e END, 6) AS recall_e, CASE WHEN n_e > 0 THEN h END AS success_e, n_returned FROM m JOIN i USING (query_id))"""

QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_two_fields, bm25_query_stats, term_statistics, title_vocabulary, lexical_features, knn_exact, knn_filtered, knn_ivf, vector_norms, rrf_fusion, z_fusion,
        rescued_requests, served_fallback, ndcg_rerank, ndcg_retrieval, ndcg_by_slice, paired_methods, ndcg_bootstrap, spelling_corrections,
    )
}
SQL = {
    "bm25_topk": f"""WITH {_I}, s AS (SELECT q, doc, round(sum(w * qtf), 6) AS score, count(*) AS n FROM qf JOIN ix USING (g, term) GROUP BY ALL)
      SELECT q AS query_id, doc AS doc_id, score, n AS n_matched, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rk FROM s QUALIFY rk <= 10""",
    "bm25_query_stats": f"""WITH {_I} SELECT q AS query_id, round(sum(idf * 2.2 * qtf), 6) AS max_score, count(*) AS n_known
      FROM qf JOIN (SELECT DISTINCT g, term, idf FROM ix) USING (g, term) GROUP BY q""",
    "term_statistics": f"WITH {_I} SELECT g AS locale, term, count(*) AS df, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL",
    "title_vocabulary": f"WITH {_I} SELECT *, row_number() OVER (PARTITION BY locale ORDER BY df DESC, term) AS rk FROM (SELECT g AS locale, term, count(*) AS df, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL HAVING count(*) >= 2) QUALIFY rk <= 1000",
    "lexical_features": f"WITH {_LEXICAL} SELECT * FROM lex",
    "bm25_two_fields": f"""WITH {_I}, {_sql_index('doc_text', '2')}, s AS (SELECT q, doc, round(sum(w * qtf), 6) AS score FROM qf JOIN ix2 USING (g, term) GROUP BY ALL),
      b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rk FROM s QUALIFY rk <= 10),
      t AS (SELECT b.q, b.doc, round(sum(w * qtf), 6) AS s, string_agg(qf.term, ' ' ORDER BY qf.term) AS m FROM b JOIN qf ON qf.q = b.q JOIN ix ON ix.g = qf.g AND ix.term = qf.term AND ix.doc = b.doc GROUP BY ALL)
      SELECT q AS query_id, doc AS doc_id, score AS bm25_text, coalesce(s, 0) AS bm25_title, coalesce(m, '') AS matched, rk FROM b LEFT JOIN t USING (q, doc)""",
    "spelling_corrections": f"""WITH {_I}, v AS (SELECT term, sum(df)::BIGINT AS df FROM df GROUP BY 1),
      s AS (SELECT term, coalesce(df, 0) AS n0 FROM (SELECT DISTINCT term FROM qf) LEFT JOIN v USING (term) WHERE regexp_matches(term, '^[a-zß-˿]+$') AND length(term) >= 4),
      d AS (SELECT *, CASE WHEN n0 < 3 THEN 20 * greatest(n0, 1) WHEN n0 <= 50 THEN 200 * n0 END AS need FROM s),
      k AS (SELECT term AS suggestion, df AS n FROM v WHERE df >= 5 AND length(term) >= 3 AND regexp_matches(term, '^[a-zß-˿]+$'))
      SELECT term, n0, suggestion, n FROM d JOIN k ON suggestion <> term AND n >= need AND abs(length(term) - length(suggestion)) <= 1 AND damerau_levenshtein(translate(term, 'áéíóúñüçàèò', 'AEIOUNXCBDF'), translate(suggestion, 'áéíóúñüçàèò', 'AEIOUNXCBDF')) <= 1
      QUALIFY row_number() OVER (PARTITION BY term ORDER BY n DESC, suggestion) = 1""",
    "knn_exact": """SELECT a.vec_id AS query, b.vec_id AS vec, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rk
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rk <= 10""",
    "knn_filtered": """SELECT a.vec_id AS query, b.vec_id AS vec, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rk
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label WHERE a.vec_id % 20 = 0 QUALIFY rk <= 5""",
    "vector_norms": """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
      m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL)
      SELECT vec_id AS vec, round(sqrt(sum(v * v)), 6) AS length, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 6) AS cosine FROM x JOIN m USING (label, i) GROUP BY vec_id""",
    "rrf_fusion": f"""WITH {_R}, a AS (SELECT request_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY bm25_text DESC, doc_id) AS rk FROM r WHERE bm25_text IS NOT NULL
      UNION ALL SELECT request_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY vectors DESC, doc_id) FROM r WHERE vectors IS NOT NULL),
      s AS (SELECT request_id, doc_id, round(sum(1.0::DOUBLE / (60 + rk)), 9) AS score FROM a GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id) AS rk FROM s QUALIFY rk <= 10""",
    "z_fusion": f"""WITH {_R}, c AS (SELECT request_id, doc_id, bm25_text AS b, vectors AS v
      FROM r WHERE bm25_text IS NOT NULL OR vectors IS NOT NULL),
      z AS (SELECT request_id, doc_id, round(0.35::DOUBLE * coalesce(CASE WHEN count(v) OVER w >= 2 AND stddev_pop(v) OVER w > 1e-9 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE 0 END, 0)
        + 0.65::DOUBLE * coalesce(CASE WHEN count(b) OVER w >= 2 AND stddev_pop(b) OVER w > 1e-9 THEN (b - avg(b) OVER w) / stddev_pop(b) OVER w ELSE 0 END, 0), 6) AS fused FROM c WINDOW w AS (PARTITION BY request_id))
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY fused DESC, doc_id) AS rk FROM z QUALIFY rk <= 10""",
    "rescued_requests": f"""WITH {_R} SELECT request_id, count(*) AS n_candidates, arg_max(doc_id, (vectors, doc_id)) AS best_doc FROM r
      WHERE vectors IS NOT NULL AND request_id NOT IN (SELECT request_id FROM r WHERE bm25_text > 0 AND ('0x' || left(md5(concat_ws('|', request_id::VARCHAR, 'outage')), 8))::BIGINT::DOUBLE / 4294967296.0 >= 0.1) GROUP BY request_id""",
    "served_fallback": f"""WITH {_R}, p AS (SELECT request_id, served_by, count(bm25_text) AS t, count(vectors) AS v, count(scores) AS s FROM r GROUP BY ALL)
      SELECT served_by, CASE WHEN s > 0 THEN 'full' WHEN t > 0 AND v > 0 THEN 'hybrid' WHEN t > 0 THEN 'text' ELSE 'vectors' END AS level, count(*) AS n_requests FROM p GROUP BY ALL""",
    "ndcg_rerank": f"""WITH {_R}, {_J}, {_RANK.format(c='scores')}, {_IDEAL},
      x AS (SELECT s.*, j.gain, j.esci_label, row_number() OVER (PARTITION BY request_id ORDER BY s.rk, s.doc_id) AS pos FROM s JOIN j USING (query_id, doc_id)),
      m AS (SELECT request_id, query_id, sum(CASE WHEN pos <= 10 THEN gain / log2(pos + 1) ELSE 0 END) AS d10, sum(CASE WHEN pos <= 5 THEN gain / log2(pos + 1) ELSE 0 END) AS d5, min(pos) FILTER (WHERE esci_label = 'E') AS f FROM x GROUP BY ALL)
      SELECT request_id, query_id, round(CASE WHEN i10 > 0 THEN d10 / i10 END, 6) AS ndcg10, round(CASE WHEN i5 > 0 THEN d5 / i5 END, 6) AS ndcg5, round(1.0::DOUBLE / f, 6) AS mrr_e, CASE WHEN f = 1 THEN 1.0::DOUBLE ELSE 0 END AS p1_e FROM m JOIN i USING (query_id)""",
    "ndcg_retrieval": f"WITH {_R}, {_J}, {_RANK.format(c='scores')}, {_IDEAL}, {_COND} SELECT * FROM v",
    "ndcg_by_slice": f"""WITH {_R}, {_J}, {_RANK.format(c='scores')}, {_IDEAL}, {_COND}
      SELECT locale, served_by, split, round(avg(ndcg_cond), 5) AS ndcg_cond, round(avg(judged), 5) AS judged, count(*) AS n
      FROM v JOIN queries USING (query_id) JOIN (SELECT DISTINCT request_id, served_by FROM r) USING (request_id)
      GROUP BY GROUPING SETS ((), (locale), (served_by), (split), (locale, served_by))""",
    "paired_methods": f"""WITH {_R}, {_J}, {_IDEAL},
      s AS (SELECT 2 * request_id + 1 AS request_id, query_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY bm25_text DESC, doc_id) AS rk FROM r WHERE bm25_text IS NOT NULL
        UNION ALL SELECT 2 * request_id, query_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY vectors DESC, doc_id) FROM r WHERE vectors IS NOT NULL), {_COND},
      w AS (SELECT query_id, avg(ndcg_cond) FILTER (WHERE request_id % 2 = 1) AS a, avg(ndcg_cond) FILTER (WHERE request_id % 2 = 0) AS b FROM v GROUP BY query_id)
      SELECT locale, round(avg(b - a), 5) AS delta, count(*) AS n FROM w JOIN queries USING (query_id) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY locale""",
}
