"""Queries: query understanding, spelling, ranking features, robustness and further evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import draws as D
from shelfspark.functions import text as T
from shelfspark.functions.words import STOPWORDS
from shelfspark.operators import evaluation as E
from shelfspark.operators import retrieval as R
from shelfspark.operators import spelling as S
from shelfspark.operators.evaluation import uniform
from shelfspark.operators.matching import brand_mentions
from shelfspark.operators.ranking import top_k
from shelfspark.plans import graphs, search
from shelfspark.plans.relational import brand_vocabulary
from shelfspark.plans.sqltext import sql_normalize, sql_stem, sql_terms
from shelfspark.session import cut
from shelfspark.sources.tables import table

LATIN = "^[a-z]{5,}$"


def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return cut(search.term_statistics(spark, sf).groupBy("term").agg(F.sum("df").alias("df")))


def typo_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Every frequent title word mistyped once, and what it is corrected to."""
    known = _vocabulary(spark, sf)
    typed = known.where((F.col("df") >= 20) & F.col("term").rlike(LATIN)).select(D.typo(F.col("term"), uniform("term", F.lit("kind")), uniform("term", F.lit("place"))).alias("term"))
    return S.corrections(typed, known)


def corrected_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every query with its first longer word mistyped, corrected by adding the suggestion (expand) and by putting it in place (replace); brand words stay."""
    q = table(spark, sf, "queries").select("query_id", "locale", F.split(T.normalize(F.col("query")), " ").alias("w"))
    at = F.array_position(F.transform("w", lambda w: w.rlike(LATIN)), F.lit(True)) - 1
    typed = F.transform("w", lambda w, i: F.when(i == at, D.typo(w, uniform("query_id", F.lit("kind")), uniform("query_id", F.lit("place")))).otherwise(w))
    protected = table(spark, sf, "catalog").where("brand_norm IS NOT NULL").select(F.explode(F.split("brand_norm", " ")).alias("term")).distinct()
    out = S.correct(q.select("query_id", F.array_join(typed, " ").alias("text")), "query_id", "text", _vocabulary(spark, sf), cut(protected))
    return out.select("query_id", "text", "expanded", "replaced", F.col("changes").cast("long").alias("changes"))


def query_brands(spark: SparkSession, sf: str) -> DataFrame:
    """Brands of the catalog that the queries' texts name: whole words in Latin locales, anywhere in Japanese (the five longest)."""
    brands = brand_vocabulary(spark, sf).where("n_products >= 2").select("locale", F.col("brand_norm").alias("name"))
    texts = table(spark, sf, "parsed_queries").select(F.col("query_id").alias("rec"), "locale", F.col("norm").alias("text"))
    found = brand_mentions(texts, brands)
    jp = top_k(found.where("locale = 'jp'"), ["rec"], [F.desc(F.char_length("name")), F.asc("name")], 5).drop("rk")
    return found.where("locale <> 'jp'").unionByName(jp).select(F.col("rec").alias("query_id"), "locale", F.col("name").alias("brand"))


def planted_negations(spark: SparkSession, sf: str) -> DataFrame:
    """Every query with an exclusion added, the exclusion seen and what it excludes."""
    added = F.coalesce(*[F.when(F.col("locale") == k, F.lit(v)) for k, v in _EXCLUSIONS.items()], F.lit(""))
    n = T.normalize(F.concat_ws(" ", "query", added))
    return table(spark, sf, "queries").select("query_id", n.alias("n")).select("query_id", T.has_negation(F.col("n")).alias("has_negation"), F.array_join(T.negated_terms(F.col("n")), " ").alias("negated"))


_EXCLUSIONS = {"us": "without cotton straps", "es": "sin tapas", "jp": "フタなし"}
_TYPES = ["measures", "dimensions", "sizes", "audience", "compat", "materials", "colors"]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def ranking_features(spark: SparkSession, sf: str) -> DataFrame:
    """All content and feedback features of every judged pair whose query is parsed."""
    none = F.array().cast("array<string>")
    p = table(spark, sf, "parsed_queries")
    at = {k: F.coalesce(F.try_element_at("attrs", F.lit(k)), none) for k in _TYPES}
    brands = F.transform(F.coalesce("brands", none), F.lower)
    q_cols = {
        "q_n_units": F.col("n_units"), "q_has_digit": _flag(F.col("has_digit")), "q_n_brands": F.size(brands), "q_n_attrs": sum((F.when(F.size(a) > 0, 1).otherwise(0) for a in at.values()), F.when(F.col("pack_count").isNotNull(), 1).otherwise(0)),
        "q_has_negation": _flag(F.col("has_negation")), "locale_code": F.when(F.col("locale") == "us", 0).when(F.col("locale") == "es", 1).when(F.col("locale") == "jp", 2).otherwise(-1),
    }
    q = p.select("query_id", *[c.alias(n) for n, c in q_cols.items()], *[a.alias(f"_q_{k}") for k, a in at.items()], F.col("pack_count").alias("_pack"), brands.alias("_brands"), T.negated_terms(T.normalize(F.col("text"))).alias("_neg"))
    c = table(spark, sf, "catalog").select("doc_id", *[F.coalesce(f"attr_{k}", none).alias(f"_d_{k}") for k in _TYPES], F.col("attr_pack_count").alias("_d_pack"), "brand_norm", T.terms(F.col("title")).alias("_terms"), _flag(F.col("is_sparse")).alias("is_sparse"), F.round(F.log1p(F.coalesce("richness_chars", F.lit(0))), 6).alias("log_richness"), F.coalesce("n_title_chars", F.lit(0)).alias("title_len"), _flag(F.col("is_title_only")).alias("title_only"), F.col("category").alias("_cat"), F.coalesce("category_conf", F.lit(0.0)).alias("cat_conf"))
    rows = search.lexical_features(spark, sf).join(q, "query_id").join(c, "doc_id")
    for k in _TYPES:
        asked, hit = F.size(f"_q_{k}") > 0, F.arrays_overlap(f"_q_{k}", f"_d_{k}")
        rows = rows.withColumns({f"{k}_q": asked.cast("int"), f"{k}_match": _flag(asked & hit), f"{k}_conflict": _flag(asked & (F.size(f"_d_{k}") > 0) & ~hit)})
    known = F.size("_brands") > 0
    rows = rows.withColumns({
        "pack_q": F.col("_pack").isNotNull().cast("int"), "pack_match": _flag(F.col("_pack") == F.col("_d_pack")), "pack_conflict": _flag((F.col("_pack") != F.col("_d_pack")) & (F.col("_d_pack") > 0)),
        "brand_q": known.cast("int"), "brand_match": _flag(known & F.array_contains("_brands", F.col("brand_norm"))), "brand_conflict": _flag(known & F.col("brand_norm").isNotNull() & ~F.array_contains("_brands", F.col("brand_norm"))),
        "neg_violation": _flag(F.arrays_overlap("_neg", "_terms")), "cat_known": _flag(F.col("_cat").isNotNull() & (F.col("_cat") != "Unknown")),
    })
    soft = search_categories(spark, sf)
    rows = rows.join(soft.groupBy("query_id").agg(F.round(F.abs(F.sum(F.col("p") * F.log2("p"))), 6).alias("q_cat_entropy"), F.round(F.max("p"), 6).alias("q_cat_top")), "query_id", "left")
    rows = rows.join(soft.select("query_id", F.col("category").alias("_cat"), F.round("p", 6).alias("p_cat")), ["query_id", "_cat"], "left")
    fb = graphs.ips_feedback(spark, sf)
    prior = fb.agg((F.sum("clicks") / F.sum("impressions")).alias("prior"))
    asked_n = fb.groupBy("query_id").agg(F.sum("impressions").alias("_n"))
    z = lambda n: F.coalesce(n, F.lit(0))
    rows = rows.join(fb, ["query_id", "doc_id"], "left").join(asked_n, "query_id", "left").withColumn("_prior", F.lit(prior.first()[0] or 0.05))
    rows = rows.withColumns({
        "fb_log_impressions": F.round(F.log1p(z("impressions")), 6), "fb_ctr": F.round((z("ips_clicks") + 20 * F.col("_prior")) / (z("ips_impressions") + 20), 6), "fb_cart": F.round((z("carts") + 0.5) / (z("clicks") + 10.0), 6),
        "fb_buy": F.round((z("purchases") + 0.2) / (z("clicks") + 10.0), 6), "fb_thumbs": F.round((z("thumbs_up") - z("thumbs_down")) / (z("thumbs_up") + z("thumbs_down") + 2.0), 6), "fb_log_query": F.round(F.log1p(z("_n")), 6),
    })
    return rows.drop(*fb.columns[2:], "brand_norm", *[c for c in rows.columns if c.startswith("_")])


def search_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each known category among the E listings of each query."""
    e = table(spark, sf, "jj").where("esci_label = 'E'").select("query_id", "doc_id").distinct()
    n = e.join(table(spark, sf, "catalog").where("category IS NOT NULL AND category <> 'Unknown'").select("doc_id", "category"), "doc_id").groupBy("query_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return n.select("query_id", "category", (F.col("n") / F.sum("n").over(Window.partitionBy("query_id"))).alias("p"))


def robustness(spark: SparkSession, sf: str) -> DataFrame:
    """Condensed nDCG of the text search for varied query texts against the texts as they are, by kind of variant."""
    rows = graphs._variants(spark, sf).where("variant <> 'none'")
    docs, judged = search._analysed(spark, sf, "title"), search._judged(spark, sf)
    runs = []
    for text, name in (("query", "plain"), ("text", "varied")):
        asked = cut(R.query_terms(rows, "query_id", "locale", T.terms(F.col(text))))
        ranked = R.bm25_topk(docs, asked, 20).select(F.col("query").alias("query_id"), F.col("doc").alias("doc_id"), "rk")
        runs.append(E.retrieval_metrics(ranked.withColumn("run", F.col("query_id")), judged, "run").select("query_id", F.col("ndcg_cond").alias(name)))
    both = rows.join(runs[0], "query_id", "left").join(runs[1], "query_id", "left").where("plain IS NOT NULL")
    return both.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("plain"), 5).alias("plain"), F.round(F.avg(F.coalesce("varied", F.lit(0.0))), 5).alias("varied"))


def paired_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Mean difference of the vector and the text ranking in condensed nDCG, its 95 % interval and the share of draws at or below nought."""
    rows, judged = search._responses(spark, sf), search._judged(spark, sf)
    a, b = (E.retrieval_metrics(search._ranks(rows, s), judged, "request_id").groupBy("query_id").agg(F.avg("ndcg_cond").alias(s)) for s in ("bm25_text", "vectors"))
    both = a.join(b, "query_id").where("bm25_text IS NOT NULL AND vectors IS NOT NULL").join(table(spark, sf, "queries").select("query_id", "locale"), "query_id")
    return E.paired_interval(both.withColumn("d", F.col("vectors") - F.col("bm25_text")), "query_id", ["locale"], "d", draws=100)


def depth_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Mean condensed nDCG when the first candidates of the text ranking, down to several depths, are put in the order of the vectors; the rest keep theirs below."""
    rows, judged = search._responses(spark, sf), search._judged(spark, sf)
    text = search._ranks(rows, "bm25_text").join(rows.select("request_id", "doc_id", "vectors"), ["request_id", "doc_id"])
    deep = text.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in (0, 5, 10, 20)])))
    inside = F.col("rk") <= F.col("depth")
    own = Window.partitionBy("request_id", "depth").orderBy(F.desc(inside), F.when(inside, F.col("vectors")).desc_nulls_last(), F.when(inside, None).otherwise(F.col("rk")).asc_nulls_first(), F.asc("doc_id"))
    ranked = deep.select(F.concat_ws("/", "request_id", "depth").alias("run"), "query_id", "doc_id", "depth", F.row_number().over(own).alias("rk"))
    per = E.retrieval_metrics(ranked.drop("depth"), judged, "run").withColumn("depth", F.substring_index("run", "/", -1).cast("long"))
    return per.groupBy("depth").agg(F.round(F.avg("ndcg_cond"), 5).alias("ndcg_cond"), F.count("ndcg_cond").alias("n"))


def alpha_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Mean condensed nDCG of the convex fusion of z-scores for several weights of the vectors, and which is best."""
    rows, judged = search._responses(spark, sf).where("bm25_text IS NOT NULL OR vectors IS NOT NULL"), search._judged(spark, sf)
    over = Window.partitionBy("request_id")
    z = {c: F.coalesce(R.zscore(F.col(c), over), F.lit(0.0)) for c in ("vectors", "bm25_text")}
    scored = rows.select("request_id", "query_id", "doc_id", *[v.alias(k) for k, v in z.items()]).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))
    scored = scored.withColumn("s", F.round(F.col("alpha") * F.col("vectors") + (1 - F.col("alpha")) * F.col("bm25_text"), 6))
    ranked = scored.select(F.concat_ws("/", "request_id", "alpha").alias("run"), "query_id", "doc_id", F.row_number().over(Window.partitionBy("request_id", "alpha").orderBy(F.desc("s"), F.asc("doc_id"))).alias("rk"))
    per = E.retrieval_metrics(ranked, judged, "run").withColumn("alpha", F.substring_index("run", "/", -1).cast("double"))
    means = per.groupBy("alpha").agg(F.round(F.avg("ndcg_cond"), 5).alias("ndcg_cond"), F.count("ndcg_cond").alias("n"))
    return means.withColumn("best", F.row_number().over(Window.orderBy(F.desc("ndcg_cond"), F.asc("alpha"))) == 1)


ALPHAS = [0.0, 0.25, 0.35, 0.5, 0.75, 1.0]


def degradation_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Per request the method that can serve it, the first of the chain whose inputs are there, and why not the one asked for; a tenth, by hash, run out of time for the model."""
    per = search._responses(spark, sf).groupBy("request_id", "served_by").agg(F.count("bm25_text").alias("t"), F.count("vectors").alias("v"), F.count("scores").alias("s"))
    late = uniform("request_id", F.lit("budget")) < 0.1
    method = F.when((F.col("s") > 0) & ~late, "model").when((F.col("t") > 0) & (F.col("v") > 0), "hybrid").when(F.col("t") > 0, "text").when(F.col("v") > 0, "vectors").otherwise("none")
    reason = F.when((F.col("s") > 0) & ~late, "").when((F.col("s") > 0) & late, "budget").otherwise("no scores")
    return per.select("request_id", "served_by", method.alias("method"), reason.alias("reason"))


def slice_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Mean condensed nDCG by method within slices: ambiguous, with measures, with brand, with digits, length bucket, source and traffic bucket."""
    per = E.retrieval_metrics(search._served_ranks(spark, sf), search._judged(spark, sf), "request_id").where("ndcg_cond IS NOT NULL")
    served = search._responses(spark, sf).select("request_id", "served_by").distinct()
    q = table(spark, sf, "queries").select("query_id", "slice_ambiguous", "slice_spec")
    p = table(spark, sf, "parsed_queries").select("query_id", (F.coalesce(F.size("brands"), F.lit(0)) > 0).alias("brand"), "has_digit", F.when(F.col("n_units") <= 2, "short").when(F.col("n_units") <= 5, "medium").otherwise("long").alias("length"))
    source = table(spark, sf, "judgments").groupBy("query_id").agg(F.coalesce(F.min("source"), F.lit("other")).alias("source"))
    traffic = graphs.query_popularity(spark, sf).select("query_id", "traffic_bucket")
    rows = per.join(served, "request_id").join(q, "query_id").join(p, "query_id").join(source, "query_id", "left").join(traffic, "query_id")
    named = F.filter(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in (("slice_ambiguous", "ambiguous"), ("slice_spec", "spec"), ("brand", "brand"), ("has_digit", "digit"))], F.concat(F.lit("length="), "length"), F.concat(F.lit("source="), F.coalesce("source", F.lit("other"))), F.concat(F.lit("traffic="), "traffic_bucket")), lambda x: x.isNotNull())
    return rows.select("served_by", "ndcg_cond", F.explode(named).alias("slice")).groupBy("slice", "served_by").agg(F.round(F.avg("ndcg_cond"), 5).alias("ndcg_cond"), F.count(F.lit(1)).alias("n"))


def rrf_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The judged candidates of each request, and no others, ranked by the fused ranks of text and vectors."""
    rows = search._responses(spark, sf).join(search._judged(spark, sf).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    lists = search._ranks(rows, "bm25_text").unionByName(search._ranks(rows, "vectors"))
    fused = R.rrf(lists.select(F.col("request_id").alias("query"), F.col("doc_id").alias("doc"), "rk"))
    return top_k(fused, ["query"], [F.desc("score"), F.asc("doc")], 1 << 30).select(F.col("query").alias("request_id"), F.col("doc").alias("doc_id"), "score", F.col("rk").cast("long").alias("rk"))


def complement_departments(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three departments that complement each document's own."""
    from shelfspark.operators.ranking import top_k as best

    c = graphs.category_complements(spark, sf).where("src_category <> dst_category")
    three = best(c, ["src_category"], [F.desc("weight"), F.asc("dst_category")], 3)
    docs = table(spark, sf, "catalog").where("category IS NOT NULL AND category <> 'Unknown'").select("doc_id", F.col("category").alias("src_category"))
    return docs.join(three, "src_category").select("doc_id", F.col("dst_category").alias("category"), F.col("rk").cast("long").alias("rk"))


def autocomplete(spark: SparkSession, sf: str) -> DataFrame:
    """For every beginning of two to eight letters of a query text, the five texts most asked."""
    counts = table(spark, sf, "judgments").select(T.for_matching(F.col("query"), False).alias("text")).where(F.char_length("text") >= 2).groupBy("text").agg(F.count(F.lit(1)).alias("traffic"))
    lengths = F.explode(F.sequence(F.lit(2), F.least(F.char_length("text"), F.lit(8))))
    each = counts.withColumn("n", lengths).select("text", "traffic", F.substring("text", F.lit(1), F.col("n")).alias("prefix"))
    return top_k(each, ["prefix"], [F.desc("traffic"), F.asc("text")], 5).withColumn("rk", F.col("rk").cast("long"))


_V = f"voc AS (SELECT term, sum(df)::BIGINT AS df FROM df GROUP BY 1)"
_U = "(('0x' || left(md5(concat_ws('|', {0})), 8))::BIGINT::DOUBLE / 4294967296.0)"


def _sql_fix(words: str) -> str:
    """``fix`` (term, n0, suggestion, n) for the distinct ``term`` of ``words``."""
    return f"""fs AS (SELECT term, coalesce(df, 0) AS n0 FROM (SELECT DISTINCT term FROM {words}) LEFT JOIN voc USING (term) WHERE regexp_matches(term, '^[a-zß-˿]+$') AND length(term) >= 4),
      fd AS (SELECT *, CASE WHEN n0 < 3 THEN 20 * greatest(n0, 1) WHEN n0 <= 50 THEN 200 * n0 END AS need FROM fs),
      fk AS (SELECT term AS suggestion, df AS n FROM voc WHERE df >= 5 AND length(term) >= 3 AND regexp_matches(term, '^[a-zß-˿]+$')),
      fix AS (SELECT term, n0, suggestion, n FROM fd JOIN fk ON suggestion <> term AND n >= need AND abs(length(term) - length(suggestion)) <= 1 AND damerau_levenshtein(translate(term, 'áéíóúñüçàèò', 'AEIOUNXCBDF'), translate(suggestion, 'áéíóúñüçàèò', 'AEIOUNXCBDF')) <= 1
        QUALIFY row_number() OVER (PARTITION BY term ORDER BY n DESC, suggestion) = 1)"""


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_COND_OF = search._COND.replace("v AS (SELECT", "{v} AS (SELECT")
_A = ", ".join(f"coalesce(attrs['{k}'], []) AS q_{k}" for k in _TYPES)
_B = ", ".join(f"coalesce(attr_{k}, []) AS d_{k}" for k in _TYPES)
_EXCLUDED = "CASE locale " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EXCLUSIONS.items()) + " ELSE '' END"
_NEG = r"\b(?:without|w/o|no|non|not|sin|except|excluding|free of)\b\s+((?:\p{L}{2,}\s?){1,2})"


def _sql_negated(n: str) -> str:
    words = f"list_filter(flatten(list_transform(regexp_extract_all({n}, '{_NEG}', 1), lambda m: regexp_split_to_array(trim(m), '\\s+'))), lambda w: w <> '' AND w NOT IN ({_STOP}))"
    return f"list_transform({words}, lambda w: {sql_stem('w')})"


QUERIES = {
    f.__name__: f
    for f in (typo_corrections, corrected_queries, query_brands, planted_negations, ranking_features, robustness, paired_interval, depth_sweep, alpha_grid, degradation_chain, slice_metrics, rrf_rerank, complement_departments, autocomplete)
}
SQL = {
    "typo_corrections": f"""WITH {search._I}, {_V}, ty AS (SELECT {graphs._sql_typo('term', _U.format("term, 'kind'"), _U.format("term, 'place'"))} AS term FROM voc WHERE df >= 20 AND regexp_matches(term, '{LATIN}')), {_sql_fix('ty')} SELECT term, n0, suggestion, n FROM fix""",
    "corrected_queries": f"""WITH {search._I}, {_V}, qw AS (SELECT query_id, string_split(trim(regexp_replace({sql_normalize('query')}, '[\\s\\p{{Z}}]+', ' ', 'g')), ' ') AS w FROM queries),
      qa AS (SELECT *, list_position(list_transform(w, lambda x: regexp_matches(x, '{LATIN}')), true) AS at1 FROM qw),
      qt2 AS (SELECT query_id, list_transform(w, lambda x, i: CASE WHEN i = at1 THEN {graphs._sql_typo('x', _U.format("query_id::VARCHAR, 'kind'"), _U.format("query_id::VARCHAR, 'place'"))} ELSE x END) AS w FROM qa),
      ow AS (SELECT query_id, unnest(w) AS raw, generate_subscripts(w, 1) AS i FROM qt2), os AS (SELECT *, {sql_stem('raw')} AS st FROM ow),
      pr AS (SELECT DISTINCT unnest(string_split(brand_norm, ' ')) AS term FROM catalog WHERE brand_norm IS NOT NULL),
      wanted AS (SELECT raw AS term FROM os UNION SELECT st FROM os), {_sql_fix('wanted')}, fx AS (SELECT * FROM fix WHERE term NOT IN (SELECT term FROM pr)),
      m AS (SELECT os.*, CASE WHEN st NOT IN ({_STOP}) AND (coalesce(vs.df, 0) < 3 OR coalesce(vs.df, 0) <= 50) THEN
        CASE WHEN a.suggestion IS NOT NULL AND a.suggestion <> st AND (b.suggestion IS NULL OR b.suggestion = st OR a.n > b.n OR (a.n = b.n AND a.suggestion <= b.suggestion)) THEN a.suggestion WHEN b.suggestion <> st THEN b.suggestion END END AS s
        FROM os LEFT JOIN voc vs ON vs.term = st LEFT JOIN fx a ON a.term = st LEFT JOIN fx b ON b.term = raw)
      SELECT query_id, string_agg(raw, ' ' ORDER BY i) AS text, string_agg(CASE WHEN s IS NOT NULL THEN raw || ' ' || s ELSE raw END, ' ' ORDER BY i) AS expanded, string_agg(coalesce(s, raw), ' ' ORDER BY i) AS replaced, count(s) AS changes FROM m GROUP BY 1""",
    "query_brands": """WITH b AS (SELECT locale, brand_norm AS name FROM catalog WHERE brand_norm IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
      t AS (SELECT query_id, locale, norm, ' ' || array_to_string(list_filter(regexp_split_to_array(regexp_replace(norm, '[^\\p{L}\\p{N}\\p{M}_]+', ' ', 'g'), ' '), lambda w: w <> ''), ' ') || ' ' AS p FROM parsed_queries),
      f AS (SELECT query_id, t.locale, name AS brand FROM t JOIN b ON t.locale = b.locale AND CASE WHEN t.locale = 'jp' THEN contains(norm, name) ELSE contains(p, ' ' || name || ' ') END)
      SELECT * FROM f QUALIFY locale <> 'jp' OR row_number() OVER (PARTITION BY query_id ORDER BY length(brand) DESC, brand) <= 5""",
    "planted_negations": f"""WITH a AS (SELECT query_id, trim(regexp_replace({sql_normalize("concat_ws(' ', query, " + _EXCLUDED + ")")}, '[\\s\\p{{Z}}]+', ' ', 'g')) AS n FROM queries), b AS (SELECT query_id, n, {_sql_negated('n')} AS l FROM a)
      SELECT query_id, regexp_matches(n, '\\b(?:without|w/o|not|non|no|sin|except|excluding|free of)\\b|なし|無し|不要|以外') AS has_negation, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS negated FROM b""",
    "ranking_features": f"""WITH {search._LEXICAL}, {graphs._RR}, {graphs._JJ}, {graphs._shown('scores').replace('s AS (SELECT request_id', 'sh AS (SELECT request_id', 1).replace('FROM s s LEFT', 'FROM sh s LEFT')},
      fb AS (SELECT query_id, doc_id, count(*) AS impressions, count(*) FILTER (WHERE clicked) AS clicks, count(*) FILTER (WHERE carted) AS carts, count(*) FILTER (WHERE bought) AS buys, round(sum(clicked::INT / p), 5) AS ic, round(sum(1.0::DOUBLE / p), 5) AS ii,
        count(*) FILTER (WHERE thumb = 1) AS up, count(*) FILTER (WHERE thumb = -1) AS dn FROM i GROUP BY ALL), fq AS (SELECT query_id, sum(impressions) AS n FROM fb GROUP BY 1), pri AS (SELECT sum(clicks) / sum(impressions) AS prior FROM fb),
      pq AS (SELECT query_id, n_units, has_digit, has_negation, locale, pack_count, list_transform(coalesce(brands, []), lambda b: lower(b)) AS qb, {_A}, {_sql_negated(sql_normalize('text'))} AS neg FROM parsed_queries),
      pc AS (SELECT doc_id, {_B}, attr_pack_count AS dp, brand_norm, {sql_terms('title')} AS terms, is_sparse, richness_chars, n_title_chars, is_title_only, category, category_conf FROM catalog),
      e AS (SELECT DISTINCT query_id, doc_id FROM jj WHERE esci_label = 'E'), cn AS (SELECT query_id, category, count(*) AS n FROM e JOIN catalog USING (doc_id) WHERE category IS NOT NULL AND category <> 'Unknown' GROUP BY ALL),
      cp AS (SELECT query_id, category, n / sum(n) OVER (PARTITION BY query_id) AS p FROM cn), ce AS (SELECT query_id, round(abs(sum(p * log2(p))), 6) AS q_cat_entropy, round(max(p), 6) AS q_cat_top FROM cp GROUP BY 1)
      SELECT lex.*, n_units AS q_n_units, coalesce(has_digit, false)::INT AS q_has_digit, len(qb) AS q_n_brands, {' + '.join(f'(len(q_{k}) > 0)::INT' for k in _TYPES)} + (pack_count IS NOT NULL)::INT AS q_n_attrs, coalesce(has_negation, false)::INT AS q_has_negation,
        CASE pq.locale WHEN 'us' THEN 0 WHEN 'es' THEN 1 WHEN 'jp' THEN 2 ELSE -1 END AS locale_code,
        {', '.join(f"(len(q_{k}) > 0)::INT AS {k}_q, list_has_any(q_{k}, d_{k})::INT AS {k}_match, (len(q_{k}) > 0 AND len(d_{k}) > 0 AND NOT list_has_any(q_{k}, d_{k}))::INT AS {k}_conflict" for k in _TYPES)},
        (pack_count IS NOT NULL)::INT AS pack_q, coalesce(pack_count = dp, false)::INT AS pack_match, coalesce(pack_count <> dp AND dp > 0, false)::INT AS pack_conflict,
        (len(qb) > 0)::INT AS brand_q, coalesce(list_contains(qb, brand_norm), false)::INT AS brand_match, (len(qb) > 0 AND brand_norm IS NOT NULL AND NOT coalesce(list_contains(qb, brand_norm), false))::INT AS brand_conflict, list_has_any(neg, terms)::INT AS neg_violation,
        coalesce(is_sparse, false)::INT AS is_sparse, round(ln(1 + coalesce(richness_chars, 0)), 6) AS log_richness, coalesce(n_title_chars, 0) AS title_len, coalesce(is_title_only, false)::INT AS title_only, coalesce(pc.category <> 'Unknown', false)::INT AS cat_known, coalesce(category_conf, 0) AS cat_conf,
        q_cat_entropy, q_cat_top, round(cp.p, 6) AS p_cat, round(ln(1 + coalesce(impressions, 0)), 6) AS fb_log_impressions, round((coalesce(ic, 0) + 20 * prior) / (coalesce(ii, 0) + 20), 6) AS fb_ctr, round((coalesce(carts, 0) + 0.5::DOUBLE) / (coalesce(clicks, 0) + 10), 6) AS fb_cart,
        round((coalesce(buys, 0) + 0.2::DOUBLE) / (coalesce(clicks, 0) + 10), 6) AS fb_buy, round((coalesce(up, 0) - coalesce(dn, 0)) / (coalesce(up, 0) + coalesce(dn, 0) + 2.0::DOUBLE), 6) AS fb_thumbs, round(ln(1 + coalesce(fq.n, 0)), 6) AS fb_log_query
      FROM lex JOIN pq USING (query_id) JOIN pc USING (doc_id) CROSS JOIN pri LEFT JOIN fb ON fb.query_id = lex.query_id AND fb.doc_id = lex.doc_id LEFT JOIN fq ON fq.query_id = lex.query_id LEFT JOIN ce ON ce.query_id = lex.query_id LEFT JOIN cp ON cp.query_id = lex.query_id AND cp.category = pc.category""",
    "paired_interval": f"""WITH {search._R}, {search._J}, {search._IDEAL},
      s AS (SELECT 2 * request_id + 1 AS request_id, query_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY bm25_text DESC, doc_id) AS rk FROM r WHERE bm25_text IS NOT NULL
        UNION ALL SELECT 2 * request_id, query_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY vectors DESC, doc_id) FROM r WHERE vectors IS NOT NULL), {search._COND},
      w AS (SELECT query_id, avg(ndcg_cond) FILTER (WHERE request_id % 2 = 0) - avg(ndcg_cond) FILTER (WHERE request_id % 2 = 1) AS d FROM v GROUP BY query_id), d AS (SELECT query_id, locale, d FROM w JOIN queries USING (query_id) WHERE d IS NOT NULL),
      k AS (SELECT *, {_U.format("query_id::VARCHAR, draw::VARCHAR")} AS u FROM d CROSS JOIN (SELECT unnest(range(1, 101)) AS draw)),
      p AS (SELECT locale, draw, {' + '.join(f'(u >= {t!r}::DOUBLE)::INT' for t in E.poisson_steps())} AS c, d FROM k), n AS (SELECT locale, draw, sum(c * d) / nullif(sum(c), 0) AS m FROM p GROUP BY ALL),
      bb AS (SELECT locale, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, round(avg((m <= 0)::INT), 6) AS p FROM n WHERE m IS NOT NULL GROUP BY 1)
      SELECT locale, round(avg(d), 6) AS delta, count(*) AS n, lo, hi, p FROM d JOIN bb USING (locale) GROUP BY ALL""",
    "depth_sweep": f"""WITH {search._R}, {search._J}, {search._IDEAL}, t AS (SELECT request_id, query_id, doc_id, vectors, row_number() OVER (PARTITION BY request_id ORDER BY bm25_text DESC, doc_id) AS rk FROM r WHERE bm25_text IS NOT NULL),
      d AS (SELECT *, unnest([0, 5, 10, 20]) AS depth FROM t),
      s AS (SELECT request_id * 100 + depth AS request_id, query_id, doc_id, row_number() OVER (PARTITION BY request_id, depth ORDER BY (rk <= depth) DESC, CASE WHEN rk <= depth THEN vectors END DESC NULLS LAST, CASE WHEN rk > depth THEN rk END NULLS FIRST, doc_id) AS rk FROM d), {search._COND}
      SELECT request_id % 100 AS depth, round(avg(ndcg_cond), 5) AS ndcg_cond, count(ndcg_cond) AS n FROM v GROUP BY 1""",
    "rrf_rerank": f"""WITH {search._R}, {search._J}, q AS (SELECT r.* FROM r SEMI JOIN j USING (query_id, doc_id)), a AS (SELECT request_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY bm25_text DESC, doc_id) AS rk FROM q WHERE bm25_text IS NOT NULL
      UNION ALL SELECT request_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY vectors DESC, doc_id) FROM q WHERE vectors IS NOT NULL), s AS (SELECT request_id, doc_id, round(sum(1.0::DOUBLE / (60 + rk)), 9) AS score FROM a GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id) AS rk FROM s""",
    "complement_departments": f"""WITH {graphs._EDGES}, c AS (SELECT doc_id, category FROM catalog WHERE category IS NOT NULL AND category <> 'Unknown'),
      w AS (SELECT cs.category AS a, cd.category AS b, sum(support) AS weight FROM ed JOIN c cs ON cs.doc_id = src_doc JOIN c cd ON cd.doc_id = dst_doc WHERE relation = 'complement' AND cs.category <> cd.category GROUP BY ALL),
      t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS rk FROM w QUALIFY rk <= 3) SELECT doc_id, b AS category, rk FROM c JOIN t ON a = category""",
    "slice_metrics": f"""WITH {search._R}, {search._J}, {search._RANK.format(c='scores')}, {search._IDEAL}, {search._COND}, so AS (SELECT query_id, coalesce(min(source), 'other') AS source FROM judgments GROUP BY 1),
      pa AS (SELECT query_id, row_number() OVER (ORDER BY n_e DESC, query_id) AS k FROM queries), pb AS (SELECT *, power(k::DOUBLE, -0.8) / sum(power(k::DOUBLE, -0.8)) OVER () AS s FROM pa), pc AS (SELECT *, round(coalesce(sum(s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS b FROM pb),
      x2 AS (SELECT served_by, ndcg_cond, unnest(list_filter([CASE WHEN slice_ambiguous THEN 'ambiguous' END, CASE WHEN slice_spec THEN 'spec' END, CASE WHEN coalesce(len(brands), 0) > 0 THEN 'brand' END, CASE WHEN has_digit THEN 'digit' END,
        'length=' || CASE WHEN n_units <= 2 THEN 'short' WHEN n_units <= 5 THEN 'medium' ELSE 'long' END, 'source=' || coalesce(source, 'other'), 'traffic=' || CASE WHEN b < 0.3 THEN 'head' WHEN b < 0.7 THEN 'torso' ELSE 'tail' END], lambda s: s IS NOT NULL)) AS slice
        FROM v JOIN (SELECT DISTINCT request_id, served_by FROM r) USING (request_id) JOIN queries USING (query_id) JOIN parsed_queries USING (query_id) LEFT JOIN so USING (query_id) JOIN pc USING (query_id) WHERE ndcg_cond IS NOT NULL)
      SELECT slice, served_by, round(avg(ndcg_cond), 5) AS ndcg_cond, count(*) AS n FROM x2 GROUP BY ALL""",
    "robustness": f"""WITH {search._sql_index('title')}, {graphs._SQL_VARIANTS}, {search._J}, {search._IDEAL}, vt AS (SELECT 2 * query_id AS request_id, query_id, locale AS g, query AS text FROM variants WHERE variant <> 'none' UNION ALL SELECT 2 * query_id + 1, query_id, locale, text FROM variants WHERE variant <> 'none'),
      qt AS (SELECT request_id, query_id, g, unnest({sql_terms('text')}) AS term FROM vt), qf AS (SELECT request_id, query_id, g, term, count(*) AS qtf FROM qt GROUP BY ALL), sc AS (SELECT request_id, query_id, doc AS doc_id, round(sum(w * qtf), 6) AS score FROM qf JOIN ix USING (g, term) GROUP BY ALL),
      s AS (SELECT request_id, query_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id) AS rk FROM sc QUALIFY rk <= 20), {search._COND}
      SELECT variant, count(*) AS n, round(avg(a.ndcg_cond), 5) AS plain, round(avg(coalesce(b.ndcg_cond, 0)), 5) AS varied FROM variants JOIN v a ON a.request_id = 2 * variants.query_id LEFT JOIN v b ON b.request_id = 2 * variants.query_id + 1 WHERE variant <> 'none' AND a.ndcg_cond IS NOT NULL GROUP BY 1""",
    "autocomplete": """WITH t AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(query, '')), '[’`´]', '''', 'g'), '(\\d),(\\d{3})\\b', '\\1\\2', 'g'), '(\\d),(\\d)', '\\1.\\2', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) AS text FROM judgments),
      c AS (SELECT text, count(*) AS traffic FROM t WHERE length(text) >= 2 GROUP BY text), p AS (SELECT text, traffic, left(text, unnest(range(2, least(length(text), 8) + 1))::INT) AS prefix FROM c)
      SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY traffic DESC, text) AS rk FROM p QUALIFY rk <= 5""",
    "negated_queries": f"""WITH a AS (SELECT query_id, trim(regexp_replace({sql_normalize('query')}, '[\\s\\p{{Z}}]+', ' ', 'g')) AS n FROM queries), b AS (SELECT query_id, n, {_sql_negated('n')} AS l FROM a)
      SELECT query_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS negated FROM b WHERE regexp_matches(n, '\\b(?:without|w/o|not|non|no|sin|except|excluding|free of)\\b|なし|無し|不要|以外')""",
    "ndcg_bootstrap": f"""WITH {search._R}, {search._J}, {search._RANK.format(c='scores')}, {search._IDEAL}, {search._COND}, d AS (SELECT request_id, served_by, ndcg_cond AS d FROM v JOIN (SELECT DISTINCT request_id, served_by FROM r) USING (request_id)),
      k AS (SELECT *, {_U.format("request_id::VARCHAR, draw::VARCHAR")} AS u FROM d CROSS JOIN (SELECT unnest(range(1, 101)) AS draw) WHERE d IS NOT NULL),
      p AS (SELECT served_by, draw, {' + '.join(f'(u >= {t!r}::DOUBLE)::INT' for t in E.poisson_steps())} AS c, d FROM k), n AS (SELECT served_by, draw, sum(c * d) / nullif(sum(c), 0) AS m FROM p GROUP BY ALL),
      bb AS (SELECT served_by, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM n GROUP BY 1)
      SELECT served_by, round(avg(d), 6) AS mean, count(d) AS n, lo, hi FROM d JOIN bb USING (served_by) GROUP BY ALL""",
    "degradation_chain": f"""WITH {search._R}, p AS (SELECT request_id, served_by, count(bm25_text) AS t, count(vectors) AS v, count(scores) AS s, {_U.format("request_id::VARCHAR, 'budget'")} < 0.1 AS late FROM r GROUP BY ALL)
      SELECT request_id, served_by, CASE WHEN s > 0 AND NOT late THEN 'model' WHEN t > 0 AND v > 0 THEN 'hybrid' WHEN t > 0 THEN 'text' WHEN v > 0 THEN 'vectors' ELSE 'none' END AS method, CASE WHEN s > 0 AND NOT late THEN '' WHEN s > 0 THEN 'budget' ELSE 'no scores' END AS reason FROM p""",
    "alpha_grid": f"""WITH {search._R}, {search._J}, {search._IDEAL}, c AS (SELECT request_id, query_id, doc_id, bm25_text AS b, vectors AS v FROM r WHERE bm25_text IS NOT NULL OR vectors IS NOT NULL),
      z AS (SELECT request_id, query_id, doc_id, coalesce(CASE WHEN count(v) OVER w >= 2 AND stddev_pop(v) OVER w > 1e-9 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE 0 END, 0) AS zv,
        coalesce(CASE WHEN count(b) OVER w >= 2 AND stddev_pop(b) OVER w > 1e-9 THEN (b - avg(b) OVER w) / stddev_pop(b) OVER w ELSE 0 END, 0) AS zb FROM c WINDOW w AS (PARTITION BY request_id)),
      g AS (SELECT *, unnest([0, 25, 35, 50, 75, 100]) AS a FROM z), h AS (SELECT request_id, query_id, doc_id, a, round((a / 100.0::DOUBLE) * zv + (1 - a / 100.0::DOUBLE) * zb, 6) AS s0 FROM g),
      s AS (SELECT request_id * 1000 + a AS request_id, query_id, doc_id, row_number() OVER (PARTITION BY request_id, a ORDER BY s0 DESC, doc_id) AS rk FROM h), {search._COND},
      o AS (SELECT (request_id % 1000) / 100.0::DOUBLE AS alpha, round(avg(ndcg_cond), 5) AS ndcg_cond, count(ndcg_cond) AS n FROM v GROUP BY 1)
      SELECT *, row_number() OVER (ORDER BY ndcg_cond DESC, alpha) = 1 AS best FROM o""",
}
