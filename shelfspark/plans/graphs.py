"""Queries: product and query graphs, simulated behaviour, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import draws as D
from shelfspark.operators import graph as G
from shelfspark.operators import simulation as S
from shelfspark.operators.evaluation import uniform
from shelfspark.plans.search import _judged, _ranks, _responses
from shelfspark.sources.tables import table


def product_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Co-exact, substitute and complement edges of the judged pairs."""
    return G.product_edges(table(spark, sf, "jj").distinct())


def category_complements(spark: SparkSession, sf: str) -> DataFrame:
    """Which categories complement which, with their share."""
    return G.category_complements(product_edges(spark, sf), table(spark, sf, "catalog"))


def related_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty queries that share most E documents with each query."""
    return G.related_queries(table(spark, sf, "jj")).withColumn("rk", F.col("rk").cast("long"))


def co_purchase_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Parts ordered together at least twice."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    pairs = rows.join(rows.withColumnRenamed("l_partkey", "other"), "l_orderkey").where("l_partkey < other")
    return pairs.groupBy("l_partkey", "other").agg(F.count(F.lit(1)).alias("support")).where("support >= 2")


def neighbour_products(spark: SparkSession, sf: str) -> DataFrame:
    """Up to eight substitutes of every document, by support."""
    from shelfspark.operators.ranking import top_k

    edges = product_edges(spark, sf).where("relation = 'substitute'")
    return top_k(edges.select("src_doc", "dst_doc", "support"), ["src_doc"], [F.desc("support"), F.asc("dst_doc")], 8).withColumn("rk", F.col("rk").cast("long"))


def simulated_impressions(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks and carts per shown position."""
    shown = S.impressions(_ranks(_responses(spark, sf), "scores"), _judged(spark, sf))
    return shown.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("clicked").cast("int")).alias("clicks"), F.sum(F.col("carted").cast("int")).alias("carts")).withColumn("position", F.col("position").cast("long"))


def ips_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Inverse-propensity feedback of every query and document."""
    out = S.ips_feedback(S.impressions(_ranks(_responses(spark, sf), "scores"), _judged(spark, sf)))
    return out.withColumn("best_position", F.col("best_position").cast("long"))


def query_popularity(spark: SparkSession, sf: str) -> DataFrame:
    """Traffic shares and buckets of the queries by their number of E documents."""
    return S.popularity(table(spark, sf, "queries").select("query_id", "n_e"), "n_e")


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user (gap over 30 minutes): events, clicks, first and last time."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(own)
    rows = table(spark, sf, "events").withColumn("session", F.sum(F.when(gap > 1800, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("clicks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def session_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Place of each event in its user's day and the event before."""
    own = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.row_number().over(own).cast("long").alias("seq"), F.lag("event_id").over(own).alias("prev_event_id"))


_MODIFIER = {"us": "cheap", "es": "barato", "jp": "安い"}


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "queries").select("query_id", "query", "locale")
    u = uniform("query_id", F.lit("variant"))
    words = F.split(F.trim(F.regexp_replace("query", " +", " ")), " ")
    many = F.size(words) > 1
    swapped = F.array_join(F.concat(F.slice(words, 2, F.size(words)), F.slice(words, 1, 1)), " ")
    dropped = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " ")
    first = F.get(words, 0)
    mistyped = F.array_join(F.concat(F.array(D.typo(first, uniform("query_id", F.lit("typo")), uniform("query_id", F.lit("place")))), F.slice(words, 2, F.size(words))), " ")
    modified = F.concat_ws(" ", "query", F.coalesce(*[F.when(F.col("locale") == k, F.lit(v)) for k, v in _MODIFIER.items()]))
    kind = F.when(u < 0.12, "case_space").when(u < 0.24, F.when(many, "reorder").otherwise("typo")).when(u < 0.36, F.when(many, "token_drop").otherwise("typo")).when(u < 0.48, "typo").when(u < 0.55, "modifier").otherwise("none")
    rows = q.withColumn("variant", kind)
    text = F.coalesce(*[F.when(F.col("variant") == k, t) for k, t in (("case_space", F.upper("query")), ("reorder", swapped), ("token_drop", dropped), ("typo", mistyped), ("modifier", modified))], F.col("query"))
    return rows.select("query_id", "locale", "variant", text.alias("text"), "query")


def replay_variants(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of query texts, half of them varied: set in capitals, words swapped or dropped, mistyped, with a modifier; times spread over a day."""
    at = F.floor(uniform("query_id", F.lit("time")) * 86400).cast("long")
    return _variants(spark, sf).select("query_id", "variant", "text", at.alias("second_of_day"))


def _shown_now(spark: SparkSession, sf: str) -> DataFrame:
    return S.impressions(_ranks(_responses(spark, sf), "scores"), _judged(spark, sf))


def ctr_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Click rate by label: impressions, the query's table and the judgments met."""
    shown = _shown_now(spark, sf).join(table(spark, sf, "queries").select("query_id", "locale"), "query_id")
    labels = _judged(spark, sf).select("query_id", "doc_id", "esci_label")
    return shown.join(labels, ["query_id", "doc_id"]).groupBy("locale", "esci_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("clicked").cast("double")), 6).alias("ctr"))


def first_clicks(spark: SparkSession, sf: str) -> DataFrame:
    """The first position clicked in each request that has a click, and the clicks behind it."""
    return _shown_now(spark, sf).where("clicked").groupBy("request_id").agg(F.min("position").cast("long").alias("first_click"), F.count(F.lit(1)).alias("clicks"))


def noisy_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """The logging policy: candidates of each request ranked by their score with Gumbel noise; in a twentieth of the requests the first ten are shuffled."""
    u = uniform("request_id", "doc_id", F.lit("noise"))
    noisy = F.round(F.col("scores") - 0.2 * F.ln(-F.ln(F.greatest(u, F.lit(1e-9)))), 9)
    rows = _responses(spark, sf).where("scores IS NOT NULL AND abs(scores) < 1e9").select("request_id", "doc_id", noisy.alias("s"))
    own = Window.partitionBy("request_id").orderBy(F.desc("s"), F.asc("doc_id"))
    explore = uniform("request_id", F.lit("explore")) < S.EXPLORE
    rows = rows.withColumn("at", F.row_number().over(own)).withColumn("shuffled", F.when(explore & (F.col("at") <= 10), uniform("request_id", "doc_id", F.lit("shuffle"))).otherwise(F.col("at").cast("double")))
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy("request_id").orderBy("shuffled", "doc_id")).cast("long")).where("rk <= 20").select("request_id", "doc_id", "rk")


def stream_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Share of requests an ideal cache would answer, by raw text and by query and method."""
    rows = table(spark, sf, "search_response").select("request_id", "query_id", "served_by", "locale").distinct()
    return rows.groupBy("locale").agg(F.count(F.lit(1)).alias("n"), F.round(1 - F.countDistinct("query_id") / F.count(F.lit(1)), 6).alias("hit_query"), F.round(1 - F.countDistinct("query_id", "served_by") / F.count(F.lit(1)), 6).alias("hit_query_method"))


def simulated_ab(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks, carts and purchases per request of the text and the vector ranking under common random numbers, unjudged documents taken as I, C or S."""
    rows, judged = _responses(spark, sf), _judged(spark, sf)
    arms = None
    for s in ("bm25_text", "vectors"):
        for taken in "ICS":
            one = S.impressions(_ranks(rows, s), judged, taken).withColumn("arm", F.lit(s)).withColumn("unjudged_as", F.lit(taken))
            arms = one if arms is None else arms.unionByName(one)
    per = arms.groupBy("arm", "unjudged_as", "request_id").agg(F.sum(F.col("clicked").cast("int")).alias("c"), *[F.max(F.col(x).cast("int")).alias(x) for x in ("carted", "bought")])
    return per.groupBy("arm", "unjudged_as").agg(F.count(F.lit(1)).alias("n_requests"), F.round(F.avg("c"), 6).alias("clicks"), *[F.round(F.avg(F.col(x).cast("double")), 6).alias(x) for x in ("carted", "bought")])


_RR = "r AS (SELECT request_id, query_id, doc_id, max(bm25_text::DOUBLE) AS bm25_text, max(vectors::DOUBLE) AS vectors, max(scores::DOUBLE) AS scores FROM search_response GROUP BY ALL)"
_JJ = "j AS (SELECT query_id, doc_id, max(gain) AS gain, min(esci_label) AS esci_label FROM judgments WHERE gain IS NOT NULL GROUP BY ALL)"
_U = "(('0x' || left(md5(concat_ws('|', {0})), 8))::BIGINT::DOUBLE / 4294967296.0)"


def _shown(score: str, tail: str = "", unjudged: str = "I") -> str:
    u = lambda what: _U.format(f"request_id::VARCHAR, doc_id, '{what}'")
    of = lambda t: "CASE l " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in t.items()) + f" ELSE {t['I']}::DOUBLE END"
    w = f"greatest(least({u('dwell')}, 0.999999::DOUBLE), 0.000001::DOUBLE)"
    return f"""s{tail} AS (SELECT request_id, query_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY {score} DESC, doc_id) AS rk FROM r WHERE {score} IS NOT NULL),
      l{tail} AS (SELECT s.*, coalesce(esci_label, '{unjudged}') AS l FROM s{tail} s LEFT JOIN j USING (query_id, doc_id)),
      m{tail} AS (SELECT request_id, query_id, doc_id, l, rk AS position, 1.0::DOUBLE / rk AS p, {u('exam')} < 1.0::DOUBLE / rk AS examined, {u('click')} < {of(S.ATTRACTION)} AS k0, {u('cart')} < {of(S.CART)} AS c0, {u('buy')} < {of(S.BUY)} AS b0,
        exp({of(S.DWELL)} + 0.8::DOUBLE * ln({w} / (1 - {w})) / 1.702::DOUBLE) AS d0, {u('said')} < {S.SAID} AS s0, ({u('agree')} < {S.AGREED}) = (l IN ('E', 'S')) AS a0, {_U.format("request_id::VARCHAR, 'explore'")} < {S.EXPLORE} AS explore FROM l{tail}),
      i{tail} AS (SELECT request_id, query_id, doc_id, l, position, p, explore, examined AND k0 AS clicked, examined AND k0 AND c0 AS carted, examined AND k0 AND c0 AND b0 AS bought, CASE WHEN examined AND k0 THEN d0 END AS dwell,
        CASE WHEN examined AND s0 THEN CASE WHEN a0 THEN 1 ELSE -1 END ELSE 0 END AS thumb FROM m{tail})"""


def _sql_typo(word: str, kind: str, place: str) -> str:
    i = f"(floor({place} * (length({word}) - 2)) + 2)::INT"
    head, here, tail = f"left({word}, {i} - 1)", f"substr({word}, {i}, 1)", f"substr({word}, {i} + 1)"
    return f"CASE WHEN length({word}) < 4 THEN {word} WHEN {kind} < 1.0::DOUBLE / 3 THEN {head} || substr({word}, {i} + 1, 1) || {here} || substr({word}, {i} + 2) WHEN {kind} < 2.0::DOUBLE / 3 THEN {head} || {tail} ELSE {head} || {here} || {here} || {tail} END"


_u_query = lambda what: _U.format(f"query_id::VARCHAR, '{what}'")
_SQL_VARIANTS = f"""va AS (SELECT query_id, query, locale, {_u_query('variant')} AS u, string_split(trim(regexp_replace(query, ' +', ' ', 'g'), ' '), ' ') AS w FROM queries),
      vb AS (SELECT *, CASE WHEN u < 0.12 THEN 'case_space' WHEN u < 0.24 THEN CASE WHEN len(w) > 1 THEN 'reorder' ELSE 'typo' END WHEN u < 0.36 THEN CASE WHEN len(w) > 1 THEN 'token_drop' ELSE 'typo' END WHEN u < 0.48 THEN 'typo' WHEN u < 0.55 THEN 'modifier' ELSE 'none' END AS variant FROM va),
      variants AS (SELECT query_id, locale, variant, CASE variant WHEN 'case_space' THEN upper(query) WHEN 'reorder' THEN array_to_string(list_concat(w[2:], w[1:1]), ' ') WHEN 'token_drop' THEN array_to_string(w[1:len(w) - 1], ' ')
        WHEN 'typo' THEN array_to_string(list_concat([{_sql_typo('w[1]', _u_query('typo'), _u_query('place'))}], w[2:]), ' ') WHEN 'modifier' THEN query || ' ' || CASE locale WHEN 'us' THEN 'cheap' WHEN 'es' THEN 'barato' ELSE '安い' END ELSE query END AS text, query FROM vb)"""
_EDGES = """g AS (SELECT DISTINCT * FROM jj), e AS (SELECT query_id, doc_id FROM g WHERE esci_label = 'E' AND rk <= 25), o AS (SELECT query_id, doc_id, esci_label FROM g WHERE esci_label IN ('S', 'C')),
  p AS (SELECT a.doc_id AS src_doc, b.doc_id AS dst_doc, 'co_exact' AS relation, a.query_id FROM e a JOIN e b ON a.query_id = b.query_id AND a.doc_id < b.doc_id
    UNION ALL SELECT e.doc_id, o.doc_id, CASE esci_label WHEN 'S' THEN 'substitute' ELSE 'complement' END, query_id FROM e JOIN o USING (query_id)),
  ed AS (SELECT src_doc, dst_doc, relation, count(DISTINCT query_id) AS support, min(query_id) AS example_query_id FROM p GROUP BY ALL)"""

QUERIES = {
    f.__name__: f
    for f in (
        product_edges, category_complements, related_queries, co_purchase_edges, neighbour_products, simulated_impressions, ips_feedback, ctr_by_label, first_clicks, noisy_ranks, query_popularity,
        event_sessions, session_steps, replay_variants, stream_hit_rate, simulated_ab,
    )
}
SQL = {
    "product_edges": f"WITH {_EDGES} SELECT * FROM ed",
    "category_complements": f"""WITH {_EDGES}, c AS (SELECT doc_id, category FROM catalog WHERE category IS NOT NULL AND category <> 'Unknown'),
      w AS (SELECT cs.category AS src_category, cd.category AS dst_category, sum(support)::BIGINT AS weight FROM ed JOIN c cs ON cs.doc_id = src_doc JOIN c cd ON cd.doc_id = dst_doc WHERE relation = 'complement' GROUP BY ALL)
      SELECT *, round(weight / sum(weight) OVER (PARTITION BY src_category), 6) AS share FROM w""",
    "related_queries": """WITH a AS (SELECT DISTINCT query_id, doc_id FROM jj WHERE esci_label = 'E'), e AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5(query_id::VARCHAR), query_id) <= 50),
      n AS (SELECT query_id, count(*) AS n FROM a GROUP BY 1), p AS (SELECT x.query_id, y.query_id AS related_query_id, count(*) AS n_shared FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.query_id <> y.query_id GROUP BY ALL),
      s AS (SELECT p.*, round(n_shared / (n1.n + n2.n - n_shared), 6) AS jaccard FROM p JOIN n n1 ON n1.query_id = p.query_id JOIN n n2 ON n2.query_id = related_query_id)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, related_query_id) AS rk FROM s QUALIFY rk <= 20""",
    "co_purchase_edges": """WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT x.l_partkey, y.l_partkey AS other, count(*) AS support FROM a x JOIN a y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey
      GROUP BY ALL HAVING count(*) >= 2""",
    "neighbour_products": f"WITH {_EDGES} SELECT src_doc, dst_doc, support, row_number() OVER (PARTITION BY src_doc ORDER BY support DESC, dst_doc) AS rk FROM ed WHERE relation = 'substitute' QUALIFY rk <= 8",
    "simulated_impressions": f"WITH {_RR}, {_JJ}, {_shown('scores')} SELECT position, count(*) AS n, count(*) FILTER (WHERE clicked) AS clicks, count(*) FILTER (WHERE carted) AS carts FROM i GROUP BY 1",
    "ips_feedback": f"""WITH {_RR}, {_JJ}, {_shown('scores')} SELECT query_id, doc_id, count(*) AS impressions, count(*) FILTER (WHERE clicked) AS clicks, count(*) FILTER (WHERE carted) AS carts, count(*) FILTER (WHERE bought) AS purchases,
      round(sum(clicked::INT / p), 5) AS ips_clicks, round(sum(1.0::DOUBLE / p), 5) AS ips_impressions, count(*) FILTER (WHERE explore) AS explore_impressions, count(*) FILTER (WHERE explore AND clicked) AS explore_clicks, round(avg(position), 6) AS avg_position,
      count(*) FILTER (WHERE thumb = 1) AS thumbs_up, count(*) FILTER (WHERE thumb = -1) AS thumbs_down, round(avg(dwell), 4) AS avg_dwell, min(position) AS best_position FROM i GROUP BY ALL""",
    "ctr_by_label": f"""WITH {_RR}, {_JJ}, {_shown('scores')} SELECT locale, esci_label, count(*) AS n, round(avg(clicked::INT::DOUBLE), 6) AS ctr FROM i JOIN queries USING (query_id) JOIN j USING (query_id, doc_id) GROUP BY ALL""",
    "first_clicks": f"WITH {_RR}, {_JJ}, {_shown('scores')} SELECT request_id, min(position) AS first_click, count(*) AS clicks FROM i WHERE clicked GROUP BY 1",
    "noisy_ranks": f"""WITH {_RR}, a AS (SELECT request_id, doc_id, round(scores - 0.2::DOUBLE * ln(-ln(greatest({_U.format("request_id::VARCHAR, doc_id, 'noise'")}, 1e-9))), 9) AS s FROM r WHERE scores IS NOT NULL AND abs(scores) < 1e9),
      b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, doc_id) AS k FROM a),
      c AS (SELECT *, CASE WHEN k <= 10 AND {_U.format("request_id::VARCHAR, 'explore'")} < {S.EXPLORE} THEN {_U.format("request_id::VARCHAR, doc_id, 'shuffle'")} ELSE k::DOUBLE END AS o FROM b)
      SELECT request_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY o, doc_id) AS rk FROM c QUALIFY rk <= 20""",
    "query_popularity": """WITH a AS (SELECT query_id, row_number() OVER (ORDER BY n_e DESC, query_id) AS pop_rank FROM queries), b AS (SELECT *, power(pop_rank::DOUBLE, -0.8) / sum(power(pop_rank::DOUBLE, -0.8)) OVER () AS s FROM a),
      c AS (SELECT *, round(coalesce(sum(s) OVER (ORDER BY pop_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS b FROM b)
      SELECT query_id, pop_rank, round(s, 9) AS traffic_share, CASE WHEN b < 0.3 THEN 'head' WHEN b < 0.7 THEN 'torso' ELSE 'tail' END AS traffic_bucket FROM c""",
    "event_sessions": """WITH a AS (SELECT *, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
      b AS (SELECT *, sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM a)
      SELECT user_id, session, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY ALL""",
    "session_steps": "SELECT event_id, row_number() OVER w AS seq, lag(event_id) OVER w AS prev_event_id FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)",
    "replay_variants": f"WITH {_SQL_VARIANTS} SELECT query_id, variant, text, floor({_U.format(chr(34) + 'query_id' + chr(34) + '::VARCHAR, ' + chr(39) + 'time' + chr(39))} * 86400)::BIGINT AS second_of_day FROM variants",
    "stream_hit_rate": """WITH a AS (SELECT DISTINCT request_id, query_id, served_by, locale FROM search_response)
      SELECT locale, count(*) AS n, round(1 - count(DISTINCT query_id) / count(*), 6) AS hit_query, round(1 - count(DISTINCT (query_id, served_by)) / count(*), 6) AS hit_query_method FROM a GROUP BY 1""",
    "simulated_ab": f"WITH {_RR}, {_JJ}, " + ", ".join(_shown(a, f"_{a}_{x}", x) for a in ("bm25_text", "vectors") for x in "ICS")
    + ", u AS (" + " UNION ALL ".join(f"SELECT '{a}' AS arm, '{x}' AS unjudged_as, * FROM i_{a}_{x}" for a in ("bm25_text", "vectors") for x in "ICS")
    + """), p AS (SELECT arm, unjudged_as, request_id, count(*) FILTER (WHERE clicked) AS c, max(carted::INT) AS carted, max(bought::INT) AS bought FROM u GROUP BY ALL)
      SELECT arm, unjudged_as, count(*) AS n_requests, round(avg(c), 6) AS clicks, round(avg(carted::DOUBLE), 6) AS carted, round(avg(bought::DOUBLE), 6) AS bought FROM p GROUP BY ALL""",
}
