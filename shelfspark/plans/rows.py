"""Queries: row functions, draws, samples, quantile maps and label propagation over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import draws as D
from shelfspark.functions import text as T
from shelfspark.operators import sampling
from shelfspark.operators.evaluation import uniform
from shelfspark.operators.ranking import top_k
from shelfspark.plans.sqltext import sql_nfkc
from shelfspark.sources.tables import subset, table


def colour_in_title(spark: SparkSession, sf: str) -> DataFrame:
    """Listings by locale whose title has the colour letter for letter; unknown is no."""
    has = F.coalesce(F.contains(F.lower("title"), F.lower("color")), F.lit(False))
    return table(spark, sf, "catalog").groupBy("locale", has.alias("in_title")).agg(F.count(F.lit(1)).alias("n"))


def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of each request that pass the facet of the request's best candidate's category; an unknown one passes nothing."""
    rows = table(spark, sf, "search_response").groupBy("request_id", "doc_id").agg(F.max(F.col("scores").cast("double")).alias("s"))
    rows = rows.join(table(spark, sf, "catalog").select("doc_id", "category"), "doc_id", "left")
    facet = rows.groupBy("request_id").agg(F.max_by("category", F.struct("s", "doc_id")).alias("facet"), F.count(F.lit(1)).alias("n"))
    passed = rows.join(facet, "request_id").where(F.col("category") == F.col("facet")).groupBy("request_id").agg(F.count(F.lit(1)).alias("n_passed"))
    return facet.join(passed, "request_id", "left").select("request_id", "facet", "n", F.coalesce("n_passed", F.lit(0)).alias("n_passed"))


def existing_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The wanted columns of the queries that the table has."""
    return subset(table(spark, sf, "queries"), ["query_id", "locale", "split", "traffic", "device"])


def diagonal_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Listings and queries in one table; what one of them doesn't have is null."""
    a = table(spark, sf, "catalog").select("doc_id", "locale", "category")
    return a.unionByName(table(spark, sf, "queries").select("query_id", "locale", "split"), allowMissingColumns=True)


def stable_uniforms(spark: SparkSession, sf: str) -> DataFrame:
    """A 64-bit hash of every listing and two independent uniform numbers from it."""
    h = table(spark, sf, "catalog").select("doc_id", D.stable_hash64(F.col("doc_id"), "draw").alias("h"))
    return h.select("doc_id", F.col("h").cast("string").alias("h"), F.round(D.mixed_uniform(F.col("h"), 0), 12).alias("u0"), F.round(D.mixed_uniform(F.col("h"), 1), 12).alias("u1"))


def drawn_queries(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand queries drawn with replacement with odds by their E documents."""
    return sampling.weighted_draws(table(spark, sf, "queries").select("query_id", "n_e"), "query_id", "n_e", 1000)


def quantile_mapped(spark: SparkSession, sf: str) -> DataFrame:
    """For every query a title length drawn from the listings of its locale: their empirical quantile at a hashed uniform."""
    asked = table(spark, sf, "queries").select("query_id", "locale", uniform("query_id", F.lit("quantile")).alias("u"))
    return sampling.quantile_map(asked, "locale", "u", table(spark, sf, "catalog").select("locale", "n_title_chars"), "n_title_chars").select("query_id", "locale", F.round("value", 6).alias("value"))


def assembled_text(spark: SparkSession, sf: str) -> DataFrame:
    """The search text of every listing put together from its fields, and the part the encoder reads."""
    parts = F.filter(F.array("title", "brand", "color"), lambda x: x.isNotNull() & (F.trim(x) != ""))
    c = table(spark, sf, "catalog")
    return c.select("doc_id", F.array_join(parts, " | ").alias("doc_text"), F.substring("doc_text", F.lit(1), F.col("n_title_chars") + 200).alias("encoder_text"))


def formatted_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Query ids filled with zeros, texts cut and with capital initials."""
    q = table(spark, sf, "parsed_queries")
    return q.select("query_id", F.lpad(F.col("query_id").cast("string"), 12, "0").alias("id12"), F.initcap("norm").alias("title"), F.concat_ws("-", "locale", F.substring("norm", 1, 8)).alias("slug"))


_SUFFIXES = {"us": " - refurbished", "es": " - reacondicionado", "jp": " 整備済み"}


def distractor_titles(spark: SparkSession, sf: str) -> DataFrame:
    """A title like each title but of another product: the first number scaled, the colour swapped, or a suffix added."""
    u = uniform("doc_id", F.lit("distract"))
    t = F.coalesce("title", F.lit(""))
    number = F.regexp_extract(t, r"(\d+)", 1)
    scaled = F.regexp_replace(t, r"^(\D*)\d+", F.concat(F.lit("$1"), (F.try_add(number.try_cast("bigint") * 2, F.lit(5))).cast("string")))
    colour = F.when(F.lower("color") == "black", "white").otherwise("black")
    swapped = F.replace(t, F.col("color"), colour)
    suffix = F.coalesce(*[F.when(F.col("locale") == k, F.lit(v)) for k, v in _SUFFIXES.items()], F.lit(""))
    can_scale, can_swap = (number != "") & (F.length(number) <= 9), F.coalesce(F.contains(t, F.col("color")) & (F.col("color") != ""), F.lit(False))
    made = F.when((u < 0.4) & can_scale, scaled).when((u < 0.7) & can_swap, swapped).otherwise(F.concat(t, suffix))
    return table(spark, sf, "catalog").select("doc_id", made.alias("title"))


def category_softmax(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax of the E listings' categories of every query, and the likeliest one."""
    e = table(spark, sf, "jj").where("esci_label = 'E'").select("query_id", "doc_id").distinct()
    n = e.join(table(spark, sf, "catalog").where("category IS NOT NULL").select("doc_id", "category"), "doc_id").groupBy("query_id", "category").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("query_id")
    z = F.exp(F.col("n") - F.max("n").over(own))
    p = n.select("query_id", "category", F.round(z / F.sum(z).over(own), 6).alias("p"))
    return p.withColumn("is_best", F.row_number().over(own.orderBy(F.desc("p"), F.asc("category"))) == 1)


def title_length_z(spark: SparkSession, sf: str) -> DataFrame:
    """How many sample standard deviations of its locale each title is longer than the mean."""
    own = Window.partitionBy("locale")
    return table(spark, sf, "catalog").select("doc_id", F.round((F.col("n_title_chars") - F.avg("n_title_chars").over(own)) / F.nullif(F.stddev_samp("n_title_chars").over(own), F.lit(0.0)), 6).alias("z"))


def propagated_categories(spark: SparkSession, sf: str) -> DataFrame:
    """A category for listings without one: that of all other E listings of the same query, if they and all such queries agree; of a query's seeds the first forty by id count."""
    e = table(spark, sf, "jj").where("esci_label = 'E'").select("query_id", "doc_id").distinct()
    known = e.join(table(spark, sf, "catalog").select("doc_id", "category"), "doc_id")
    seeds = top_k(known.where("category IS NOT NULL AND category <> 'Unknown'"), ["query_id"], [F.asc("doc_id")], 40)
    agreed = seeds.groupBy("query_id").agg(F.min("category").alias("category"), F.max("category").alias("other")).where("category = other").select("query_id", "category")
    weak = known.where("category IS NULL OR category = 'Unknown'").select("query_id", "doc_id").join(agreed, "query_id")
    return weak.groupBy("doc_id").agg(F.min("category").alias("category"), F.max("category").alias("other"), F.count(F.lit(1)).alias("n_queries")).where("category = other").drop("other")


def power_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Queries each arm needs to tell a tenth more E labels from chance (5 % two-sided, power 80 %), by locale."""
    rate = table(spark, sf, "jj").where("esci_label IS NOT NULL").groupBy("locale").agg(F.avg((F.col("esci_label") == "E").cast("double")).alias("p1")).withColumn("p2", F.least(F.col("p1") * 1.1, F.lit(1.0)))
    mean = (F.col("p1") + F.col("p2")) / 2
    spread = 1.959964 * F.sqrt(2 * mean * (1 - mean)) + 0.841621 * F.sqrt(F.col("p1") * (1 - F.col("p1")) + F.col("p2") * (1 - F.col("p2")))
    return rate.select("locale", F.round("p1", 6).alias("p1"), F.ceil(F.pow(spread / F.nullif(F.col("p2") - F.col("p1"), F.lit(0.0)), 2)).alias("n_per_arm"))


def parsed_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals and ratings written as each locale writes them, read back."""
    o = table(spark, sf, "orders")
    locale = F.when(F.col("o_custkey") % 3 == 0, "us").when(F.col("o_custkey") % 3 == 1, "es").otherwise("jp")
    us = F.format_number(F.col("o_totalprice"), 2)
    text = F.when(locale == "us", F.concat(F.lit("$"), us)).when(locale == "es", F.concat(F.translate(us, ",.", ".,"), F.lit(" €"))).otherwise(F.concat(F.lit("￥"), us))
    rating = F.round(F.col("o_orderkey") % 50 / 10 + 0.1, 1)
    stars = F.when(locale == "us", F.concat(rating.cast("string"), F.lit(" out of 5 stars"))).when(locale == "es", F.concat(F.replace(rating.cast("string"), F.lit("."), F.lit(",")), F.lit(" de 5 estrellas"))).otherwise(F.concat(F.lit("5つ星のうち"), rating.cast("string")))
    return o.select("o_orderkey", F.round(T.parse_number(text, locale), 2).alias("total"), T.parse_stars(stars, locale).alias("stars"))


def pinned_judgments(spark: SparkSession, sf: str) -> DataFrame:
    """Judgments by delivered split and by the one their query is pinned to (test where several were delivered)."""
    j = table(spark, sf, "judgments")
    pinned = j.groupBy("query_id").agg(F.when(F.countDistinct("split") > 1, "test").otherwise(F.min("split")).alias("pinned"), F.countDistinct("doc_id").alias("n_docs"))
    return j.join(pinned, "query_id").groupBy("split", "pinned").agg(F.count(F.lit(1)).alias("n"), F.max("n_docs").alias("most_docs"))


def ttl_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Share of requests a cache of fifteen minutes would answer: the query was asked at most so long before."""
    r = table(spark, sf, "search_response").select("request_id", "query_id", "locale", "ts_utc").distinct()
    own = Window.partitionBy("query_id").orderBy("ts_utc", "request_id")
    gap = F.unix_micros(F.col("ts_utc").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts_utc").cast("timestamp"))).over(own)
    return r.withColumn("hit", F.coalesce(gap <= 900_000_000, F.lit(False)).cast("int")).groupBy("locale").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"))


def scale_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Straight line through the median value of each user's events over their number, by event type."""
    per = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.median("value").alias("p50"))
    return per.groupBy("event_type").agg(F.round(F.regr_slope("p50", "n"), 6).alias("slope"), F.round(F.regr_intercept("p50", "n"), 6).alias("intercept"), F.count(F.lit(1)).alias("users"))


def matching_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and brands in matching form (compatibility form included)."""
    return table(spark, sf, "catalog").select("doc_id", T.for_matching(F.col("title")).alias("title"), T.normalize_brand(F.col("brand")).alias("brand"))


_U = "(('0x' || left(md5(concat_ws('|', {0})), 8))::BIGINT::DOUBLE / 4294967296.0)"
_M64 = "18446744073709551616::UHUGEINT"


_SQUEEZE = "trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
_GENERIC = ", ".join("'" + b.replace("'", "''") + "'" for b in T.GENERIC_BRANDS)

QUERIES = {
    f.__name__: f
    for f in (
        colour_in_title, facet_counts, existing_columns, diagonal_concat, stable_uniforms, drawn_queries, quantile_mapped, assembled_text, formatted_ids, distractor_titles, category_softmax,
        title_length_z, propagated_categories, power_sizes, parsed_amounts, pinned_judgments, ttl_hit_rate, scale_fit, matching_titles,
    )
}
SQL = {
    "colour_in_title": "SELECT locale, coalesce(contains(lower(title), lower(color)), false) AS in_title, count(*) AS n FROM catalog GROUP BY ALL",
    "facet_counts": """WITH r AS (SELECT request_id, doc_id, max(scores::DOUBLE) AS s FROM search_response GROUP BY ALL), c AS (SELECT r.*, category FROM r LEFT JOIN catalog USING (doc_id)),
      f AS (SELECT request_id, arg_max_null(category, (coalesce(s, -1e300), doc_id)) AS facet, count(*) AS n FROM c GROUP BY 1)
      SELECT f.request_id, facet, n, (SELECT count(*) FROM c WHERE c.request_id = f.request_id AND c.category = f.facet) AS n_passed FROM f""",
    "existing_columns": "SELECT query_id, locale, split FROM queries",
    "diagonal_concat": "SELECT doc_id, locale, category FROM catalog UNION ALL BY NAME SELECT query_id, locale, split FROM queries",
    "stable_uniforms": f"""WITH m AS (SELECT doc_id, md5('draw|' || doc_id) AS d FROM catalog),
      h AS (SELECT doc_id, ('0x' || {' || '.join(f'substr(d, {2 * i + 1}, 2)' for i in reversed(range(8)))})::UBIGINT AS h FROM m WHERE doc_id IS NOT NULL),
      a AS (SELECT doc_id, h, k, ((h::UHUGEINT + (CASE k WHEN 0 THEN {0x9E3779B97F4A7C15} ELSE {2 * 0x9E3779B97F4A7C15 % 2**64} END)::UHUGEINT) % {_M64})::UBIGINT AS z FROM h, (VALUES (0), (1)) s(k)),
      b AS (SELECT doc_id, h, k, ((xor(z, z >> 30)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT) % {_M64})::UBIGINT AS z FROM a),
      c AS (SELECT doc_id, h, k, ((xor(z, z >> 27)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT) % {_M64})::UBIGINT AS z FROM b),
      u AS (SELECT doc_id, h, k, round((xor(z, z >> 31) >> 11)::DOUBLE / 9007199254740992.0, 12) AS u FROM c)
      SELECT doc_id, h::VARCHAR AS h, max(u) FILTER (WHERE k = 0) AS u0, max(u) FILTER (WHERE k = 1) AS u1 FROM u GROUP BY doc_id, h""",
    "drawn_queries": f"""WITH c AS (SELECT query_id, n_e, sum(n_e) OVER (ORDER BY query_id ROWS UNBOUNDED PRECEDING)::BIGINT - n_e AS lo, sum(n_e) OVER ()::BIGINT AS total FROM queries WHERE n_e > 0),
      d AS (SELECT i AS draw, floor({_U.format("i::VARCHAR, 'draws'")} * (SELECT max(total) FROM c))::BIGINT AS place FROM range(1, 1001) t(i))
      SELECT draw, query_id FROM d JOIN c ON place >= lo AND place < lo + n_e""",
    "quantile_mapped": f"""WITH e AS (SELECT locale, list_sort(list(n_title_chars::DOUBLE)) AS v FROM catalog WHERE n_title_chars IS NOT NULL GROUP BY 1),
      q AS (SELECT query_id, locale, v, {_U.format("query_id::VARCHAR, 'quantile'")} * (len(v) - 1) AS h FROM queries JOIN e USING (locale))
      SELECT query_id, locale, round(v[floor(h)::INT + 1] + (h - floor(h)) * (v[least(floor(h)::INT + 2, len(v))] - v[floor(h)::INT + 1]), 6) AS value FROM q""",
    "assembled_text": "SELECT doc_id, array_to_string(list_filter([title, brand, color], lambda x: x IS NOT NULL AND trim(x) <> ''), ' | ') AS doc_text, substring(doc_text, 1, (n_title_chars + 200)::INT) AS encoder_text FROM catalog",
    "formatted_ids": "SELECT query_id, lpad(query_id::VARCHAR, 12, '0') AS id12, array_to_string(list_transform(string_split(norm, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title, concat_ws('-', locale, left(norm, 8)) AS slug FROM parsed_queries",
    "distractor_titles": f"""WITH a AS (SELECT doc_id, locale, color, coalesce(title, '') AS t, {_U.format("doc_id, 'distract'")} AS u, regexp_extract(coalesce(title, ''), '(\\d+)', 1) AS n FROM catalog)
      SELECT doc_id, CASE WHEN u < 0.4 AND n <> '' AND length(n) <= 9 THEN regexp_replace(t, '^(\\D*)\\d+', '\\1' || (TRY_CAST(n AS BIGINT) * 2 + 5)::VARCHAR)
        WHEN u < 0.7 AND coalesce(contains(t, color) AND color <> '', false) THEN replace(t, color, CASE WHEN lower(color) = 'black' THEN 'white' ELSE 'black' END)
        ELSE t || CASE locale WHEN 'us' THEN ' - refurbished' WHEN 'es' THEN ' - reacondicionado' WHEN 'jp' THEN ' 整備済み' ELSE '' END END AS title FROM a""",
    "category_softmax": """WITH e AS (SELECT DISTINCT query_id, doc_id FROM jj WHERE esci_label = 'E'), n AS (SELECT query_id, category, count(*) AS n FROM e JOIN catalog USING (doc_id) WHERE category IS NOT NULL GROUP BY ALL),
      z AS (SELECT *, exp(n - max(n) OVER (PARTITION BY query_id)) AS z FROM n), p AS (SELECT query_id, category, round(z / sum(z) OVER (PARTITION BY query_id), 6) AS p FROM z)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, category) = 1 AS is_best FROM p""",
    "title_length_z": "SELECT doc_id, round((n_title_chars - avg(n_title_chars) OVER w) / nullif(stddev_samp(n_title_chars) OVER w, 0), 6) AS z FROM catalog WINDOW w AS (PARTITION BY locale)",
    "propagated_categories": """WITH e AS (SELECT DISTINCT query_id, doc_id FROM jj WHERE esci_label = 'E'), k AS (SELECT query_id, doc_id, category FROM e JOIN catalog USING (doc_id)),
      s AS (SELECT * FROM k WHERE category IS NOT NULL AND category <> 'Unknown' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc_id) <= 40),
      a AS (SELECT query_id, min(category) AS category FROM s GROUP BY 1 HAVING min(category) = max(category)),
      w AS (SELECT k.doc_id, a.category FROM k JOIN a USING (query_id) WHERE k.category IS NULL OR k.category = 'Unknown')
      SELECT doc_id, min(category) AS category, count(*) AS n_queries FROM w GROUP BY 1 HAVING min(category) = max(category)""",
    "power_sizes": """WITH r AS (SELECT locale, avg((esci_label = 'E')::INT::DOUBLE) AS p1 FROM jj WHERE esci_label IS NOT NULL GROUP BY 1), s AS (SELECT *, least(p1 * 1.1::DOUBLE, 1) AS p2 FROM r), m AS (SELECT *, (p1 + p2) / 2 AS m FROM s)
      SELECT locale, round(p1, 6) AS p1, ceil(power((1.959964::DOUBLE * sqrt(2 * m * (1 - m)) + 0.841621::DOUBLE * sqrt(p1 * (1 - p1) + p2 * (1 - p2))) / nullif(p2 - p1, 0), 2))::BIGINT AS n_per_arm FROM m""",
    "matching_titles": f"""WITH b AS (SELECT doc_id, {sql_nfkc("coalesce(title, '')")} AS t, {_SQUEEZE.format(f"lower({sql_nfkc('brand')})")} AS b FROM catalog)
      SELECT doc_id, {_SQUEEZE.format("regexp_replace(regexp_replace(regexp_replace(lower(t), '[’`´]', '''', 'g'), '(\\d),(\\d{3})\\b', '\\1\\2', 'g'), '(\\d),(\\d)', '\\1.\\2', 'g')")} AS title, CASE WHEN b NOT IN ({_GENERIC}) AND b <> '' THEN b END AS brand FROM b""",
    "parsed_amounts": "SELECT o_orderkey, round(o_totalprice, 2) AS total, round(o_orderkey % 50 / 10 + 0.1::DOUBLE, 1) AS stars FROM orders",
    "pinned_judgments": """WITH p AS (SELECT query_id, CASE WHEN count(DISTINCT split) > 1 THEN 'test' ELSE min(split) END AS pinned, count(DISTINCT doc_id) AS n_docs FROM judgments GROUP BY 1)
      SELECT split, pinned, count(*) AS n, max(n_docs) AS most_docs FROM judgments JOIN p USING (query_id) GROUP BY ALL""",
    "ttl_hit_rate": """WITH r AS (SELECT DISTINCT request_id, query_id, locale, ts_utc FROM search_response), g AS (SELECT locale, coalesce(epoch_us(ts_utc) - lag(epoch_us(ts_utc)) OVER (PARTITION BY query_id ORDER BY ts_utc, request_id) <= 900000000, false) AS hit FROM r)
      SELECT locale, count(*) AS n, round(avg(hit::INT), 6) AS hit_rate FROM g GROUP BY 1""",
    "scale_fit": """WITH p AS (SELECT event_type, user_id, count(*)::DOUBLE AS n, median(value) AS p50 FROM events GROUP BY ALL)
      SELECT event_type, round(regr_slope(p50, n), 6) AS slope, round(regr_intercept(p50, n), 6) AS intercept, count(*) AS users FROM p GROUP BY 1""",
}
