"""Queries: scans, sinks, joins, aggregates, windows, sampling and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import text as T
from shelfspark.functions.words import COUNT_CJK, COUNT_WORDS
from shelfspark.operators import sampling
from shelfspark.operators.matching import brand_mentions
from shelfspark.operators.ranking import top_k
from shelfspark.operators.sizing import lookup
from shelfspark.plans.sqltext import sql_nfkc, sql_units, sql_visible, sql_without_markup
from shelfspark.session import cut
from shelfspark.sources import files
from shelfspark.sources.tables import table


def partitioned_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog written by locale and read again locale by locale: each reading scans one directory."""
    path = files.scratch(spark, "catalog")
    files.write_partitioned(table(spark, sf, "catalog").select("doc_id", "category", "seller", "locale"), path, "locale")
    parts = [spark.read.parquet(path).where(F.col("locale") == x).groupBy("locale", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seller").alias("n_sellers")) for x in ("us", "es", "jp")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def csv_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Query sources by way of CSV, with a default for those that have none."""
    path = files.scratch(spark, "sources")
    table(spark, sf, "judgments").where("source IS NOT NULL").select("query_id", "source").distinct().write.csv(path, header=True)
    sources = files.read_csv(spark, path, "query_id long, source string")
    return table(spark, sf, "queries").select("query_id").join(sources, "query_id", "left").select("query_id", F.coalesce("source", F.lit("other")).alias("source"))


def json_products(spark: SparkSession, sf: str) -> DataFrame:
    """Listings by way of gzipped JSON lines; lines of another type are skipped, each listing is kept once."""
    path = files.scratch(spark, "products")
    rows = table(spark, sf, "catalog").select("locale", "product_id", "seller", F.when(F.col("is_title_only"), "error").otherwise("product").alias("type"))
    rows.unionByName(rows).write.option("compression", "gzip").json(path)
    return files.read_json_lines(spark, path, "locale string, product_id string, seller string, type string", "product", ["locale", "product_id"]).select("locale", "product_id", "seller")


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance lines of all graded judgments."""
    return files.qrels_lines(table(spark, sf, "judgments").where("grade IS NOT NULL").select("split", "locale", "query_id", "doc_id", "grade").distinct())


def file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of all table files of the folder."""
    return files.digests(spark, sf)


def stage_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and keys of the main stages."""
    parts = [files.manifest(table(spark, sf, t), t, F.countDistinct(k).alias("keys")) for t, k in (("catalog", "doc_id"), ("queries", "query_id"), ("judgments", "example_id"), ("search_response", "request_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_judgments(spark: SparkSession, sf: str) -> DataFrame:
    """Each judgment once, as it was ingested last."""
    return top_k(table(spark, sf, "judgments").select("example_id", "query_id", "doc_id", "esci_label", "ingested_at"), ["example_id"], [F.desc("ingested_at"), F.asc_nulls_last("esci_label")], 1).drop("rk")


def label_gains(spark: SparkSession, sf: str) -> DataFrame:
    """Gain and grade by label, from a value map, against those delivered."""
    gain = F.create_map(*[F.lit(x) for k, v in {"E": 1.0, "S": 0.1, "C": 0.01, "I": 0.0}.items() for x in (k, v)])
    grade = F.create_map(*[F.lit(x) for k, v in {"E": 3, "S": 2, "C": 1, "I": 0}.items() for x in (k, v)])
    rows = table(spark, sf, "judgments").select("esci_label", "gain", "grade", F.try_element_at(gain, F.col("esci_label")).alias("g"), F.try_element_at(grade, F.col("esci_label")).cast("long").alias("d"))
    return rows.groupBy("esci_label").agg(F.count(F.lit(1)).alias("n"), F.max("g").alias("gain"), F.max("d").alias("grade"), F.sum(F.when(F.col("g") != F.col("gain"), 1).otherwise(0)).alias("n_other"))


def split_pinning(spark: SparkSession, sf: str) -> DataFrame:
    """One split per query: test where several were delivered."""
    pinned = table(spark, sf, "judgments").groupBy("query_id").agg(F.when(F.countDistinct("split") > 1, "test").otherwise(F.min("split")).alias("split"), F.count(F.lit(1)).alias("n_rows"))
    return pinned.groupBy("split").agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n_rows").alias("n_rows"))


def query_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of each query and the share of E, with its source or a default."""
    j = table(spark, sf, "judgments").dropDuplicates(["example_id"])
    return j.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_judged"), *[F.sum(F.when(F.col("esci_label") == c, 1).otherwise(0)).alias(f"n_{c.lower()}") for c in "ESCI"], F.coalesce(F.min("source"), F.lit("other")).alias("source"), F.round(F.avg(F.when(F.col("esci_label") == "E", 1.0).otherwise(0.0)), 6).alias("frac_e"))


def query_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Length buckets, attribute and brand flags of the parsed queries."""
    q = table(spark, sf, "parsed_queries")
    n_tokens, n_chars = F.size(F.split("norm", " ")), F.char_length(F.regexp_replace("norm", " ", ""))
    bucket = F.when(F.col("locale") == "jp", F.when(n_chars <= 6, "short").when(n_chars <= 14, "medium").otherwise("long")).otherwise(F.when(n_tokens <= 2, "short").when(n_tokens <= 5, "medium").otherwise("long"))
    attribute = (F.size(F.map_keys("attrs")) > 0) | F.col("pack_count").isNotNull()
    rows = q.select("locale", bucket.alias("length_bucket"), F.coalesce(attribute, F.lit(False)).alias("has_attribute"), (F.coalesce(F.size("brands"), F.lit(0)) > 0).alias("has_brand"), "has_negation", "has_digit")
    return rows.groupBy("locale", "length_bucket").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("int")).alias(f"n_{c}") for c in ("has_attribute", "has_brand", "has_negation", "has_digit")])


def query_intent(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy, first and second share of the categories of each query's E listings, and its brands."""
    e = table(spark, sf, "jj").where("esci_label = 'E'").select("query_id", "doc_id").distinct()
    rows = e.join(table(spark, sf, "catalog").select("doc_id", "category", "brand_norm", "is_sparse"), "doc_id")
    c = rows.where("category IS NOT NULL AND category <> 'Unknown'").groupBy("query_id", "category").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("query_id").orderBy(F.desc("n"), F.asc("category"))
    c = c.withColumn("k", F.row_number().over(own)).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("query_id")))
    stats = c.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_categories"), F.round(F.abs(F.sum(F.col("p") * F.log2("p"))), 6).alias("entropy"), F.max(F.when(F.col("k") == 1, F.col("category"))).alias("top_category"), F.round(F.max(F.when(F.col("k") == 1, F.col("p"))), 6).alias("top_share"), F.round(F.coalesce(F.max(F.when(F.col("k") == 2, F.col("p"))), F.lit(0.0)), 6).alias("second_share"))
    brands = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.round(F.countDistinct("brand_norm") / F.count(F.lit(1)), 6).alias("brand_diversity"), F.round(F.avg(F.col("is_sparse").cast("double")), 6).alias("frac_sparse"))
    return brands.join(stats, "query_id", "left")


def lexical_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    """One minus the mean Jaccard of the word sets of a query's first 15 E titles, pair by pair."""
    e = table(spark, sf, "jj").where("esci_label = 'E'").select("query_id", "doc_id").distinct()
    first = top_k(e, ["query_id"], [F.asc("doc_id")], 15)
    words = F.array_distinct(F.filter(F.split(F.lower("title"), " +"), lambda w: F.char_length(w) > 1))
    sets = first.join(table(spark, sf, "catalog").select("doc_id", words.alias("w")), "doc_id").where(F.col("w").isNotNull()).select("query_id", "rk", "w")
    pairs = sets.join(sets.select("query_id", F.col("rk").alias("r2"), F.col("w").alias("w2")), "query_id").where("rk < r2 AND size(array_union(w, w2)) > 0")
    sim = F.size(F.array_intersect("w", "w2")) / F.size(F.array_union("w", "w2"))
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(1 - F.avg(sim), 6).alias("dispersion"))


def brand_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Brands of each locale with their listings and most frequent category."""
    c = table(spark, sf, "catalog").where("brand_norm IS NOT NULL")
    n = c.groupBy("locale", "brand_norm").agg(F.count(F.lit(1)).alias("n_products"))
    cats = c.where("category IS NOT NULL").groupBy("locale", "brand_norm", "category").agg(F.count(F.lit(1)).alias("k"))
    top = cats.groupBy("locale", "brand_norm").agg(F.min_by("category", F.struct((-F.col("k")).alias("k"), "category")).alias("top_category"))
    return n.join(top, ["locale", "brand_norm"], "left")


def brand_specificity(spark: SparkSession, sf: str) -> DataFrame:
    """Brands of at least three listings, with the titles that mention them, and whether enough of those are the brand's own."""
    long = F.char_length("brand_norm") >= F.when(F.col("locale") == "jp", 2).otherwise(3)
    brands = brand_vocabulary(spark, sf).where((F.col("n_products") >= 3) & long & ~F.col("brand_norm").rlike(r"^\d+$")).select("locale", "brand_norm", "n_products")
    titles = table(spark, sf, "catalog").select(F.col("doc_id").alias("rec"), "locale", T.for_matching(F.col("title")).alias("text"))
    hits = brand_mentions(titles, brands.select("locale", F.col("brand_norm").alias("name"))).groupBy("locale", F.col("name").alias("brand_norm")).agg(F.count(F.lit(1)).alias("n_mentions"))
    out = brands.join(hits, ["locale", "brand_norm"], "left")
    return out.select("locale", "brand_norm", "n_products", F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"), (F.col("n_mentions").isNull() | (F.col("n_products") / F.col("n_mentions") >= 0.05)).alias("kept"))


def title_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Listings whose title another listing of the locale has letter for letter."""
    c = table(spark, sf, "catalog").where("title IS NOT NULL").select("doc_id", F.md5(F.concat_ws("|", "locale", F.lower("title"))).alias("title_key"))
    return c.withColumn("title_group_size", F.count(F.lit(1)).over(Window.partitionBy("title_key"))).where("title_group_size > 1")


def catalog_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Sums, means and shares by locale."""
    c = table(spark, sf, "catalog")
    return c.groupBy("locale").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("brand_norm").alias("n_brands"), F.sum(F.col("is_sparse").cast("int")).alias("n_sparse"), F.round(F.avg("n_title_chars"), 6).alias("mean_title"), F.min("n_title_chars").alias("min_title"), F.max("richness_chars").alias("max_rich"), F.sum(F.when(F.col("category").isNull(), 1).otherwise(0)).alias("n_uncategorised"))


def title_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of the title length by locale."""
    q = F.percentile("n_title_chars", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return table(spark, sf, "catalog").groupBy("locale").agg(q.alias("q")).select("locale", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p90", "p99"))])


def event_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Quantile summary of the event values and what a million of them cost at one core each."""
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("m"), q.alias("q"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))
    cost = F.lit(1e6) / (F.lit(1000.0) / F.nullif(F.col("m"), F.lit(0.0)) * 4 * 0.6) / 3600 * 0.1785
    return rows.select("event_type", F.round("m", 5).alias("mean"), *[F.round(F.col("q")[i], 5).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "max", "n", F.round(cost, 6).alias("usd_per_million"))


def requests_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    """Busiest minute of each hour."""
    r = table(spark, sf, "search_response").select("request_id", F.date_trunc("minute", "ts_utc").alias("minute")).distinct()
    per = r.groupBy("minute").agg(F.count(F.lit(1)).alias("n")).withColumn("hour", F.date_trunc("hour", "minute"))
    return per.groupBy(F.hour("hour").cast("long").alias("hour_of_day")).agg(F.max("n").alias("peak"), F.sum("n").alias("n"))


def popular_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each category within its locale and the z-score of the logarithm of its size."""
    c = table(spark, sf, "catalog").where("category IS NOT NULL").groupBy("locale", "category").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("locale")
    z = (F.ln("n") - F.avg(F.ln("n")).over(own)) / F.nullif(F.stddev_pop(F.ln("n")).over(own), F.lit(0.0))
    return c.select("locale", "category", "n", F.round(F.col("n") / F.sum("n").over(own), 6).alias("share"), F.round(z, 6).alias("z"))


def shrunk_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Mean gain of each listing, shrunk to its locale's mean with the weight of 20 judgments."""
    j = table(spark, sf, "judgments").where("gain IS NOT NULL").dropDuplicates(["example_id"])
    prior = j.groupBy("locale").agg(F.avg("gain").alias("m"))
    own = j.groupBy("locale", "doc_id").agg(F.sum("gain").alias("s"), F.count(F.lit(1)).alias("n"))
    return lookup(own, cut(prior), ["locale"]).select("doc_id", "n", F.round((F.col("s") + 20 * F.col("m")) / (F.col("n") + 20), 6).alias("shrunk"))


def column_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls of the catalog's columns, one row each (unpivot of aggregates)."""
    names = ["brand", "color", "category", "attr_measures", "attr_dimensions", "attr_pack_count"]
    sums = table(spark, sf, "catalog").agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in names])
    return sums.select(F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{c}{chr(39)}, {c}' for c in names)}) AS (column_name, n_null)"))


def ordered_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The first three documents of every request by score, as one ordered list."""
    s = F.col("scores").cast("double")
    best = table(spark, sf, "search_response").where("scores IS NOT NULL").groupBy("request_id", "doc_id").agg(F.max(s).alias("s"))
    first = top_k(best, ["request_id"], [F.desc("s"), F.asc("doc_id")], 3)
    return first.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "doc_id"))), lambda x: x["doc_id"]), ",").alias("docs"))


def unjudged_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Listings no judgment names (anti join) by locale, and those judged E only (semi and anti)."""
    c, j = table(spark, sf, "catalog").select("doc_id", "locale"), table(spark, sf, "jj")
    none = c.join(j.select("doc_id"), "doc_id", "left_anti").select("locale", F.lit("unjudged").alias("kind"))
    only = c.join(j.where("esci_label = 'E'").select("doc_id"), "doc_id", "left_semi").join(j.where("esci_label <> 'E'").select("doc_id"), "doc_id", "left_anti").select("locale", F.lit("exact_only").alias("kind"))
    return none.unionByName(only).groupBy("locale", "kind").agg(F.count(F.lit(1)).alias("n"))


def demo_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Queries sampled in proportion to their split, their documents, and 100 more by hash (union)."""
    q = sampling.stratified(table(spark, sf, "queries").select("query_id", "split"), "query_id", "split", 100)
    docs = table(spark, sf, "jj").join(q.select("query_id"), "query_id", "left_semi").select("doc_id").distinct()
    more = sampling.hash_sample(table(spark, sf, "catalog").select("doc_id"), "doc_id", 100, "demo")
    return docs.union(more).distinct()


def weighted_queries(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred queries, drawn with odds by their E documents."""
    return sampling.weighted_sample(table(spark, sf, "queries").select("query_id", "n_e"), "query_id", "n_e", 100)


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in both, either or one of the judgments and the responses, by locale."""
    a = table(spark, sf, "jj").select("doc_id").distinct()
    b = table(spark, sf, "search_response").select("doc_id").distinct()
    kinds = {"both": a.intersect(b), "either": a.union(b).distinct(), "judged_only": a.subtract(b), "served_only": b.subtract(a)}
    out = None
    for k, d in kinds.items():
        part = d.groupBy(F.substring("doc_id", 1, 2).alias("locale")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def conditional_sums(spark: SparkSession, sf: str) -> DataFrame:
    """The pricing summary of the order lines."""
    rows = table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def multiway_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and their lines by region of the customer."""
    t = lambda n: table(spark, sf, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.countDistinct("o_orderkey").alias("n_orders"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def title_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Dimensions and pack counts read from the titles."""
    t = T.for_matching(F.col("title"))
    rows = table(spark, sf, "catalog").select("doc_id", F.array_join(T.dimensions(t), ",").alias("dimensions"), T.pack_count(t).alias("pack_count"))
    return rows.where("dimensions <> '' OR pack_count IS NOT NULL")


def title_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Measures, sizes, audience, materials, colours and fits read from the titles."""
    t = T.for_matching(F.col("title"))
    return table(spark, sf, "catalog").select("doc_id", t.alias("t")).select("doc_id", *[f(F.col("t")).alias(f.__name__) for f in (T.measures, T.sizes, T.audience, T.materials, T.colours, T.compat)])


def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without markup, entities and odd white space: characters left and lines kept."""
    return table(spark, sf, "documents").select("doc_id", F.char_length(T.clean_text(F.col("text"))).alias("n_clean"), F.size(T.clean_bullets(F.col("text"))).alias("n_lines"))


def query_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct queries under the raw text, the ordered key and the sorted key."""
    q = table(spark, sf, "judgments").select("locale", "query").distinct()
    return q.groupBy("locale").agg(F.count(F.lit(1)).alias("n_raw"), F.countDistinct(T.cache_key(F.col("query"))).alias("n_ordered"), F.countDistinct(T.query_key(F.col("query"))).alias("n_sorted"))


def negated_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries that exclude something, and what."""
    n = T.normalize(F.col("query"))
    return table(spark, sf, "queries").select("query_id", n.alias("n")).where(T.has_negation(F.col("n"))).select("query_id", T.negated_terms(F.col("n")).alias("negated"))


def document_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, characters and kinds by language."""
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("kind").alias("kinds"), F.round(F.avg(F.char_length("text")), 4).alias("mean_chars"))


def match_features(spark: SparkSession, sf: str) -> DataFrame:
    """Attribute matches and conflicts of judged pairs: colours, materials, audience, pack and brand."""
    p = table(spark, sf, "parsed_queries")
    at = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.array().cast("array<string>"))
    q = p.select("query_id", at("colors").alias("q_colors"), at("materials").alias("q_materials"), at("audience").alias("q_audience"), F.col("pack_count").alias("q_pack"), F.transform(F.coalesce("brands", F.array().cast("array<string>")), F.lower).alias("q_brands"), "n_units", "has_digit")
    c = table(spark, sf, "catalog").select("doc_id", *[F.coalesce(f"attr_{k}", F.array().cast("array<string>")).alias(f"d_{k}") for k in ("colors", "materials", "audience")], F.col("attr_pack_count").alias("d_pack"), "brand_norm", "is_sparse", "richness_chars", "n_title_chars")
    pairs = table(spark, sf, "judgments").select("query_id", "doc_id").distinct().join(q, "query_id").join(c, "doc_id")
    cols = []
    for k in ("colors", "materials", "audience"):
        both = (F.size(f"q_{k}") > 0) & (F.size(f"d_{k}") > 0)
        cols += [F.arrays_overlap(f"q_{k}", f"d_{k}").alias(f"{k}_match"), (both & ~F.arrays_overlap(f"q_{k}", f"d_{k}")).alias(f"{k}_conflict")]
    pack = [F.coalesce(F.col("q_pack") == F.col("d_pack"), F.lit(False)).alias("pack_match"), F.coalesce(F.col("q_pack") != F.col("d_pack"), F.lit(False)).alias("pack_conflict")]
    brand = F.coalesce(F.array_contains("q_brands", F.col("brand_norm")), F.lit(False)).alias("brand_match")
    return pairs.select("query_id", "doc_id", *cols, *pack, brand, F.round(F.log1p("richness_chars"), 6).alias("log_richness"), "n_units", "has_digit")


_ONCE = "(SELECT * FROM judgments QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY ingested_at) = 1)"
_MATCH = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[’`´]', '''', 'g'), '(\\d),(\\d{3})\\b', '\\1\\2', 'g'), '(\\d),(\\d)', '\\1.\\2', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))"
_MATCH_NFKC = _MATCH.replace("coalesce(title, '')", sql_nfkc("coalesce(title, '')"))
_PACK = (
    "((?:pack|set|box|case|bag|lot|bundle) of \\d+|(?:paquete|juego|lote|set|pack) de \\d+|\\d+\\s*-?\\s*(?:"
    + "|".join(sorted(COUNT_WORDS, key=len, reverse=True)) + ")\\b|\\d+\\s*(?:" + "|".join(sorted(COUNT_CJK, key=len, reverse=True)) + "))"
)

QUERIES = {
    f.__name__: f
    for f in (
        partitioned_catalog, csv_sources, json_products, qrels, file_digests, stage_manifest, latest_judgments, label_gains, split_pinning, query_profile, query_slices, query_intent,
        lexical_dispersion, brand_vocabulary, brand_specificity, title_groups, catalog_profile, title_quantiles, event_latency, requests_per_minute, popular_categories, shrunk_ratings,
        column_nulls, ordered_documents, unjudged_listings, demo_subset, weighted_queries, set_operations, conditional_sums, multiway_join, title_attributes,
        title_keywords, clean_documents, query_keys, negated_queries, document_stats, match_features,
    )
}
SQL = {
    "partitioned_catalog": "SELECT locale, category, count(*) AS n, count(DISTINCT seller) AS n_sellers FROM catalog GROUP BY ALL",
    "csv_sources": "SELECT query_id, coalesce(source, 'other') AS source FROM queries LEFT JOIN (SELECT DISTINCT query_id, source FROM judgments WHERE source IS NOT NULL) USING (query_id)",
    "json_products": "SELECT DISTINCT locale, product_id, seller FROM catalog WHERE NOT is_title_only",
    "qrels": "SELECT DISTINCT split, locale, concat_ws(' ', query_id::VARCHAR, '0', doc_id, grade::VARCHAR) AS line FROM judgments WHERE grade IS NOT NULL",
    "stage_manifest": " UNION ALL ".join(f"SELECT '{t}' AS stage, count(*) AS rows, count(DISTINCT {k}) AS keys FROM {t}" for t, k in (("catalog", "doc_id"), ("queries", "query_id"), ("judgments", "example_id"), ("search_response", "request_id"))),
    "latest_judgments": "SELECT example_id, query_id, doc_id, esci_label, ingested_at FROM judgments QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY ingested_at DESC, esci_label NULLS LAST) = 1",
    "label_gains": """WITH a AS (SELECT *, CASE esci_label WHEN 'E' THEN 1.0::DOUBLE WHEN 'S' THEN 0.1 WHEN 'C' THEN 0.01 WHEN 'I' THEN 0 END AS g, CASE esci_label WHEN 'E' THEN 3 WHEN 'S' THEN 2 WHEN 'C' THEN 1 WHEN 'I' THEN 0 END AS d FROM judgments)
      SELECT esci_label, count(*) AS n, max(g) AS gain, max(d)::BIGINT AS grade, count(*) FILTER (WHERE g <> gain) AS n_other FROM a GROUP BY 1""",
    "split_pinning": "WITH a AS (SELECT query_id, CASE WHEN count(DISTINCT split) > 1 THEN 'test' ELSE min(split) END AS split, count(*) AS n FROM judgments GROUP BY 1) SELECT split, count(*) AS n_queries, sum(n)::BIGINT AS n_rows FROM a GROUP BY 1",
    "query_profile": f"""SELECT query_id, count(*) AS n_judged, {', '.join(f"count(*) FILTER (WHERE esci_label = '{c}') AS n_{c.lower()}" for c in 'ESCI')},
      coalesce(min(source), 'other') AS source, round(avg(CASE WHEN esci_label = 'E' THEN 1.0::DOUBLE ELSE 0 END), 6) AS frac_e FROM {_ONCE} GROUP BY 1""",
    "query_slices": """WITH a AS (SELECT locale, len(string_split(norm, ' ')) AS t, length(replace(norm, ' ', '')) AS c, coalesce(len(map_keys(attrs)) > 0 OR pack_count IS NOT NULL, false) AS a, coalesce(len(brands), 0) > 0 AS b, has_negation AS n, has_digit AS d FROM parsed_queries)
      SELECT locale, CASE WHEN locale = 'jp' THEN CASE WHEN c <= 6 THEN 'short' WHEN c <= 14 THEN 'medium' ELSE 'long' END WHEN t <= 2 THEN 'short' WHEN t <= 5 THEN 'medium' ELSE 'long' END AS length_bucket,
      count(*) AS n, count(*) FILTER (WHERE a) AS n_has_attribute, count(*) FILTER (WHERE b) AS n_has_brand, count(*) FILTER (WHERE n) AS n_has_negation, count(*) FILTER (WHERE d) AS n_has_digit FROM a GROUP BY ALL""",
    "query_intent": """WITH e AS (SELECT DISTINCT query_id, doc_id FROM jj WHERE esci_label = 'E'), r AS (SELECT query_id, category, brand_norm, is_sparse FROM e JOIN catalog USING (doc_id)),
      c AS (SELECT query_id, category, count(*) AS n FROM r WHERE category IS NOT NULL AND category <> 'Unknown' GROUP BY ALL),
      p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, category) AS k, n / sum(n) OVER (PARTITION BY query_id) AS p FROM c),
      s AS (SELECT query_id, count(*) AS n_categories, round(abs(sum(p * log2(p))), 6) AS entropy, max(category) FILTER (WHERE k = 1) AS top_category, round(max(p) FILTER (WHERE k = 1), 6) AS top_share, round(coalesce(max(p) FILTER (WHERE k = 2), 0), 6) AS second_share FROM p GROUP BY 1),
      b AS (SELECT query_id, count(*) AS n_exact, round(count(DISTINCT brand_norm) / count(*), 6) AS brand_diversity, round(avg(is_sparse::INT), 6) AS frac_sparse FROM r GROUP BY 1)
      SELECT * FROM b LEFT JOIN s USING (query_id)""",
    "lexical_dispersion": """WITH e AS (SELECT DISTINCT query_id, doc_id FROM jj WHERE esci_label = 'E'), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rk FROM e QUALIFY rk <= 15),
      s AS (SELECT query_id, rk, list_distinct(list_filter(string_split_regex(lower(title), ' +'), lambda w: length(w) > 1)) AS w FROM f JOIN catalog USING (doc_id) WHERE title IS NOT NULL),
      p AS (SELECT a.query_id, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS u FROM s a JOIN s b ON a.query_id = b.query_id AND a.rk < b.rk)
      SELECT query_id, count(*) AS n_pairs, round(1 - avg(i / u), 6) AS dispersion FROM p WHERE u > 0 GROUP BY 1""",
    "brand_vocabulary": """WITH a AS (SELECT locale, brand_norm, count(*) AS n_products FROM catalog WHERE brand_norm IS NOT NULL GROUP BY ALL),
      c AS (SELECT locale, brand_norm, category, count(*) AS k FROM catalog WHERE brand_norm IS NOT NULL AND category IS NOT NULL GROUP BY ALL),
      t AS (SELECT locale, brand_norm, category AS top_category FROM c QUALIFY row_number() OVER (PARTITION BY locale, brand_norm ORDER BY k DESC, category) = 1) SELECT * FROM a LEFT JOIN t USING (locale, brand_norm)""",
    "brand_specificity": rf"""WITH b AS (SELECT locale, brand_norm, count(*) AS n_products FROM catalog WHERE brand_norm IS NOT NULL GROUP BY ALL HAVING count(*) >= 3 AND length(brand_norm) >= CASE locale WHEN 'jp' THEN 2 ELSE 3 END AND NOT regexp_matches(brand_norm, '^\d+$')),
      t AS (SELECT locale, doc_id, {_MATCH_NFKC} AS t, ' ' || trim(regexp_replace({_MATCH_NFKC}, '[^\p{{L}}\p{{N}}\p{{M}}_]+', ' ', 'g')) || ' ' AS p FROM catalog),
      h AS (SELECT b.locale, brand_norm, count(*) AS m FROM b JOIN t ON b.locale = t.locale AND CASE WHEN b.locale = 'jp' THEN contains(t, brand_norm) ELSE contains(p, ' ' || brand_norm || ' ') END GROUP BY ALL)
      SELECT locale, brand_norm, n_products, coalesce(m, 0) AS n_mentions, m IS NULL OR n_products / m >= 0.05 AS kept FROM b LEFT JOIN h USING (locale, brand_norm)""",
    "title_groups": "SELECT doc_id, md5(concat_ws('|', locale, lower(title))) AS title_key, count(*) OVER (PARTITION BY md5(concat_ws('|', locale, lower(title)))) AS title_group_size FROM catalog WHERE title IS NOT NULL QUALIFY title_group_size > 1",
    "catalog_profile": """SELECT locale, count(*) AS n, count(DISTINCT brand_norm) AS n_brands, count(*) FILTER (WHERE is_sparse) AS n_sparse, round(avg(n_title_chars), 6) AS mean_title, min(n_title_chars) AS min_title,
      max(richness_chars) AS max_rich, count(*) FILTER (WHERE category IS NULL) AS n_uncategorised FROM catalog GROUP BY 1""",
    "title_quantiles": "SELECT locale, " + ", ".join(f"round(quantile_cont(n_title_chars::DOUBLE, {q}), 6) AS {n}" for q, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"), (0.99, "p99"))) + " FROM catalog GROUP BY 1",
    "event_latency": "SELECT event_type, round(avg(value), 5) AS mean, " + ", ".join(f"round(quantile_cont(value, {q}), 5) AS {n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + ", max(value) AS max, count(*) AS n, round(1e6 / (1000.0::DOUBLE / nullif(avg(value), 0) * 4 * 0.6::DOUBLE) / 3600 * 0.1785::DOUBLE, 6) AS usd_per_million FROM events GROUP BY 1",
    "requests_per_minute": """WITH a AS (SELECT DISTINCT request_id, date_trunc('minute', ts_utc) AS m FROM search_response), b AS (SELECT m, count(*) AS n FROM a GROUP BY 1)
      SELECT hour(m) AS hour_of_day, max(n) AS peak, sum(n)::BIGINT AS n FROM b GROUP BY 1""",
    "popular_categories": """WITH c AS (SELECT locale, category, count(*) AS n FROM catalog WHERE category IS NOT NULL GROUP BY ALL)
      SELECT locale, category, n, round(n / sum(n) OVER w, 6) AS share, round((ln(n) - avg(ln(n)) OVER w) / nullif(stddev_pop(ln(n)) OVER w, 0), 6) AS z FROM c WINDOW w AS (PARTITION BY locale)""",
    "shrunk_ratings": f"""WITH j AS (SELECT * FROM {_ONCE} WHERE gain IS NOT NULL), p AS (SELECT locale, avg(gain) AS m FROM j GROUP BY 1), o AS (SELECT locale, doc_id, sum(gain) AS s, count(*) AS n FROM j GROUP BY ALL)
      SELECT doc_id, n, round((s + 20 * m) / (n + 20), 6) AS shrunk FROM o JOIN p USING (locale)""",
    "column_nulls": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM catalog" for c in ("brand", "color", "category", "attr_measures", "attr_dimensions", "attr_pack_count")),
    "ordered_documents": """WITH b AS (SELECT request_id, doc_id, max(scores::DOUBLE) AS s FROM search_response WHERE scores IS NOT NULL GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, doc_id) AS rk FROM b QUALIFY rk <= 3)
      SELECT request_id, string_agg(doc_id, ',' ORDER BY rk) AS docs FROM f GROUP BY 1""",
    "unjudged_listings": """SELECT locale, 'unjudged' AS kind, count(*) AS n FROM catalog WHERE NOT EXISTS (SELECT 1 FROM jj WHERE jj.doc_id = catalog.doc_id) GROUP BY 1
      UNION ALL SELECT locale, 'exact_only', count(*) FROM catalog WHERE doc_id IN (SELECT doc_id FROM jj WHERE esci_label = 'E') AND doc_id NOT IN (SELECT doc_id FROM jj WHERE esci_label <> 'E') GROUP BY 1""",
    "demo_subset": """WITH q AS (SELECT query_id FROM queries QUALIFY row_number() OVER (PARTITION BY split ORDER BY md5(query_id::VARCHAR), query_id) <= greatest(5, 100.0::DOUBLE * count(*) OVER (PARTITION BY split) / count(*) OVER ()))
      SELECT doc_id FROM jj WHERE query_id IN (SELECT query_id FROM q) UNION (SELECT doc_id FROM catalog ORDER BY md5(doc_id || 'demo'), doc_id LIMIT 100)""",
    "weighted_queries": "SELECT query_id, n_e FROM queries WHERE n_e > 0 ORDER BY round(ln(greatest(('0x' || left(md5(concat_ws('|', query_id::VARCHAR, 'weighted')), 8))::BIGINT::DOUBLE / 4294967296.0, 1e-12)) / n_e, 9) DESC, query_id LIMIT 100",
    "set_operations": """WITH a AS (SELECT DISTINCT doc_id FROM jj), b AS (SELECT DISTINCT doc_id FROM search_response),
      u AS (SELECT 'both' AS kind, doc_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', doc_id FROM (SELECT * FROM a UNION SELECT * FROM b)
        UNION ALL SELECT 'judged_only', doc_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'served_only', doc_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
      SELECT left(doc_id, 2) AS locale, count(*) AS n, kind FROM u GROUP BY ALL""",
    "conditional_sums": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
      FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "multiway_join": """SELECT r_name, count(DISTINCT o_orderkey) AS n_orders, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "title_attributes": f"""WITH t AS (SELECT doc_id, {_MATCH_NFKC} AS t FROM catalog),
      d AS (SELECT doc_id, list_transform(regexp_extract_all(t, '\\d+(?:\\.\\d+)?\\s*(?:x|×|\\*)\\s*\\d+(?:\\.\\d+)?(?:\\s*(?:x|×|\\*)\\s*\\d+(?:\\.\\d+)?)?'), lambda d: regexp_replace(regexp_replace(d, '\\s+', '', 'g'), '[×*]', 'x', 'g')) AS d,
        TRY_CAST(regexp_extract(regexp_extract(t, '{_PACK}', 1), '(\\d+)', 1) AS INT) AS pack_count FROM t),
      e AS (SELECT doc_id, array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), ',') AS dimensions, pack_count FROM d) SELECT * FROM e WHERE dimensions <> '' OR pack_count IS NOT NULL""",
    "document_stats": "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT kind) AS kinds, round(avg(length(text)), 4) AS mean_chars FROM documents GROUP BY 1",
    "match_features": """WITH q AS (SELECT query_id, coalesce(attrs['colors'], []) AS qc, coalesce(attrs['materials'], []) AS qm, coalesce(attrs['audience'], []) AS qa, pack_count AS qp, list_transform(coalesce(brands, []), lambda b: lower(b)) AS qb, n_units, has_digit FROM parsed_queries),
      c AS (SELECT doc_id, coalesce(attr_colors, []) AS dc, coalesce(attr_materials, []) AS dm, coalesce(attr_audience, []) AS da, attr_pack_count AS dp, brand_norm, richness_chars FROM catalog),
      p AS (SELECT DISTINCT query_id, doc_id FROM judgments)
      SELECT query_id, doc_id, list_has_any(qc, dc) AS colors_match, len(qc) > 0 AND len(dc) > 0 AND NOT list_has_any(qc, dc) AS colors_conflict, list_has_any(qm, dm) AS materials_match, len(qm) > 0 AND len(dm) > 0 AND NOT list_has_any(qm, dm) AS materials_conflict,
      list_has_any(qa, da) AS audience_match, len(qa) > 0 AND len(da) > 0 AND NOT list_has_any(qa, da) AS audience_conflict, coalesce(qp = dp, false) AS pack_match, coalesce(qp <> dp, false) AS pack_conflict,
      coalesce(list_contains(qb, brand_norm), false) AS brand_match, round(ln(1 + richness_chars), 6) AS log_richness, n_units, has_digit FROM p JOIN q USING (query_id) JOIN c USING (doc_id)""",
    "query_keys": f"""WITH q AS (SELECT DISTINCT locale, query FROM judgments), u AS (SELECT locale, {sql_units('query')} AS u FROM q)
      SELECT locale, count(*) AS n_raw, count(DISTINCT array_to_string(u, ' ')) AS n_ordered, count(DISTINCT array_to_string(list_sort(u), ' ')) AS n_sorted FROM u GROUP BY 1""",
    "clean_documents": f"""WITH l AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), c AS (SELECT doc_id, regexp_replace({sql_visible(sql_nfkc(sql_without_markup('line')))}, '^[^\\p{{L}}\\p{{N}}]+', '') AS line FROM l),
      n AS (SELECT doc_id, count(*) FILTER (WHERE length(line) > 1) AS n_lines FROM c GROUP BY 1)
      SELECT doc_id, length({sql_visible(sql_nfkc(sql_without_markup('text')))}) AS n_clean, n_lines FROM documents JOIN n USING (doc_id)""",
}
