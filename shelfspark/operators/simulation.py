"""Click, cart and purchase behaviour drawn from hashed uniforms, and its aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.evaluation import uniform
from shelfspark.operators.ranking import distributed_positions, running_total

# Attractiveness and funnel rates by label, position bias and traffic shape.
ATTRACTION = {"E": 0.75, "S": 0.35, "C": 0.15, "I": 0.05}
CART = {"E": 0.45, "S": 0.25, "C": 0.1, "I": 0.02}
BUY = {"E": 0.6, "S": 0.5, "C": 0.5, "I": 0.2}
DWELL = {"E": 3.6, "S": 3.2, "C": 3.0, "I": 2.3}
EXPLORE, SAID, AGREED = 0.05, 0.02, 0.88
ETA = 1.0
ZIPF = 0.8
HEAD, TORSO = 0.3, 0.7


def impressions(ranked: DataFrame, labels: DataFrame, unjudged: str = "I") -> DataFrame:
    """What happened to each shown document: ``ranked``: ``request_id``, ``query_id``, ``doc_id``, ``rk``.

    Examination falls as 1 / position; a click needs examination and attraction by label (without one as ``unjudged``), a
    cart a click, a purchase a cart; a click's dwell is log-logistic by label; a few examined documents get a thumb, which
    mostly agrees with the label. The draws are md5 uniforms of request and document, so they never change.
    """
    rows = ranked.join(labels.select("query_id", "doc_id", "esci_label"), ["query_id", "doc_id"], "left")
    label = F.coalesce("esci_label", F.lit(unjudged))
    of = {n: F.coalesce(*[F.when(label == k, v) for k, v in t.items()], F.lit(t["I"])) for n, t in (("a", ATTRACTION), ("c", CART), ("b", BUY), ("d", DWELL))}
    u = lambda what: uniform("request_id", "doc_id", F.lit(what))
    rows = rows.withColumn("propensity", F.pow(F.lit(1.0) / F.col("rk"), F.lit(ETA)))
    rows = rows.withColumn("examined", u("exam") < F.col("propensity")).withColumn("clicked", F.col("examined") & (u("click") < of["a"]))
    rows = rows.withColumn("carted", F.col("clicked") & (u("cart") < of["c"])).withColumn("bought", F.col("carted") & (u("buy") < of["b"]))
    spread = F.greatest(F.least(u("dwell"), F.lit(0.999999)), F.lit(0.000001))
    dwell = F.when(F.col("clicked"), F.exp(of["d"] + 0.8 * F.ln(spread / (1 - spread)) / 1.702))
    agrees = (u("agree") < AGREED) == label.isin("E", "S")
    thumb = F.when(F.col("examined") & (u("said") < SAID), F.when(agrees, 1).otherwise(-1)).otherwise(0)
    return rows.select("request_id", "query_id", "doc_id", F.col("rk").alias("position"), "propensity", "clicked", "carted", "bought", dwell.alias("dwell"), thumb.alias("thumb"), (uniform("request_id", F.lit("explore")) < EXPLORE).alias("explore"), label.alias("label"))


def ips_feedback(shown: DataFrame) -> DataFrame:
    """Per query and document: counts and inverse-propensity sums, one map-side combined aggregation."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    one = F.col("clicked").cast("int")
    return shown.groupBy("query_id", "doc_id").agg(
        F.count(F.lit(1)).alias("impressions"), n(F.col("clicked")).alias("clicks"), n(F.col("carted")).alias("carts"), n(F.col("bought")).alias("purchases"),
        F.round(F.sum(one / F.col("propensity")), 5).alias("ips_clicks"), F.round(F.sum(F.lit(1.0) / F.col("propensity")), 5).alias("ips_impressions"),
        n(F.col("explore")).alias("explore_impressions"), n(F.col("explore") & F.col("clicked")).alias("explore_clicks"), F.round(F.avg("position"), 6).alias("avg_position"),
        n(F.col("thumb") == 1).alias("thumbs_up"), n(F.col("thumb") == -1).alias("thumbs_down"), F.round(F.avg("dwell"), 4).alias("avg_dwell"), F.min("position").alias("best_position"),
    )


def popularity(queries: DataFrame, headness: str) -> DataFrame:
    """Zipf shares by headness and the bucket of each query: head to 30 %, torso to 70 % of the traffic."""
    ranked = distributed_positions(queries.withColumn("_all", F.lit(0)), ["_all"], [F.desc(headness), F.asc("query_id")], "pop_rank").drop("_all")
    raw = F.pow(F.col("pop_rank").cast("double"), F.lit(-ZIPF))
    total = float(ranked.agg(F.sum(raw)).first()[0] or 1.0)
    shared = ranked.withColumn("share", raw / F.lit(total))
    before = F.round("before", 9)
    bucket = F.when(before < HEAD, "head").when(before < TORSO, "torso").otherwise("tail")
    running = running_total(shared, [F.col("pop_rank")], "share", "before")
    return running.select("query_id", "pop_rank", F.round("share", 9).alias("traffic_share"), bucket.alias("traffic_bucket"))
