"""Ranking metrics with graded gains, breakdowns and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def dcg(gain: Column, rank: Column, k: int) -> Column:
    """Aggregate: linear gains, discounted by log2(rank + 1), cut at ``k``."""
    return F.sum(F.when(rank <= k, gain * discount(rank)).otherwise(0.0))


def ideal_dcg(judged: DataFrame, query: str, ks: list[int]) -> DataFrame:
    """``ideal<k>`` of every query from all its judged gains."""
    best = judged.withColumn("_rk", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("gain"), "doc_id")))
    return best.groupBy(query).agg(*[dcg(F.col("gain"), F.col("_rk"), k).alias(f"ideal{k}") for k in ks], F.sum(F.when(F.col("esci_label") == "E", 1).otherwise(0)).alias("n_e"))


def rerank_metrics(ranked: DataFrame, judged: DataFrame, run: str, query: str = "query_id") -> DataFrame:
    """ndcg10, ndcg5, mrr_e and p1_e of judged candidates ranked within ``run``; nDCG is null without any gain."""
    rows = ranked.join(judged, [query, "doc_id"])
    order = Window.partitionBy(run).orderBy("rk", "doc_id")
    rows = rows.withColumn("at", F.row_number().over(order))
    made = rows.groupBy(run, query).agg(dcg(F.col("gain"), F.col("at"), 10).alias("d10"), dcg(F.col("gain"), F.col("at"), 5).alias("d5"), F.min(F.when(F.col("esci_label") == "E", F.col("at"))).alias("first_e"))
    return made.join(ideal_dcg(judged, query, [10, 5]), query).select(
        run, query,
        F.round(F.when(F.col("ideal10") > 0, F.col("d10") / F.nullif(F.col("ideal10"), F.lit(0.0))), 6).alias("ndcg10"),
        F.round(F.when(F.col("ideal5") > 0, F.col("d5") / F.nullif(F.col("ideal5"), F.lit(0.0))), 6).alias("ndcg5"),
        F.round(F.lit(1.0) / F.col("first_e"), 6).alias("mrr_e"),
        F.when(F.col("first_e") == 1, 1.0).otherwise(0.0).alias("p1_e"),
    )


def retrieval_metrics(ranked: DataFrame, judged: DataFrame, run: str, query: str = "query_id", k: int = 10, recall_k: int = 100) -> DataFrame:
    """Condensed nDCG (unjudged removed before the cut), its lower bound (unjudged as 0), judged share, recall and success."""
    rows = ranked.join(judged, [query, "doc_id"], "left")
    known = F.col("gain").isNotNull()
    rows = rows.withColumn("at", F.sum(known.cast("int")).over(Window.partitionBy(run).orderBy("rk", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    e = F.col("esci_label") == "E"
    made = rows.groupBy(run, query).agg(
        F.sum(F.when(known & (F.col("at") <= k), F.col("gain") * discount(F.col("at"))).otherwise(0.0)).alias("cond"),
        dcg(F.coalesce("gain", F.lit(0.0)), F.col("rk"), k).alias("low"),
        F.sum(F.when(known & (F.col("rk") <= k), 1).otherwise(0)).alias("n_known"),
        F.sum(F.when(e & (F.col("rk") <= recall_k), 1).otherwise(0)).alias("n_found"),
        F.max(F.when(e & (F.col("rk") <= k), 1.0).otherwise(0.0)).alias("hit"),
        F.count(F.lit(1)).alias("n_returned"),
    )
    ideal = ideal_dcg(judged, query, [k])
    some = F.col(f"ideal{k}") > 0
    return made.join(ideal, query).select(
        run, query,
        F.round(F.when(some, F.col("cond") / F.nullif(F.col(f"ideal{k}"), F.lit(0.0))), 6).alias("ndcg_cond"),
        F.round(F.when(some, F.col("low") / F.nullif(F.col(f"ideal{k}"), F.lit(0.0))), 6).alias("ndcg_low"),
        F.round(F.col("n_known") / F.lit(k), 6).alias("judged"),
        F.round(F.when(F.col("n_e") > 0, F.col("n_found") / F.nullif(F.col("n_e"), F.lit(0))), 6).alias("recall_e"),
        F.when(F.col("n_e") > 0, F.col("hit")).alias("success_e"),
        "n_returned",
    )


def uniform(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) from the md5 of the parts: the same in every engine and on every cluster."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_steps() -> list[float]:
    """The cumulated probabilities of a Poisson(1) count."""
    p, total, steps = 0.36787944117144233, 0.0, []
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    return steps


def poisson_one(u: Column) -> Column:
    """A Poisson(1) count from a uniform number."""
    return sum(((u >= t).cast("int") for t in poisson_steps()), F.lit(0))


def paired_interval(pairs: DataFrame, key: str, groups: list[str], difference: str, draws: int = 200) -> DataFrame:
    """``delta`` (mean difference), ``n``, ``lo``, ``hi`` (95 %) and ``p``, the share of draws at or below nought, by Poisson resampling of pairs."""
    drawn = pairs.where(F.col(difference).isNotNull()).select(*groups, key, difference, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("w", poisson_one(uniform(key, "draw")))
    means = drawn.groupBy(*groups, "draw").agg(F.try_divide(F.sum(F.col("w") * F.col(difference)), F.sum("w")).alias("m")).where("m IS NOT NULL")
    bounds = means.groupBy(*groups).agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("hi"), F.round(F.avg((F.col("m") <= 0).cast("int")), 6).alias("p"))
    return pairs.groupBy(*groups).agg(F.round(F.avg(difference), 6).alias("delta"), F.count(difference).alias("n")).join(bounds, groups)


def bootstrap(values: DataFrame, key: str, groups: list[str], value: str, draws: int = 200) -> DataFrame:
    """Mean and 95 % interval of a value per group, by Poisson resampling: each draw is a weighted sum, so the
    rows are read once and combined before the shuffle."""
    drawn = values.where(F.col(value).isNotNull()).select(*groups, key, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    drawn = drawn.withColumn("w", poisson_one(uniform(key, "draw")))
    means = drawn.groupBy(*groups, "draw").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    bounds = means.groupBy(*groups).agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("hi"))
    return values.groupBy(*groups).agg(F.round(F.avg(value), 6).alias("mean"), F.count(value).alias("n")).join(bounds, groups)
