"""One ranking from scores of unlike scale and spread (problem 3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.ranking import distributed_positions
from shelfspark.operators.sizing import lookup
from shelfspark.session import cut

#: Requests with more candidates than this are ranked across tasks.
HOT_ROWS = 20_000
#: Standardised values are kept within this many robust deviations before squashing.
REACH = 30.0
#: Makes the median absolute deviation (and the mean one) estimate a standard deviation.
MAD_TO_SD, MEAN_TO_SD = 1.4826, 1.2533


def _finite(x: Column) -> Column:
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def _squash(x: Column, median: Column, spread: Column) -> Column:
    """The bounded value; a score all candidates share says nothing and counts as one half."""
    z = F.when(spread > 0, (x - median) / spread).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-REACH), F.least(F.lit(REACH), z))))


def _fuse(bounded: list[Column], used: list[Column], weights: list[float]) -> Column:
    total = reduce(lambda a, b: a + b, [F.when(u, F.lit(w)).otherwise(F.lit(0.0)) for u, w in zip(used, weights)])
    logs = reduce(lambda a, b: a + b, [F.when(u, F.lit(w) * F.ln(x)).otherwise(F.lit(0.0)) for x, u, w in zip(bounded, used, weights)])
    return F.when(total > 0, F.exp(logs / total)).otherwise(F.lit(0.0))


def _median(values: Column) -> Column:
    n = F.size(values)
    return (F.element_at(values, ((n + 1) / 2).cast("int")) + F.element_at(values, (n / 2).cast("int") + 1)) / 2


def _small(rows: DataFrame, scores: list[str], weights: list[float]) -> DataFrame:
    """Requests of bounded size: one shuffle by request, then arithmetic on arrays of its candidates."""
    arrays = rows.groupBy("request_id").agg(F.collect_list(F.struct("doc_id", *scores)).alias("c"))
    for s in scores:
        arrays = arrays.withColumn(f"v_{s}", F.array_sort(F.filter(F.col("c")[s], lambda x: x.isNotNull())))
    some = {s: F.size(f"v_{s}") > 0 for s in scores}
    for s in scores:
        arrays = arrays.withColumn(f"m_{s}", F.when(some[s], _median(F.col(f"v_{s}"))))
    for s in scores:
        median = F.col(f"m_{s}")
        off = F.transform(f"v_{s}", lambda x: F.abs(x - median))
        mean = F.try_divide(F.aggregate(off, F.lit(0.0), lambda a, x: a + x), F.size(off))
        mad = F.when(some[s], _median(F.array_sort(off)))
        arrays = arrays.withColumn(f"d_{s}", F.when(mad > 0, mad * MAD_TO_SD).otherwise(mean * MEAN_TO_SD)).withColumn(f"l_{s}", F.when(some[s], F.col(f"v_{s}")[0]))
    each = arrays.select("request_id", *[f"{k}_{s}" for s in scores for k in "mdl"], F.inline("c"))
    return _scored(each, scores, weights)


def _scored(each: DataFrame, scores: list[str], weights: list[float]) -> DataFrame:
    bounded = {s: _squash(F.coalesce(F.col(s), F.col(f"l_{s}")), F.col(f"m_{s}"), F.col(f"d_{s}")) for s in scores}
    each = each.select("request_id", "doc_id", *[F.when(F.col(f"l_{s}").isNotNull(), bounded[s]).alias(f"u_{s}") for s in scores])
    return each.withColumn("fused", F.round(_fuse([F.col(f"u_{s}") for s in scores], [F.col(f"u_{s}").isNotNull() for s in scores], weights), 9))


def _hot(rows: DataFrame, scores: list[str], weights: list[float]) -> DataFrame:
    """Requests of any size: medians by position in a distributed sort, so no task holds a request."""
    rows = cut(rows)
    long = rows.select("request_id", "doc_id", F.inline(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("x")) for s in scores]))).where(F.col("x").isNotNull())

    def medians(of: DataFrame, name: str) -> DataFrame:
        n = of.groupBy("request_id", "score").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.min("x").alias("least"))
        at = lookup(distributed_positions(of, ["request_id", "score"], [F.col("x"), F.col("doc_id")], "at"), cut(n), ["request_id", "score"])
        at = at.where((F.col("at") == F.floor((F.col("n") + 1) / 2)) | (F.col("at") == F.floor(F.col("n") / 2) + 1))
        return cut(at.groupBy("request_id", "score").agg(F.avg("x").alias(name), F.first("mean").alias(f"mean_{name}"), F.first("least").alias(f"least_{name}")))

    middle = medians(long, "m")
    off = lookup(long, middle, ["request_id", "score"]).select("request_id", "score", "doc_id", F.abs(F.col("x") - F.col("m")).alias("x"))
    spread = medians(off, "mad")
    stats = middle.join(spread, ["request_id", "score"]).select("request_id", "score", "m", F.col("least_m").alias("l"), F.when(F.col("mad") > 0, F.col("mad") * MAD_TO_SD).otherwise(F.col("mean_mad") * MEAN_TO_SD).alias("d"))
    of = {(k, s): F.max(F.when(F.col("score") == s, F.col(k))).alias(f"{k}_{s}") for k in "mdl" for s in scores}
    wide = cut(stats.groupBy("request_id").agg(*of.values()))
    return _scored(lookup(rows, wide, ["request_id"], "left"), scores, weights)


def fuse_scores(candidates: DataFrame, scores: list[str], weights: list[float] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One ranking of each request's candidates: ``request_id``, ``doc_id``, ``u_<score>``, ``fused``, ``rk``.

    Each score is standardised within its request by median and median absolute deviation (where that is
    0, by the mean absolute deviation), squashed by the logistic function, and the bounded values are
    joined by a weighted geometric mean. A score no candidate of a request has, is left out there (null);
    a candidate a retriever did not return gets that request's lowest value of it. NaN and infinity count
    as missing; a request without any score has ``fused`` 0. Rows delivered twice count once, the one
    ingested last. Null request or document ids are left out. Ties go to the lower ``doc_id``.

    Requests of up to ``hot_rows`` rows take one shuffle; larger ones are sorted across tasks.
    """
    weights = weights or [1.0] * len(scores)
    rows = candidates.select("request_id", "doc_id", "ingested_at", *[_finite(F.col(s)).alias(s) for s in scores]).where(F.col("request_id").isNotNull() & F.col("doc_id").isNotNull())
    hot = cut(rows.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("request_id"))
    any_hot = hot.limit(1).count() > 0

    def once(part: DataFrame) -> DataFrame:
        last = part.groupBy("request_id", "doc_id").agg(F.max(F.struct("ingested_at", *scores)).alias("last"))
        return last.select("request_id", "doc_id", *[F.col(f"last.{s}").alias(s) for s in scores])

    usual = lookup(rows, hot, ["request_id"], "left_anti") if any_hot else rows
    ranked = _small(once(usual.repartition("request_id")), scores, weights)
    order = [F.desc("fused"), F.asc("doc_id")]
    out = ranked.withColumn("rk", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)).cast("long"))
    if any_hot:
        big = _hot(once(lookup(rows, hot, ["request_id"], "left_semi")), scores, weights)
        out = out.unionByName(distributed_positions(big, ["request_id"], order))
    return out
