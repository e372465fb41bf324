"""Items that occur together more often than chance (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.sizing import lookup
from shelfspark.session import cut

#: Items of a basket that one task pairs; larger baskets are cut into chunks of this size.
CHUNK = 256


def _ordinary(baskets: DataFrame) -> DataFrame:
    sets = baskets.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("s"))
    firsts = sets.select("s", F.posexplode("s").alias("i", "a"))
    return firsts.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))


def _chunked(baskets: DataFrame, sizes: DataFrame, chunk: int, keep_basket: bool = False) -> DataFrame:
    """Pairs of large baskets: every two chunks of a basket meet in a task of their own."""
    parts = F.ceil(F.col("n") / chunk).cast("int")
    placed = lookup(baskets, sizes, ["basket"]).withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    left = placed.select("basket", "item", "p", F.explode(other).alias("q")).where("p <= q").select("basket", F.col("p").alias("lo"), F.col("q").alias("hi"), F.col("item").alias("x"))
    right = placed.select("basket", "item", "p", F.explode(other).alias("q")).where("q <= p").select("basket", F.col("q").alias("lo"), F.col("p").alias("hi"), F.col("item").alias("y"))
    met = left.join(right, ["basket", "lo", "hi"]).where((F.col("lo") < F.col("hi")) | (F.col("x") < F.col("y")))
    return met.select(*(["basket"] if keep_basket else []), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def associated_pairs(rows: DataFrame, basket: str, item: str, min_together: int, min_lift: float, chunk: int = CHUNK) -> DataFrame:
    """Pairs of items with ``n_ab >= min_together`` and ``n_ab * N >= min_lift * n_a * n_b``.

    ``N`` is the number of baskets, ``n_a``, ``n_b`` and ``n_ab`` those with the item or both; a repeated
    (basket, item) counts once, null baskets and items not at all, other columns are ignored. Result:
    ``item_a`` < ``item_b`` (by code point), ``n_a``, ``n_b``, ``n_ab``, ``n_baskets``, ``lift``. Items
    that can be in no such pair are left out first: those with ``n < min_together`` and those with
    ``n * min_lift > N``, as ``n_ab`` is at most either count. Baskets over ``chunk`` items are cut into
    chunks whose products are spread over tasks, so no task holds a large basket.
    """
    once = cut(rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where(F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct())
    n_baskets = once.select("basket").distinct().count()
    counts = once.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    able = cut(counts.where((F.col("n_item") >= min_together) & (F.col("n_item") * F.lit(float(min_lift)) <= F.lit(n_baskets))))
    kept = lookup(once, able.select("item"), ["item"], "left_semi")
    sizes = cut(kept.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    large = cut(sizes.where(F.col("n") > chunk))
    pairs = _ordinary(lookup(kept, sizes.where(F.col("n") <= chunk), ["basket"], "left_semi"))
    if large.limit(1).count():
        pairs = pairs.unionByName(_chunked(kept, large, chunk))
    together = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= min_together)
    for side in "ab":
        together = lookup(together, able.select(F.col("item").alias(side), F.col("n_item").alias(f"n_{side}")), [side])
    lift = F.col("n_ab") * F.lit(n_baskets) / (F.col("n_a") * F.col("n_b"))
    found = together.where(F.col("n_ab") * F.lit(n_baskets) >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    return found.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_a", "n_b", "n_ab", F.lit(n_baskets).alias("n_baskets"), lift.alias("lift"))
