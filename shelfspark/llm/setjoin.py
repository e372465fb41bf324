"""Set-similarity join with prefix, length and positional filters, verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.sizing import lookup
from shelfspark.session import cut


def char_grams(text: Column, n: int = 2) -> Column:
    """The distinct character n-grams of a text, with one padding sign at either end."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(padded) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(n))))


def swap_or_edit(a: Column, b: Column) -> Column:
    """Whether two texts differ by at most one insertion, deletion, substitution or adjacent swap."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(a) - 1, F.lit(1)))

    def swapped(i: Column) -> Column:
        return F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.char_length(a)))

    near = F.levenshtein(a, b, 2)
    return F.when((near >= 0) & (near <= 1), True).when(
        (near == 2) & (F.char_length(a) == F.char_length(b)), F.exists(places, lambda i: swapped(i) == b)
    ).otherwise(False)


def prefix_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """All pairs of ``left`` and ``right`` (each: ``key`` unique string, ``tokens`` array of strings) with Jaccard >= threshold.

    Tokens are ordered by their global rarity; only the rare prefixes that a pair of that similarity must
    share are joined, pairs are thinned by their sizes and by the places of the shared token, and the
    similarity of what is left is computed from the whole sets. Result: ``left_key``, ``right_key``,
    ``jaccard``. Empty and null sets have no pairs; no pair is lost.
    """
    t = F.lit(float(threshold))
    sides = [s.select("key", F.array_distinct("tokens").alias("tokens")).where(F.size("tokens") > 0) for s in (left, right)]
    exploded = [s.select("key", F.explode("tokens").alias("token")) for s in sides]
    counts = cut(exploded[0].unionByName(exploded[1]).groupBy("token").agg(F.count(F.lit(1)).alias("n_of")))

    def prefixes(side: DataFrame, name: str) -> DataFrame:
        ranked = lookup(side, counts, ["token"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n_of", "token"))).alias("ordered"))
        n = F.size("ordered")
        length = n - F.ceil(t * n - 1e-9).cast("int") + 1
        ranked = ranked.select(F.col("key").alias(f"{name}_key"), n.alias(f"n_{name}"), F.transform("ordered", lambda x: x["token"]).alias(f"set_{name}"), length.alias("length"))
        return ranked.select(f"{name}_key", f"n_{name}", f"set_{name}", F.posexplode(F.slice(f"set_{name}", F.lit(1), F.col("length"))).alias(f"at_{name}", "token"))

    a, b = prefixes(exploded[0], "left"), cut(prefixes(exploded[1], "right"))
    need = F.ceil(t / (1 + t) * (F.col("n_left") + F.col("n_right")) - 1e-9)
    reach = 1 + F.least(F.col("n_left") - F.col("at_left"), F.col("n_right") - F.col("at_right")) - 1
    pairs = lookup(a, b, ["token"]).where((F.col("n_right") >= t * F.col("n_left") - 1e-9) & (F.col("n_left") >= t * F.col("n_right") - 1e-9) & (reach >= need - F.least("at_left", "at_right")))
    shared = F.size(F.array_intersect("set_left", "set_right"))
    scored = pairs.select("left_key", "right_key", (shared / (F.col("n_left") + F.col("n_right") - shared)).alias("jaccard"))
    return scored.where(F.col("jaccard") >= t - 1e-9).distinct()


def slip_forms(text: Column) -> Column:
    """The text and all texts with one sign less: two texts a slip (or a swap) apart have one of them in common."""
    size = F.char_length(text)
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, size)))
    return F.array_distinct(F.concat(F.array(text), shorter))


def short_join(left: DataFrame, right: DataFrame, longest: int) -> DataFrame:
    """``left_key``, ``right_key``: pairs of ``key`` texts of which one has at most ``longest`` signs that share a slip form."""
    a = left.where(F.char_length("key") <= longest + 1).select(F.col("key").alias("left_key"), F.explode(slip_forms(F.col("key"))).alias("form"))
    b = cut(right.where(F.char_length("key") <= longest + 1).select(F.col("key").alias("right_key"), F.explode(slip_forms(F.col("key"))).alias("form")))
    return lookup(a, b, ["form"]).select("left_key", "right_key").distinct()
