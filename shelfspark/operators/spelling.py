"""Words corrected to far more frequent ones, one slip away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import damerau_one, deletes, stem
from shelfspark.functions.words import STOPWORDS
from shelfspark.operators.sizing import lookup
from shelfspark.session import cut

MIN_DF, MAX_DF, MIN_RATIO, RARE_DF, STRONG_RATIO = 5, 3, 20, 50, 200


def corrections(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``term``, ``n0`` (its frequency), ``suggestion``, ``n`` of every word that needs one.

    ``words``: ``term``; ``vocabulary``: ``term``, ``df``. A word of four letters or more needs a
    suggestion if fewer than MAX_DF documents have it (then MIN_RATIO times as frequent) or at most RARE_DF
    (then STRONG_RATIO times). Candidates share a form with one sign less; of those one slip away the most
    frequent is taken, the first by name among equals.
    """
    latin = r"^[a-zß-˿]+$"
    asked = words.where(F.col("term").rlike(latin) & (F.char_length("term") >= 4)).distinct()
    seen = asked.join(vocabulary, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("n0"))
    need = F.when(F.col("n0") < MAX_DF, MIN_RATIO * F.greatest("n0", F.lit(1))).when(F.col("n0") <= RARE_DF, STRONG_RATIO * F.col("n0"))
    wanting = seen.withColumn("need", need).where(F.col("need").isNotNull())
    known = vocabulary.where((F.col("df") >= MIN_DF) & (F.char_length("term") >= 3) & F.col("term").rlike(latin))
    left = wanting.select("term", "n0", "need", F.explode(deletes(F.col("term"))).alias("form"))
    right = known.select(F.col("term").alias("suggestion"), F.col("df").alias("n"), F.explode(deletes(F.col("term"))).alias("form"))
    met = left.join(right, "form").where((F.col("suggestion") != F.col("term")) & (F.col("n") >= F.col("need"))).select("term", "n0", "suggestion", "n").distinct()
    near = met.where(damerau_one(F.col("term"), F.col("suggestion")))
    best = near.groupBy("term", "n0").agg(F.min(F.struct((-F.col("n")).alias("m"), "suggestion")).alias("b"))
    return best.select("term", F.col("n0").cast("long").alias("n0"), "b.suggestion", (-F.col("b.m")).cast("long").alias("n"))


def correct(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Texts with the corrections of their words: ``key``, ``text``, ``expanded``, ``replaced``, ``changes``.

    ``texts`` are in normal form with single spaces. A word is tried as it stands and as its stem, since folding plurals can
    garble a slip, and the more frequent suggestion is taken; stop words, words of ``protected`` (``term``) and words frequent
    enough stay. ``expanded`` keeps the word and adds the suggestion, ``replaced`` has it instead. Null and empty texts stay.
    """
    words = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, " ")).alias("at", "raw")).withColumn("st", stem(F.col("raw")))
    words = cut(words)
    fixes = corrections(words.select(F.col("raw").alias("term")).union(words.select("st")), vocabulary)
    if protected is not None:
        fixes = lookup(fixes, protected, ["term"], "left_anti")
    fixes = cut(fixes.select("term", "suggestion", "n"))
    frequent = cut(vocabulary.where(F.col("df") > RARE_DF).select(F.col("term").alias("st")))
    tried = lookup(words.where(~F.col("st").isin(*STOPWORDS)), frequent, ["st"], "left_anti")
    both = tried.select(key, "at", "st", F.explode(F.array_distinct(F.array("raw", "st"))).alias("term"))
    best = lookup(both, fixes, ["term"]).where(F.col("suggestion") != F.col("st")).groupBy(key, "at").agg(F.min(F.struct((-F.col("n")).alias("m"), "suggestion")).alias("b")).select(key, "at", F.col("b.suggestion").alias("s"))
    made = words.join(best, [key, "at"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "raw", "s"))).alias("x"))
    one = lambda f: F.array_join(F.transform("x", f), " ")
    out = made.select(key, one(lambda x: x["raw"]).alias(text), one(lambda x: F.when(x["s"].isNotNull(), F.concat(x["raw"], F.lit(" "), x["s"])).otherwise(x["raw"])).alias("expanded"), one(lambda x: F.coalesce(x["s"], x["raw"])).alias("replaced"), F.size(F.filter("x", lambda x: x["s"].isNotNull())).alias("changes"))
    return out.unionByName(texts.where(F.col(text).isNull()).select(key, text, F.col(text).alias("expanded"), F.col(text).alias("replaced"), F.lit(0).alias("changes")))
