"""Names of a dictionary in texts: whole words where words are parted by spaces, anywhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.sizing import lookup
from shelfspark.session import cut


def brand_mentions(texts: DataFrame, names: DataFrame, spaceless: str = "jp") -> DataFrame:
    """``rec``, ``locale``, ``name``: each name that stands in a text of its locale, once; overlapping names all count.

    ``texts``: ``rec``, ``locale``, ``text`` in the form of the names; ``names``: ``locale``, ``name``. The runs of words of each
    length that some name of the locale has, or in the locale ``spaceless`` the pieces of each length, meet the names in an
    equi-join, however many words a name has. Null and empty texts and names match nothing.
    """
    some = cut(names.where(F.char_length("name") > 0).select("locale", "name").distinct())
    clean = F.trim(F.regexp_replace("text", r"[^\p{L}\p{N}\p{M}_]+", " "))
    free = F.col("locale") == spaceless
    units = F.when(free, F.char_length("name")).otherwise(F.size(F.split("name", " ")))
    lengths = cut(some.select("locale", units.alias("n")).groupBy("locale").agg(F.collect_set("n").alias("lengths")))
    rows = lookup(texts.where(F.char_length("text") > 0).select("rec", "locale", "text", F.split(clean, " ").alias("w")), lengths, ["locale"])
    size = F.when(free, F.char_length("text")).otherwise(F.size("w"))
    each = rows.select("rec", "locale", "text", "w", F.explode("lengths").alias("n"), size.alias("size")).where("n <= size")
    each = each.select("rec", "locale", "text", "w", "n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("i"))
    found = each.select("rec", "locale", F.when(free, F.substring("text", F.col("i"), F.col("n"))).otherwise(F.array_join(F.slice("w", F.col("i"), F.col("n")), " ")).alias("name")).distinct()
    return lookup(found, some, ["locale", "name"], "left_semi")
