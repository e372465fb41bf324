"""Freely typed values mapped to the entries of a reference list (problem 1)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.setjoin import char_grams, prefix_join, short_join, swap_or_edit
from shelfspark.llm.textform import folded
from shelfspark.operators.sizing import lookup
from shelfspark.session import cut

#: Least Jaccard similarity of the character bigrams of two spellings; one slip in a longer name than ``SHORT`` keeps more.
SIMILARITY = 0.3
#: Letters of a name of which one slip can leave too few bigrams; such names are met by their forms with one letter less as well.
SHORT = 8

# Legal forms, shop wording and signs that do not belong to a name.
BEFORE = r"visit the|visita la tienda(?: oficial)? de|tienda oficial(?: de)?|tienda(?: de)?|brand|marca|ブランド|メーカー|by|de|from|por"
AFTER = (
    r"official(?: store| shop)?|store|shop|tienda oficial|oficial|公式(?:ストア|ショップ|店)?|ストア|ショップ|専門店|正規品|"
    r"incorporated|inc|llc|ltd|limited|corporation|corp|company|co\.? ?,? ?ltd|co|gmbh|plc|"
    r"españa s\.? ?a|españa|s\.? ?l\.? ?u|s\.? ?l|s\.? ?a|株式会社|有限会社|合同会社|\(株\)|\(有\)|ジャパン|japan|usa"
)

_before = re.compile(rf"^\s*(?:(?:{BEFORE})\b\s*[:：]?\s+|(?:brand|marca|ブランド|メーカー)\s*[:：]\s*|株式会社\s*|\(株\)\s*)")
_after = re.compile(rf"(?:[\s,、]+(?:{AFTER})|(?<=[゠-ヿ一-鿿a-z0-9])(?:公式(?:ストア|ショップ|店)?|ストア|ショップ|株式会社|有限会社|\(株\)|\(有\)))[\s.,]*$")
_marks = re.compile("[®™©【】「」『』\\[\\]\"“”]")
_parts = re.compile(r"^(.*?)\((.*)\)\s*$")


def _without_accents(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ"))


def _compact(text: str) -> str:
    if text.isascii():
        return text if text.isalnum() else "".join(filter(str.isalnum, text))
    return "".join(c for c in _without_accents(text) if c.isalnum() or c == "ー")


def name_cores(value: str) -> list[str]:
    """The spellings a typed value may stand for: without wrapping words, legal forms, accents, spaces and signs."""
    text = _marks.sub(" ", folded(value.replace("™", " ").replace("㈱", "(株)"))).strip(" .,;:-_|/")
    seen: list[str] = []

    def add(t: str) -> None:
        while True:
            cut_ = _after.sub("", _before.sub("", t)).strip(" .,;:-_|/")
            if cut_ == t or not cut_:
                break
            t = cut_
        if (c := _compact(t)) and c not in seen:
            seen.append(c)

    add(text)
    if m := _parts.match(text):
        add(m[1])
        add(m[2])
    if (whole := _compact(text)) and whole not in seen:
        seen.append(whole)
    return seen


def map_names(values: DataFrame, reference: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The entry of ``reference`` each distinct value means: ``value``, ``brand_id`` (-1: none), ``jaccard``.

    ``values``: column ``value``; nulls and blanks are left out, repeated values come out once.
    ``reference``: ``brand_id``, ``brand_name``, ``brand_kana`` (may be null). A value is an entry's if
    one of its spellings equals one of the entry's, or else is the most similar by the bigram sets and
    at most one slip (also a swap) away, however short it is; ties go to the lower ``brand_id``. An empty reference gives -1 throughout.
    """

    def cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"value": b["value"], "core": [name_cores(v) for v in b["value"]]})

    distinct = values.select("value").where(F.col("value").isNotNull()).distinct()
    typed = cut(distinct.mapInPandas(cores, "value string, core array<string>").select("value", F.explode_outer("core").alias("core")))
    names = reference.select("brand_id", F.explode(F.array("brand_name", "brand_kana")).alias("value")).where(F.col("value").isNotNull())
    forms = names.mapInPandas(lambda bs: (pd.DataFrame({"brand_id": b["brand_id"], "form": b["value"].map(lambda v: _compact(folded(v)))}) for b in bs), "brand_id long, form string")
    forms = cut(forms.where(F.col("form") != "").groupBy("form").agg(F.min("brand_id").alias("brand_id")))

    wanted = typed.where(F.col("core").isNotNull()).select("core").distinct()
    exact = lookup(wanted, forms.withColumnRenamed("form", "core"), ["core"]).withColumn("jaccard", F.lit(1.0))
    rest = cut(wanted.join(exact, "core", "left_anti").select(F.col("core").alias("key"), char_grams(F.col("core")).alias("tokens")))
    listed = forms.select(F.col("form").alias("key"), char_grams(F.col("form")).alias("tokens"))
    near = prefix_join(rest, listed, threshold)
    short = short_join(rest, listed, SHORT)
    shared = F.size(F.array_intersect(char_grams(F.col("left_key")), char_grams(F.col("right_key"))))
    every = F.size(F.array_union(char_grams(F.col("left_key")), char_grams(F.col("right_key"))))
    near = near.unionByName(short.withColumn("jaccard", shared / every)).distinct()
    near = near.where(swap_or_edit(F.col("left_key"), F.col("right_key")))
    near = lookup(near.withColumnRenamed("right_key", "form"), forms, ["form"])
    best = near.groupBy(F.col("left_key").alias("core")).agg(F.min(F.struct((-F.col("jaccard")).alias("d"), "brand_id")).alias("m"))
    best = best.select("core", "m.brand_id", (-F.col("m.d")).alias("jaccard"))
    by_core = cut(exact.select("core", "brand_id", "jaccard").unionByName(best))
    joined = lookup(typed, by_core, ["core"], "left")
    chosen = joined.groupBy("value").agg(F.min(F.when(F.col("brand_id").isNotNull(), F.struct((-F.col("jaccard")).alias("d"), "brand_id"))).alias("m"))
    return chosen.select("value", F.coalesce("m.brand_id", F.lit(-1)).cast("long").alias("brand_id"), (-F.col("m.d")).alias("jaccard"))
