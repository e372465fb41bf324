"""Quantities written in many units and notations, in one unit per quantity (problem 4)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The units of each quantity, their size in the common unit and their spellings in
# English, Spanish and Japanese (lower case, without accents).
UNITS = {
    "length": {  # micrometres
        "1000": "mm millimeter millimeters millimetre millimetres milimetro milimetros ミリ ミリメートル",
        "10000": "cm cms centimeter centimeters centimetre centimetres centimetro centimetros センチ センチメートル",
        "1000000": "m mt mts meter meters metre metres metro metros メートル",
        "25400": "in ins inch inches \" ″ ” '' pulgada pulgadas pulg インチ 型",
        "304800": "ft foot feet ' ′ ’ pie pies フィート フット",
        "914400": "yd yds yard yards yarda yardas ヤード",
    },
    "volume": {  # microlitres
        "1000": "ml mls milliliter milliliters millilitre millilitres mililitro mililitros cc ccm ミリリットル シーシー",
        "10000": "cl centiliter centiliters centilitre centilitres centilitro centilitros センチリットル",
        "100000": "dl deciliter deciliters decilitre decilitres decilitro decilitros デシリットル",
        "1000000": "l lt ltr ltrs lts liter liters litre litres litro litros リットル",
        "29573.5295625": "floz fl|oz fl.|oz fl.oz fluid|ounce fluid|ounces fluid|oz onza|liquida onzas|liquidas 液量オンス 液体オンス",
        "473176.473": "pt pint pints pinta pintas パイント",
        "946352.946": "qt qts quart quarts cuarto|de|galon cuartos|de|galon クォート クオート",
        "3785411.784": "gal gallon gallons galon galones ガロン",
    },
    "mass": {  # milligrams
        "1": "mg milligram milligrams miligramo miligramos ミリグラム",
        "1000": "g gr grs gm gms gram grams gramme grammes gramo gramos グラム",
        "1000000": "kg kgs kilo kilos kilogram kilograms kilogramo kilogramos キロ キログラム",
        "28349.523125": "oz ozs ounce ounces onza onzas オンス",
        "453592.37": "lb lbs pound pounds libra libras ポンド",
    },
    "storage": {  # megabytes
        "1": "mb megabyte megabytes mega megas メガ メガバイト",
        "1000": "gb gigabyte gigabytes giga gigas ギガ ギガバイト",
        "1000000": "tb terabyte terabytes tera teras テラ テラバイト",
    },
    "charge": {  # milliampere-hours
        "1": "mah milliamp|hour milliamp|hours milliampere-hours miliamperios|hora ミリアンペア時 ミリアンペアアワー",
        "1000": "ah amp|hour amp|hours ampere-hours amperios|hora アンペア時 アンペアアワー",
    },
    "power": {  # milliwatts
        "1000": "w watt watts vatio vatios ワット",
        "1000000": "kw kilowatt kilowatts kilovatio kilovatios キロワット",
    },
}
#: Digits a number may have; longer ones are no quantity (their amounts would not fit a long).
DIGITS = 12
SIDES = "largo ancho alto fondo profundidad length width height depth 幅 奥行き 奥行 高さ 縦 横 l w h d"

_SIZE = {name.replace("|", " "): (q, Fraction(size)) for q, sizes in UNITS.items() for size, names in sizes.items() for name in names.split(" ")}
_unit = "|".join(re.escape(n).replace(r"\ ", r"\s*") for n in sorted(_SIZE, key=len, reverse=True))
_plain_number = {"dot": r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+", "comma": r"\d{1,3}(?:\.\d{3})+,\d+|\d+(?:[.,]\d+)?"}
_measure = {
    k: re.compile(
        rf"(?<![\d.,/a-z])(?P<whole>\d+\s+)?(?P<top>\d+)/(?P<bottom>\d+)(?P<u1>[\s-]*(?:{_unit})(?![^\W\d_ぁ-ヿ一-鿿]))?(?![\d/])"
        rf"|(?<![\d.,/])(?P<number>{n})(?P<u2>[\s-]*(?:{_unit})(?![^\W_ぁ-ヿ一-鿿]))?"
    )
    for k, n in _plain_number.items()
}
_in_one = re.compile(r"\b\d+\s*(?:in|en)\s*-?\s*1\b")
_chain = re.compile(rf"\s*(?:[x×*]\s*(?:{'|'.join(SIDES.split())})?|[,\s]\s*(?:{'|'.join(SIDES.split())}))\s*\.?:?\s*")
_in_a_row = re.compile(r"\s*(?:,|and|y|と)?\s*")


@lru_cache(maxsize=1 << 16)
def _tidy(text: str) -> str:
    if text.isascii():
        return _in_one.sub(" ", text.lower())
    out = "".join(f" {unicodedata.normalize('NFKC', c).replace('⁄', '/')}" if unicodedata.decomposition(c).startswith("<fraction>") else c for c in text)
    out = unicodedata.normalize("NFKC", out).replace("⁄", "/").replace("‐", "-").replace("‑", "-").replace("−", "-").casefold()
    out = re.sub("[­​-‏⁠﻿]", "", out)
    if not out.isascii():
        out = unicodedata.normalize("NFC", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", out)))
    return _in_one.sub(" ", out)


_fraction = lru_cache(maxsize=1 << 16)(Fraction)


def _value(m: re.Match, comma_decimal: bool) -> Fraction | None:
    if len(m[0]) > 40 or max(map(len, re.findall(r"\d+", m[0].replace(",", "") if not comma_decimal else m[0]))) > DIGITS:
        return None
    if m["top"]:
        return (int(m["whole"] or 0) + Fraction(int(m["top"]), int(m["bottom"]))) if int(m["bottom"]) else None
    n = m["number"]
    if comma_decimal:
        n = n.replace(".", "").replace(",", ".") if "," in n and "." in n else n.replace(",", ".")
    else:
        n = n.replace(",", "")
    return _fraction(n)


@lru_cache(maxsize=1 << 16)
def quantities(text: str, comma_decimal: bool) -> tuple[tuple[Fraction, str | None, Fraction | None, int, int], ...]:
    """Numbers of a text with their quantity and unit size; sides of one dimension share the unit that follows them."""
    t = _tidy(text)
    found: list[list] = []
    for m in _measure["comma" if comma_decimal else "dot"].finditer(t):
        value = _value(m, comma_decimal)
        if value is None:
            continue
        name = re.sub(r"\s+", " ", (m["u1"] or m["u2"] or "").strip(" -\t "))
        q, size = _SIZE.get(name) or _SIZE.get(name.replace(" ", "")) or (None, None)
        found.append([value, q, size, m.start(), m.end(), q is not None])
    for a, b in zip(reversed(found[:-1]), reversed(found[1:])):
        if a[1] is None and b[1] == "length" and _chain.fullmatch(t[a[4] : b[3]]):
            a[1], a[2] = b[1], b[2]
    return tuple(tuple(x[:5]) for x in found)


def _round(x: Fraction) -> int:
    return (x + Fraction(1, 2)).__floor__()


def entry_amounts(entry: str, texts: tuple[str, ...], comma_decimal: bool, dimension: bool) -> list[tuple[int, str, int]]:
    """(side, quantity, amount in the common unit) of each quantity an entry states.

    A number without unit takes the unit the same number has in the first of ``texts`` that has one.
    """
    found = quantities(entry, comma_decimal)
    if not any(q for _, q, *_ in found):
        known: dict[Fraction, tuple[str, Fraction]] = {}
        for t in texts:
            for value, q, size, *_ in quantities(t, comma_decimal):
                if q and (q == "length" or not dimension):
                    known.setdefault(value, (q, size))
        found = tuple((v, *known.get(v, (None, None)), a, b) for v, _, _, a, b in found)
        if not dimension and len(found) != 1:
            return []
    if dimension:
        return [(i, q, _round(v * size)) for i, (v, q, size, *_) in enumerate(found) if q == "length"]
    t, sums, last = _tidy(entry), [], None
    for v, q, size, start, end in found:
        if q is None:
            last = None
            continue
        if last and sums[-1][0] == q and size < last[0] and _in_a_row.fullmatch(t[last[1] : start]):
            sums[-1][1] += v * size
        elif q not in [s[0] for s in sums]:
            sums.append([q, v * size])
        else:
            last = None
            continue
        last = (size, end)
    return [(0, q, _round(x)) for q, x in sums]


def common_units(rows: DataFrame, key: str, locale: str, entries: str, texts: list[str], src_field: str, dimension: bool = False) -> DataFrame:
    """Each quantity of the entries: ``src_field``, ``rec_key``, ``entry_no``, ``side_no``, ``quantity``, ``amount``.

    ``entries`` is an array of strings as typed. Amounts are whole micrometres, microlitres, milligrams,
    megabytes, milliampere-hours or milliwatts, rounded to nearest, halves up, from exact fractions. In
    locale es a comma is the decimal sign, elsewhere it separates thousands. Null arrays, null, empty and
    unreadable entries and those that are no quantity give no rows; repeated rows come out once. Rows are
    read where they lie: there is no shuffle but the last distinct over what was found.
    """
    some = rows.select(F.col(key).cast("string").alias("k"), F.col(locale).alias("l"), F.col(entries).alias("e"), *[F.coalesce(F.col(t), F.lit("")).alias(f"t{i}") for i, t in enumerate(texts)])
    some = some.where((F.size("e") > 0) & F.col("k").isNotNull())
    schema = "rec_key string, entry_no long, side_no long, quantity string, amount long"
    n_texts = len(texts)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            columns = [b[f"t{i}"] for i in range(n_texts)]
            for k, loc, e, *t in zip(b["k"], b["l"], b["e"], *columns):
                for i, entry in enumerate(e):
                    if entry:
                        out += [(k, i, *x) for x in entry_amounts(entry, tuple(t), loc == "es", dimension)]
            yield pd.DataFrame(out, columns=["rec_key", "entry_no", "side_no", "quantity", "amount"])

    return some.mapInPandas(read, schema).distinct().select(F.lit(src_field).alias("src_field"), "rec_key", "entry_no", "side_no", "quantity", "amount")
