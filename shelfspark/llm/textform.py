"""One plain form for texts that look alike (problem 7).

``plain`` is the compatibility-composed form of a text without default-ignorable characters, with
ASCII spaces and hyphens and with every letter in the script its word is written in; ``folded`` is
its full case folding. Both are computed once per distinct value of an Arrow batch, without a shuffle,
so a value that fills a third of the table costs no more than any other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default-ignorable code points, spaces, hyphens and look-alike letters of Unicode.
IGNORABLE = r"­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U000e0000-\U000e0fff"
SPACES = r"   -     　"
HYPHENS = r"‐-―⁃−⸺⸻﹘﹣－"
CYRILLIC = ("АВЕІЈКМНОРСТУХЅаеорсухіјѕһԁԛԝ", "ABEIJKMHOPCTYXSaeopcyxijshdqw")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονυιϳ", "ABEZHIKMNOPTYXovuij")
ARMENIAN = ("ՕՍԼհոսցզօյ", "OULhnugqoj")
CHEROKEE = ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏢᏙᏚᏞᏟᏦᏴ", "DRTAJEWMHGZPVSLCKB")
KANA_OF_KANJI = ("八卜口力夕二工才千三又一", "ハトロカタニエオチミヌー")
KANA_OF_HIRAGANA = ("へべぺ", "ヘベペ")

_LOOKS = {"cyrillic": CYRILLIC, "greek": GREEK, "armenian": ARMENIAN, "cherokee": CHEROKEE}
_BLOCKS = {"greek": "Ͱ-Ͽ", "cyrillic": "Ѐ-ԯ", "armenian": "԰-֏", "cherokee": "Ꭰ-Ᏽ"}
_LATIN_OF = {a: b for pair in _LOOKS.values() for a, b in zip(*pair)}
_FROM_LATIN = {script: {b: a for a, b in zip(*pair)} for script, pair in _LOOKS.items()}
_KANA_OF = dict(zip(*KANA_OF_KANJI))
_KANJI_OF = {b: a for a, b in zip(*KANA_OF_KANJI) if b != "ー"}
_KATAKANA = r"゠-ヿㇰ-ㇿ"
_KANJI = r"㐀-䶿一-鿿々"

_ignorable = re.compile(f"[{IGNORABLE}]")
_spaces = re.compile(f"[{SPACES}]")
_hyphens = re.compile(f"[{HYPHENS}]")
_FOREIGN = "".join(_BLOCKS.values())
_foreign = re.compile(f"[{_FOREIGN}]")
_script_of = {script: re.compile(f"[{block}]") for script, block in _BLOCKS.items()}
_word = re.compile(r"[^\W\d_]+")
_kana_kanji = re.compile(f"[{KANA_OF_KANJI[0]}]")
_hira_in_kata = re.compile(f"(?<=[{_KATAKANA}])[{KANA_OF_HIRAGANA[0]}]|[{KANA_OF_HIRAGANA[0]}](?=[{_KATAKANA}])")
_kata_in_kanji = re.compile(f"(?<=[{_KANJI}])[{''.join(_KANJI_OF)}](?=[{_KANJI}])")
_is_kata = re.compile(f"[{_KATAKANA}]")
_is_kanji = re.compile(f"[{_KANJI}]")


def _script(c: str) -> str:
    if _foreign.match(c):
        return next(script for script, block in _script_of.items() if block.match(c))
    return "latin" if c.isascii() or ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00 else "other"


def _one_script(text: str) -> str:
    """Look-alike letters of other alphabets in the script their word is written in."""
    foreign_text = any(c not in _LATIN_OF for c in _foreign.findall(text))

    def word(m: re.Match) -> str:
        w = m[0]
        if not _foreign.search(w):
            return w
        own = {_script(c) for c in w if _foreign.match(c) and c not in _LATIN_OF}
        if len(own) == 1:  # the word is of that script; the look-alikes in it are Latin letters
            back = _FROM_LATIN[own.pop()]
            return "".join(back.get(c, c) for c in w)
        if own or (foreign_text and "latin" not in {_script(c) for c in w}):
            return w
        return "".join(_LATIN_OF.get(c, c) for c in w)

    return _word.sub(word, text)


def _one_kana(text: str) -> str:
    """Kanji and hiragana that pass for katakana inside a katakana word, and the reverse."""
    if _kana_kanji.search(text):
        out = list(text)
        for m in _kana_kanji.finditer(text):
            i = m.start()
            before, after = out[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "
            kata = _is_kata.match(before) or _is_kata.match(after)
            kanji = any(_is_kanji.match(c) and c not in _KANA_OF for c in (before, after))
            if after == "ー" or kata and not kanji:  # the long-vowel sign stands behind kana only
                out[i] = _KANA_OF[m[0]]
        text = "".join(out)
    text = _hira_in_kata.sub(lambda m: KANA_OF_HIRAGANA[1][KANA_OF_HIRAGANA[0].index(m[0])], text)
    return _kata_in_kanji.sub(lambda m: _KANJI_OF[m[0]], text)


_doubtful = re.compile(f"[{IGNORABLE}{SPACES}{HYPHENS}{_FOREIGN}{KANA_OF_KANJI[0]}{KANA_OF_HIRAGANA[0]}{''.join(_KANJI_OF)}]")


def plain(text: str) -> str:
    """The plain form, case kept. A text is in plain form when it equals this."""
    if text.isascii() or not _doubtful.search(text) and unicodedata.is_normalized("NFKC", text):
        return text
    text = unicodedata.normalize("NFKC", _hyphens.sub("-", _spaces.sub(" ", _ignorable.sub("", text))))
    text = _hyphens.sub("-", _ignorable.sub("", text))
    if _foreign.search(text):
        text = _one_script(text)
    if not text.isascii():
        text = _one_kana(text)
    return unicodedata.normalize("NFC", text)


@lru_cache(maxsize=1 << 16)
def folded(text: str) -> str:
    """The plain form in full case folding, white space mapped to single spaces: for comparisons.

    Folding a letter can make another one plain form would change, so both are repeated until nothing changes.
    """
    if text.isascii():
        return " ".join(text.lower().split())
    seen = set()
    while text not in seen:
        seen.add(text)
        text = " ".join(unicodedata.normalize("NFKC", plain(text).casefold()).split())
    return text


def _by_distinct(values: pd.Series, f) -> pd.Series:
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    made = [f(v) for v in distinct]
    return pd.Series([made[c] if c >= 0 else None for c in codes], index=values.index, dtype=object)


def fold_column(text: Column) -> Column:
    """``folded`` of a text column; null for null. Texts of printable ASCII stay in the JVM."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return _by_distinct(values, folded)

    ascii_only = text.rlike(r"\A[\x20-\x7e]*\z")
    return F.when(ascii_only, F.trim(F.regexp_replace(F.lower(text), " +", " "))).when(text.isNotNull(), fold(F.when(~ascii_only, text)))


def plain_forms(rows: DataFrame, key: str, text: str, src_field: str) -> DataFrame:
    """Texts of ``rows`` that are not in plain form: ``src_field``, ``rec_key``, ``text``, ``plain``.

    Null and empty texts are in plain form. A row delivered twice comes out once. Other columns of
    ``rows`` are ignored, whatever their names. Texts of ASCII only never leave the JVM; the others are
    normalised once per distinct value of a batch, and there is no shuffle before the last distinct.
    """
    some = rows.select(F.col(key).cast("string").alias("rec_key"), F.col(text).alias("text"))
    some = some.where(F.col("text").rlike(r"[^\x00-\x7f]") & F.col("rec_key").isNotNull())

    def normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["plain"] = _by_distinct(b["text"], plain)
            yield b[b["plain"] != b["text"]]

    found = some.mapInPandas(normalise, "rec_key string, text string, plain string")
    return found.distinct().select(F.lit(src_field).alias("src_field"), "rec_key", "text", "plain")
