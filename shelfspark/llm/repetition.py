"""Share of a text that repeats what it said before (problem 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from shelfspark.llm.textform import plain
from shelfspark.operators.sizing import spread

#: Words (for texts written without spaces: characters) that make a passage.
WORDS, CHARS = 8, 16

_words = re.compile(r"[^\W\d_]+")
_markup = re.compile(r"<[^<>]{0,200}>|&[a-zA-Z]{2,8};")
_spaceless = re.compile(r"[぀-ヿㇰ-ㇿ㐀-鿿豈-﫿]")


def _covered(units: list | str, size: int) -> list[int]:
    """Places of the units that lie in a passage of ``size`` units which the text has had before."""
    grams = list(zip(*[units[i:] for i in range(size)])) if isinstance(units, list) else [units[i : i + size] for i in range(len(units) - size + 1)]
    if len(set(grams)) == len(grams):
        return []
    seen: set = set()
    covered: list[int] = []
    end = 0
    for i, g in enumerate(grams):
        if g in seen:
            covered.extend(range(max(i, end), i + size))
            end = i + size
        else:
            seen.add(g)
    return covered


def repeated_share(text: str | None, words: int = WORDS, chars: int = CHARS) -> float:
    """The share of a text's letters that stand in passages the text has had before.

    Case, punctuation, spacing, character forms, markup and all numbers (counters) are disregarded. Texts
    mostly written without spaces are compared by characters. Null and empty texts have a share of 0.
    """
    if not text:
        return 0.0
    clean = plain(_markup.sub(" ", text) if "<" in text or "&" in text else text).casefold()
    units: list | str = _words.findall(clean)
    if not clean.isascii() and 2 * len(_spaceless.findall(clean)) > sum(map(len, units)):
        units = "".join(units)
        return len(_covered(units, chars)) / len(units) if units else 0.0
    covered = _covered(units, words)
    return sum(len(units[i]) for i in covered) / sum(map(len, units)) if covered else 0.0


def repetition(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``repeated_share`` of every document; no shuffle, each text read once and whole.

    Repeated rows come out as often as they come in; other columns are ignored, whatever their names.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b[key], "repeated_share": [repeated_share(t) for t in b[text]]})

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, text)).mapInPandas(measure, f"doc_id {kind}, repeated_share double")
