"""Held-out passages inside a large corpus, found by multi-pattern search (problem 9)."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.textform import plain
from shelfspark.operators.ranking import running_total
from shelfspark.operators.sizing import spread
from shelfspark.session import cut

#: Characters of items searched for in one pass over the corpus (what is sent to the tasks); more take further passes.
CHARS_A_PASS = 20_000_000
#: Units of a passage, of a test string and of a shift block: words, and characters of spaceless texts.
WORDS, CHARS = (12, 3, 2), (40, 8, 3)
#: Share of a passage, by weight, that must be found again, and what one of its diagonals must have.
WORDS_ALIKE, CHARS_ALIKE, DIAGONAL = 0.89, 0.85, 0.45
#: Places by which a unit of a passage may have moved.
DRIFT = 2

_markup = re.compile(r"<[^<>]{0,200}>")
_broken = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_words = re.compile(r"[^\W\d_]+|\d+")
_spaceless = re.compile(r"[぀-ヿㇰ-ㇿ㐀-鿿豈-﫿]")


def _clean(text: str) -> str:
    if "<" in text:
        text = _markup.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = plain(_broken.sub("", text) if "-" in text else text).casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFC", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", text)))
    return text


def _units(text: str) -> tuple[list[str], str]:
    """The words of a text, and its letters and digits without anything between (if it has spaceless script)."""
    clean = _clean(text)
    words = _words.findall(clean)
    return words, "".join(words) if not clean.isascii() and _spaceless.search(clean) else ""


class WuManber:
    """All places where a stream of symbols has one of many test strings of equal length.

    The test strings are all windows of ``length`` symbols of ``patterns`` (symbols > 0, parted by 0). A table over
    hashed blocks of ``block`` symbols says how far the search may shift: by how much the last such block in any test
    string lies before its end, or past the block if no test string has it. Only where it may not shift, the strings that
    end with that block are taken from its bucket and compared directly. Many stretches of the stream are searched at once.
    """

    STRETCH, BITS = 512, 20

    def __init__(self, patterns: np.ndarray, length: int, block: int, base: int):
        self.patterns, self.length, self.block, self.base = patterns, length, block, base
        inside = np.convolve(patterns == 0, np.ones(length, int), "valid") == 0 if len(patterns) >= length else np.zeros(0, bool)
        starts = np.flatnonzero(inside)
        self.shift = np.full(1 << self.BITS, length - block + 1, np.int64)
        for before_end in range(length - block, -1, -1):
            self.shift[self._hash(self._block(patterns, starts + length - block - before_end))] = before_end
        suffix = self._block(patterns, starts + length - block)
        order = np.argsort(suffix, kind="stable")
        self.starts, suffix = starts[order], suffix[order]
        self.suffixes, self.first, self.count = np.unique(suffix, return_index=True, return_counts=True)

    def _block(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(self.block):
            out = out * self.base + stream[at + k]
        return out

    def _hash(self, block: np.ndarray) -> np.ndarray:
        return (block * 0x2545F4914F6CDD1D >> 20) & ((1 << self.BITS) - 1)

    def candidates(self, stream: np.ndarray) -> tuple[np.ndarray, int]:
        """Places of blocks that may end a test string, and how many places were looked at to find them."""
        first, end = self.length - self.block, len(stream) - self.block + 1
        at = np.arange(first, end, self.STRETCH)
        stop = np.minimum(at + self.STRETCH, end)
        found, looked = [np.zeros(0, np.int64)], 0
        while len(at):
            looked += len(at)
            step = self.shift[self._hash(self._block(stream, at))]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.sort(np.concatenate(found)), looked

    def search(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each occurrence in the stream and in ``patterns``."""
        back = self.length - self.block
        if not len(self.suffixes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, _ = self.candidates(stream)
        block = self._block(stream, ends)
        bucket = np.minimum(np.searchsorted(self.suffixes, block), len(self.suffixes) - 1)
        real = self.suffixes[bucket] == block
        ends, bucket = ends[real], bucket[real]
        times = self.count[bucket]
        places = np.repeat(ends - back, times)
        within = np.arange(len(places)) - np.repeat(np.cumsum(times) - times, times)
        strings = self.starts[np.repeat(self.first[bucket], times) + within]
        same = np.ones(len(places), bool)
        for k in range(self.length):
            same &= stream[places + k] == self.patterns[strings + k]
        return places[same], strings[same]


class _Side:
    """The items as one stream of symbols (words or characters), their weights and the searcher."""

    def __init__(self, items: list[tuple[int, list[str] | str]], sizes: tuple[int, int, int], diagonal: float, weights: dict[str, float] | None):
        self.passage, length, block = sizes
        self.diagonal = diagonal
        pad = 2 * self.passage
        self.codes = {w: i + 1 for i, w in enumerate(sorted({w for _, units in items for w in units}))}
        weight = np.ones(len(self.codes) + 1)
        weight[0] = 0
        for w, i in self.codes.items() if weights is not None else ():
            weight[i] = weights[w]
        stream, owner = [np.zeros(pad, np.int64)], [np.full(pad, -1)]
        for n, (_, units) in enumerate(items):
            stream += [np.fromiter((self.codes[u] for u in units), np.int64, len(units)), np.zeros(pad, np.int64)]
            owner += [np.full(len(units), n), np.full(pad, -1)]
        self.ids, self.pad = [i for i, _ in items], pad
        self.stream, self.owner, self.weight = np.concatenate(stream), np.concatenate(owner), weight
        self.finder = WuManber(self.stream, length, block, len(self.codes) + 1)

    def encode(self, units: list[str] | str) -> np.ndarray:
        return np.fromiter(map(self.codes.get, units, repeat(0)), np.int64, len(units))

    def _shares(self, stream: np.ndarray, a: np.ndarray, b: np.ndarray, drift: int) -> np.ndarray:
        """Per seed the largest share, by weight, of a passage around it that stands at the same places of the
        stream, give or take ``drift``."""
        n, length = self.passage, self.finder.length
        reach = np.arange(length - n, n)
        out = np.zeros(len(a))
        step = max(1, (1 << 21) // len(reach))
        for lo in range(0, len(a), step):
            p, q = a[lo : lo + step, None] + reach, b[lo : lo + step, None] + reach
            item = self.stream[q]
            same = stream[p] == item
            for k in range(1, drift + 1):
                same |= (stream[p + k] == item) | (stream[p - k] == item)
            inside = self.owner[q] == self.owner[b[lo : lo + step]][:, None]
            w = self.weight[item] * inside
            w, hit, inside = (np.pad(np.cumsum(x, 1), ((0, 0), (1, 0))) for x in (w, w * same, inside))
            whole = inside[:, n:] - inside[:, :-n] == n
            out[lo : lo + step] = np.where(whole, (hit[:, n:] - hit[:, :-n]) / np.maximum(w[:, n:] - w[:, :-n], 1e-9), 0).max(1)
        return out

    def found(self, docs: list[np.ndarray]) -> dict[tuple[int, int], float]:
        """By (document, item) the largest share of a passage of the item that stands in the document."""
        gap = np.zeros(self.pad, np.int64)
        stream = np.concatenate([x for d in docs for x in (gap, d)] + [gap])
        begins = np.cumsum([0] + [self.pad + len(d) for d in docs])[:-1] + self.pad
        p, q = self.finder.search(stream)
        at = p * np.int64(len(self.stream)) + q
        before = at - len(self.stream) - 1  # ``at`` ascends, as places and the strings of a bucket do
        first = at[np.minimum(np.searchsorted(at, before), max(len(at) - 1, 0))] != before  # the first seed of each run on a diagonal
        p, q = p[first], q[first]
        near = self._shares(stream, p, q, 0) >= self.diagonal
        p, q = p[near], q[near]
        best: dict[tuple[int, int], float] = {}
        for d, n, s in zip(np.searchsorted(begins, p, "right") - 1, self.owner[q], self._shares(stream, p, q, DRIFT)):
            if s > best.get((d, n), 0.0):
                best[int(d), int(n)] = float(s)
        return best


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The units of each item: its words, or its characters if it is written without spaces."""
    for b in batches:
        units = [_units(t) for t in b["text"]]
        yield pd.DataFrame({"item_id": b["item_id"], "text": b["text"], "spaceless": [bool(c) for _, c in units], "words": [[] if c else sorted(set(w)) for w, c in units]})


def _sides(items: list[tuple[int, str]], weights: dict[str, float]) -> tuple[_Side, _Side]:
    units = [(i, *_units(t)) for i, t in items]
    words = _Side([(i, w) for i, w, c in units if not c], WORDS, DIAGONAL, weights)
    return words, _Side([(i, c) for i, _, c in units if c], CHARS, DIAGONAL, None)


def leaked_passages(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", chars_a_pass: int = CHARS_A_PASS) -> DataFrame:
    """Documents that contain a passage of an item: ``doc_id``, ``item_id``, ``share``; each pair once.

    A passage is ``WORDS`` consecutive words of ``items.text`` (in scripts without spaces ``CHARS``
    characters), of which by weight a share of ``WORDS_ALIKE`` (``CHARS_ALIKE``) stands in the document in
    the same order; a word weighs more the fewer of all items have it. Case, punctuation, markup, line breaks,
    accents and character forms are disregarded. Null and empty texts, and items shorter than a passage,
    are in no pair; other columns are ignored.

    The corpus is read once per ``chars_a_pass`` characters of items, without a shuffle; tables and items of a pass are
    built once and broadcast, so ``chars_a_pass`` bounds what is sent (an item is never parted). The result is the same
    for every ``chars_a_pass``.
    """
    spark = documents.sparkSession
    wanted = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    read = wanted.mapInPandas(_measured, "item_id long, text string, spaceless boolean, words array<string>")
    order = [F.col("item_id"), F.col("text")]
    read = cut(running_total(read.withColumn("size", F.char_length("text").cast("double")), order, "size", "before").withColumn("pass", F.floor(F.col("before") / chars_a_pass)))
    of_items = cut(read.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    n_items = read.where("NOT spaceless").count()
    kind = documents.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, share double"
    some = spread(documents.select(key, text).where(F.col(text).isNotNull()))
    found = spark.createDataFrame([], schema)
    for k in sorted(r["pass"] for r in read.select("pass").distinct().collect()):
        own = read.where(F.col("pass") == k)
        known = own.select(F.explode("words").alias("word")).distinct().join(of_items, "word").collect()
        block = [(r["item_id"], r["text"]) for r in own.select("item_id", "text").orderBy(*order).collect()]
        sides = spark.sparkContext.broadcast(_sides(block, {r["word"]: 0.1 + log((1 + n_items) / r["n"]) for r in known}))

        def search(batches: Iterator[pd.DataFrame], sides=sides) -> Iterator[pd.DataFrame]:
            words, chars = sides.value
            for b in batches:
                share = (b[text].str.len().cumsum() // 3_000_000).to_numpy()
                for _, part in b.groupby(share, sort=False):
                    units = [_units(t) for t in part[text]]
                    keys, out = part[key].tolist(), []
                    has_chars = [i for i, u in enumerate(units) if u[1]]
                    for side, ids, streams, least in (
                        (words, range(len(units)), [words.encode(u[0]) for u in units], WORDS_ALIKE),
                        (chars, has_chars, [chars.encode(units[i][1]) for i in has_chars], CHARS_ALIKE),
                    ):
                        if len(side.finder.starts) and streams:
                            out += [(keys[ids[d]], side.ids[n], s) for (d, n), s in side.found(streams).items() if s >= least]
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "share"])

        found = found.unionByName(some.mapInPandas(search, schema))
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
