"""The same or almost the same short texts in different splits (problem 2)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.textform import folded
from shelfspark.operators.sizing import lookup
from shelfspark.session import cut

#: A rare word is a slip for a word this many times as frequent, one or two slips away.
RATIO_ONE, RATIO_TWO = 5, 12
#: Slips a text may have in all; one with more is taken as it stands.
SLIPS = 2
#: Letters a word must have to be corrected for one slip and for two.
LEAST_ONE, LEAST_TWO = 4, 7
#: Letters of the longest word and of the longest run of words without spaces; longer ones stay as they are.
LONGEST, LONGEST_RUN = 64, 512
#: Words of a suffix that are compared; a longer shared span is put together from those of its later words.
DEEP = 64
#: A word that fewer texts have is a tail word: no frequency tells whether it is a slip.
TAIL = 5
#: Queries of one text that are paired in one task; more are paired chunk by chunk.
CHUNK = 2048
#: The place of words that several locales have.
EVERYWHERE = "*"

# Function words of the three languages, without accents.
FUNCTION_WORDS = {
    "us": "a an the of for with and in on to by from or at your my",
    "es": "el la los las un una unos unas de del para con y e en por a al o su mi",
    "jp": "の は が を に と で 用 用の",
}

_token = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_぀-ヿㇰ-ㇿ㐀-鿿々ー]+|[぀-ヿㇰ-ㇿ㐀-鿿々ー]+")
_thousands = re.compile(r"[1-9]\d{0,2}(?:,\d{3})+")
_number = re.compile(r"\d")
_spaceless = re.compile(r"[぀-ヿㇰ-ㇿ㐀-鿿々ー]")
_particle = re.compile(r"(?<=[^぀-ゟ])用の$|^(?:の|用の)")


def tokens(text: str) -> list[str]:
    """Words, numbers and spaceless runs of a text, without case, accents and punctuation."""
    clean = folded(text)
    if not clean.isascii():
        clean = unicodedata.normalize("NFC", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", clean)))
    clean = re.sub(r"(?<=[^\W\d_])['’`.](?=[^\W\d_])", "", clean)
    out = []
    for t in _token.findall(clean):
        if _number.match(t):
            t = t.replace(",", "") if _thousands.fullmatch(t) else t.replace(",", ".")
        out.append(t)
    return out


def stem(word: str, locale: str) -> str:
    """The word without its plural ending, in a form singular and plural share."""
    if _number.match(word) or _spaceless.search(word) or word in FUNCTION_WORDS.get(locale, "").split():
        return word
    if locale == "es":
        if len(word) > 2 and word.endswith("s") and word[-2] in "aeiou":
            word = word[:-1]
        return word[:-1] if len(word) > 3 and word.endswith("e") else word
    if len(word) > 3 and word.endswith("s") and not word.endswith("ss"):
        if word.endswith("ies") and len(word) > 4:
            return word[:-3] + "y"
        word = word[:-2] if re.search(r"(?:s|sh|ch|x|z)es$", word) else word[:-1]
    elif len(word) > 3 and re.search(r"(?:s|sh|ch|x|z)e$", word):  # "hose" as "hoses"
        word = word[:-1]
    return word[:-2] + "f" if len(word) > 4 and word[-2:] in ("ve", "fe") else word


def slips(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and adjacent swaps between two words; ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _deletes(word: str, n: int) -> set[str]:
    out = level = {word}
    for _ in range(n):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def _split(word: str, pieces: list[tuple[int, str, int]]) -> list[str] | None:
    """The word as fewest known pieces (place, piece, frequency), the more frequent ones among equals."""
    best: list[tuple[int, int, list[str]] | None] = [(0, 0, [])] + [None] * len(word)
    at: dict[int, list[tuple[str, int]]] = {}
    for i, p, n in pieces:
        at.setdefault(i, []).append((p, n))
    for i in range(len(word)):
        if best[i] is not None:
            for p, n in at.get(i, ()):
                new = (best[i][0] + 1, best[i][1] - n, best[i][2] + [p])
                j = i + len(p)
                if best[j] is None or new[:2] < best[j][:2]:
                    best[j] = new
    return best[-1][2] if best[-1] and len(best[-1][2]) > 1 else None


def _slip_reach(word: Column) -> Column:
    """Slips a word may be corrected for: by its length, spaceless words count double."""
    size = F.char_length(word) + F.when(word.rlike("[\\u3040-\\u30ff\\u4e00-\\u9fff]"), 2).otherwise(0)
    return F.when(word.rlike("[0-9]") | (F.char_length(word) > LONGEST), 0).when(size >= LEAST_TWO, 2).when(size >= LEAST_ONE, 1).otherwise(0)


def _corrections(words: DataFrame) -> DataFrame:
    """``place``, ``word``, ``parts`` (what it stands for), ``slips``: rare words that are slips for or run together from frequent ones.

    ``words``: ``place`` (a locale, or ``EVERYWHERE``), ``word``, ``n``. A word is compared with those of its place and those of all.
    """
    able = words.withColumn("reach", _slip_reach(F.col("word"))).where("reach > 0")

    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["variant"] = [sorted(_deletes(w, r)) for w, r in zip(b["word"], b["reach"])]
            yield b

    spread = able.mapInPandas(variants, "place string, word string, n long, reach int, variant array<string>").withColumn("variant", F.explode("variant"))
    beside = F.explode(F.array_distinct(F.array("place", F.lit(EVERYWHERE)))).alias("there")
    rare = spread.select("place", "variant", F.col("word").alias("x"), F.col("n").alias("nx"), beside)
    known = spread.select(F.col("place").alias("there"), "variant", F.col("word").alias("y"), F.col("n").alias("ny"))
    pairs = rare.join(known, ["there", "variant"]).where((F.col("ny") >= RATIO_ONE * F.col("nx")) & (F.col("x") != F.col("y"))).select("place", "x", "nx", "y", "ny").distinct()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["d"] = [slips(x, y, 2) for x, y in zip(b["x"], b["y"])]
            yield b[[stem(x, p) != stem(y, p) for x, y, p in zip(b["x"], b["y"], b["place"])]]

    near = pairs.mapInPandas(measure, "place string, x string, nx long, y string, ny long, d int").where((F.col("d") == 1) | (F.col("d") == 2) & (F.col("ny") >= RATIO_TWO * F.col("nx")))
    best = cut(near.groupBy("place", "x").agg(F.min(F.struct("d", (-F.col("ny")).alias("m"), "y")).alias("b")).select("place", F.col("x").alias("word"), F.array("b.y").alias("parts"), F.col("b.d").alias("slips")))

    long = words.where(~F.col("word").rlike("[0-9]") & F.char_length("word").between(4, LONGEST_RUN)).join(best.where("slips = 1").select("place", "word"), ["place", "word"], "left_anti")
    size = F.char_length("word")
    cuts = long.select("place", "word", F.col("n").alias("nx"), F.explode(F.sequence(F.lit(1), size)).alias("i")).where(F.col("word").rlike("[^a-z]") | (F.col("i") < size))
    cuts = cuts.select("place", "word", "nx", "i", F.explode(F.sequence(F.when(F.col("word").rlike("[a-z]"), 2).otherwise(1), F.least(F.lit(LONGEST), F.char_length("word") - F.col("i") + 1))).alias("len"))
    pieces = cuts.select("place", "word", "nx", "i", F.substring("word", F.col("i"), F.col("len")).alias("piece"), beside)
    found = pieces.join(words.select(F.col("place").alias("there"), F.col("word").alias("piece"), "n"), ["there", "piece"]).where((F.col("n") >= RATIO_ONE * F.col("nx")) & (F.col("piece") != F.col("word")))
    edges = found.groupBy("place", "word").agg(F.collect_list(F.struct((F.col("i") - 1).alias("i"), "piece", "n")).alias("e"))

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [_split(w, [(x["i"], x["piece"], x["n"]) for x in e]) for w, e in zip(b["word"], b["e"])]
            out = pd.DataFrame({"place": b["place"], "word": b["word"], "parts": parts, "slips": 0})
            yield out[out["parts"].notna()]

    divided = edges.mapInPandas(divide, "place string, word string, parts array<string>, slips int")
    return best.unionByName(divided).groupBy("place", "word").agg(F.min_by("parts", "slips").alias("parts"), F.min("slips").alias("slips"))


def canonical(texts: DataFrame) -> DataFrame:
    """``text_id``, ``locale`` and ``words`` of each text: its stems in order, without function words, corrected.

    A text of which more than ``SLIPS`` were corrected keeps its words as they are, as rare but right names may be
    near frequent words. A text without words isn't in the result.

    ``texts``: ``text_id`` unique, ``locale``, ``text``. Frequencies are counted over all texts given; a
    word that several locales have (a name) counts in all of them together.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text_id": b["text_id"], "locale": b["locale"], "word": [tokens(t) for t in b["text"]]})

    kind = dict(texts.dtypes)["text_id"]
    read_ = texts.select("text_id", "locale", "text").mapInPandas(read, f"text_id {kind}, locale string, word array<string>")
    each = cut(read_.select("text_id", "locale", F.posexplode("word").alias("at", "word")))
    counts = cut(each.groupBy("locale", "word").agg(F.countDistinct("text_id").alias("n")))
    words = cut(counts.groupBy("word").agg(F.sum("n").alias("n"), F.when(F.count(F.lit(1)) == 1, F.first("locale")).otherwise(F.lit(EVERYWHERE)).alias("place")))
    fixed = _corrections(words.select("place", "word", "n"))
    everywhere = fixed.where(F.col("place") == EVERYWHERE).drop("place").join(counts.select("locale", "word"), "word")
    fixed = cut(fixed.where(F.col("place") != EVERYWHERE).withColumnRenamed("place", "locale").unionByName(everywhere))
    joined = lookup(each, fixed, ["locale", "word"], "left").withColumn("parts", F.coalesce("parts", F.array("word")))
    joined = joined.withColumn("asis", F.when(F.coalesce("slips", F.lit(0)) > 0, F.array("word")).otherwise(F.col("parts")))
    gathered = joined.groupBy("text_id", "locale").agg(F.array_sort(F.collect_list(F.struct("at", "parts", "asis"))).alias("x"), F.sum(F.coalesce("slips", F.lit(0))).alias("slips"))
    parts = F.flatten(F.when(F.col("slips") <= SLIPS, F.transform("x", lambda x: x["parts"])).otherwise(F.transform("x", lambda x: x["asis"])))
    whole = gathered.select("text_id", "locale", parts.alias("parts"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for loc, parts in zip(b["locale"], b["parts"]):
                drop = set(FUNCTION_WORDS.get(loc, "").split())
                kept = [p for p in parts if p not in drop] or list(parts)
                out.append([stem(_particle.sub("", p) or p, loc) for p in kept])
            yield pd.DataFrame({"text_id": b["text_id"], "locale": b["locale"], "words": out})

    return whole.mapInPandas(finish, f"text_id {kind}, locale string, words array<string>").where(F.size("words") > 0)


def _id(*parts: Column | str) -> Column:
    """A 128-bit name of the parts."""
    return F.unhex(F.md5(F.concat_ws("\x02", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("\x03")) for p in parts])))


def _string(words: Column) -> Column:
    """The words as one sortable string: each ends with a sign below all letters; of more than ``DEEP`` words the rest is hashed."""
    most = F.array_join(F.transform(F.slice(words, 1, DEEP), lambda w: F.concat(w, F.lit("\x01"))), "")
    return F.when(F.size(words) <= DEEP, most).otherwise(F.concat(most, F.lit("\x02"), F.md5(F.array_join(F.slice(words, DEEP + 1, 1 << 30), "\x01"))))


def _common(a: str, b: str) -> int:
    """Words two strings have in common at their beginning."""
    n = 0
    for x, y in zip(a.split("\x02")[0].split("\x01")[:-1], b.split("\x02")[0].split("\x01")[:-1]):
        if x != y:
            break
        n += 1
    return n


_ROW = "place string, key string, tie string, kind string, rec binary, side string, start int, word string"
_FOUND = "kind string, rec binary, other binary, start int, length int"


def _scan(before: dict, behind: dict):
    """Reads a range of the sorted suffixes once: the longest common prefix of each with the other side, and whole strings that are equal.

    ``before`` and ``behind``: by partition and place, the nearest suffix of either side in the ranges around.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts or not sum(map(len, parts)):
            return
        rows = pd.concat(parts, ignore_index=True)
        out: list[tuple] = []
        part = int(rows["part"].iloc[0])
        for place, group in rows.groupby("place", sort=False):
            of = group[group["kind"] == "text"]
            keys, sides = of["key"].tolist(), of["side"].tolist()
            best = [0] * len(keys)
            for order, edge in ((range(len(keys)), before), (range(len(keys) - 1, -1, -1), behind)):
                last = {s: edge.get((part, place, s)) for s in ("train", "held")}
                reach: dict[str, int] = {}
                previous = None
                for i in order:
                    if previous is not None:
                        step = _common(previous, keys[i])
                        reach = {s: min(n, step) for s, n in reach.items()}
                    for s, k in last.items():
                        if k is not None:  # the first row of the range: compared with the ranges around
                            reach[s] = _common(k, keys[i])
                    last = {}
                    best[i] = max(best[i], reach.get("held" if sides[i] == "train" else "train", 0))
                    reach[sides[i]] = DEEP
                    previous = keys[i]
            out += [("span", r, None, s, n) for r, s, n in zip(of["rec"], of["start"], best) if n]
            whole = group[group["kind"] != "text"]
            keys, end = whole["key"].tolist(), 0
            while end < len(keys):
                at, end = end, end + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if end - at > 1:
                    same = whole.iloc[at:end]
                    held = same[same["side"] == "held"]
                    train = same[same["side"] == "train"]
                    for h, x in zip(held["rec"], held["word"]):
                        for t, y in zip(train["rec"], train["word"]):
                            if x is None or x != y and slips(x, y, 2) <= 2:
                                out.append(("pair", h, t, 0, 0))
        yield pd.DataFrame(out, columns=["kind", "rec", "other", "start", "length"])

    return run


def suffix_array(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Spans and pairs out of the sorted suffixes: ``kind``, ``rec``, ``other``, ``start``, ``length``.

    ``rows`` (``_ROW``): suffixes of the concatenated texts. They are sorted by range, so that equal suffixes of many
    texts stand in several tasks; each range is read once beside its neighbours' border rows, which are two a
    range and place. A ``span`` says how many words from ``start`` on the text ``rec`` has in common with its neighbour of the
    other side; a ``pair`` is two neighbours of either side that agree over both whole strings (``rec`` held, ``other`` train).
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, "place", "key", "tie").sortWithinPartitions("place", "key", "tie").withColumn("part", F.spark_partition_id()))
    borders = ranged.where("kind = 'text'").groupBy("part", "place", "side").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    before, behind = {}, {}
    for of, edge, ahead in ((before, "hi", False), (behind, "lo", True)):
        last: dict[tuple[str, str], str] = {}
        ranges = sorted({(b["part"], b["place"]) for b in borders}, reverse=ahead)
        keys = {(b["part"], b["place"], b["side"]): b[edge] for b in borders}
        for part, place in ranges:
            for side in ("train", "held"):
                if (place, side) in last:
                    of[part, place, side] = last[place, side]
            for side in ("train", "held"):
                if (part, place, side) in keys:
                    last[place, side] = keys[part, place, side]
    return ranged.mapInPandas(_scan(before, behind), _FOUND)


def _text_rows(records: DataFrame) -> DataFrame:
    """All suffixes of the texts in their own word order."""
    each = records.select("locale", "rec", "side", F.col("words").alias("w"), F.posexplode("words").alias("start", "_"))
    key = _string(F.slice("w", F.col("start") + 1, 1 << 30))
    return each.select(F.col("locale").alias("place"), key.alias("key"), F.hex("rec").alias("tie"), F.lit("text").alias("kind"), "rec", "side", "start", F.lit(None).cast("string").alias("word"))


def _bag_rows(bags: DataFrame) -> DataFrame:
    """The texts in canonical word order, whole."""
    return bags.select(
        F.concat(F.col("locale"), F.lit("\x01")).alias("place"), _string(F.col("bag")).alias("key"), F.lit("").alias("tie"), F.lit("bag").alias("kind"), "rec", "side", F.lit(0).alias("start"), F.lit(None).cast("string").alias("word")
    )


def _gap_rows(bags: DataFrame) -> DataFrame:
    """The texts in canonical word order with one tail word left out, under each form of the word with up to two letters less."""
    words = bags.select("locale", F.explode(F.array_distinct("bag")).alias("word")).groupBy("locale", "word").agg(F.count(F.lit(1)).alias("n"))
    tail = cut(words.where((F.col("n") < TAIL) & (_slip_reach(F.col("word")) > 0)).select("locale", "word", _slip_reach(F.col("word")).alias("reach")))
    each = bags.where(F.size("bag") > 2).select("locale", "rec", "side", "bag", F.posexplode("bag").alias("at", "word"))
    rest = F.filter(F.col("bag"), lambda w, i: i != F.col("at"))
    gaps = lookup(each, tail, ["locale", "word"]).select("locale", "rec", "side", "word", "reach", _string(rest).alias("key"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["form"] = [sorted(_deletes(w, r)) for w, r in zip(b["word"], b["reach"])]
            yield b.explode("form", ignore_index=True).drop(columns="reach")

    formed = gaps.mapInPandas(spread, "locale string, rec binary, side string, word string, key string, form string")
    return formed.select(
        F.concat(F.col("locale"), F.lit("\x02")).alias("place"), F.concat("key", F.lit("\x03"), "form").alias("key"), F.lit("").alias("tie"), F.lit("gap").alias("kind"), "rec", "side", F.lit(0).alias("start"), "word"
    )


def coverage(records: DataFrame, spans: DataFrame) -> DataFrame:
    """``rec``, ``side`` and ``covered``: the share of the record's words that lie in shared spans, overlapping spans merged."""
    own = Window.partitionBy("rec").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = spans.groupBy("rec", "start").agg(F.max(F.col("start") + F.col("length")).alias("end")).withColumn("done", F.greatest(F.coalesce(F.max("end").over(own), F.lit(0)), F.col("start")))
    merged = ends.groupBy("rec").agg(F.sum(F.greatest(F.col("end") - F.col("done"), F.lit(0))).alias("n"))
    return records.select("rec", "side", F.size("words").alias("size")).join(merged, "rec", "left").select("rec", "side", F.coalesce(F.col("n") / F.col("size"), F.lit(0.0)).alias("covered"))


class Overlap:
    """What splits share of a table of queries; made by ``split_overlap``.

    ``asked``: every query's texts (``query_id``, ``text_id``, ``split``, ``source``, ``side``); ``placed``: the records a text with
    words stands for (``text_id``, ``side``, ``rec``, ``bag``); ``covered``: ``rec``, ``covered``; ``pairs``: ``held`` and ``train``, bags
    that ask for the same thing.
    """

    def __init__(self, asked: DataFrame, placed: DataFrame, covered: DataFrame, pairs: DataFrame):
        self.asked, self.placed, self.covered, self.pairs = asked, placed, covered, pairs
        self.members = cut(asked.join(placed, ["text_id", "side"]).select("bag", "side", "query_id").distinct())

    def query_pairs(self, chunk: int = CHUNK) -> DataFrame:
        """``query_id_held``, ``query_id_train``: the pairs between queries. A text that very many queries have is paired chunk by chunk."""
        sizes = self.members.groupBy("bag", "side").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
        large = cut(sizes.where("parts > 1"))
        some = large.limit(1).count() > 0

        def of(side: str) -> DataFrame:
            rows = self.members.where(F.col("side") == side).select(F.col("bag").alias(side), F.col("query_id").alias(f"query_id_{side}"))
            if not some:
                return rows.withColumn(f"{side}_part", F.lit(0))
            rows = lookup(rows, large.where(F.col("side") == side).select(F.col("bag").alias(side), "parts"), [side], "left")
            return rows.withColumn(f"{side}_part", F.pmod(F.xxhash64(f"query_id_{side}"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

        wide = self.pairs
        for side in ("held", "train"):
            if some:
                wide = lookup(wide, large.where(F.col("side") == side).select(F.col("bag").alias(side), "parts"), [side], "left")
                wide = wide.withColumn(f"{side}_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
            else:
                wide = wide.withColumn(f"{side}_part", F.lit(0))
        met = wide.join(of("held"), ["held", "held_part"]).join(of("train"), ["train", "train_part"])
        return met.select("query_id_held", "query_id_train").distinct()

    def classes(self) -> DataFrame:
        """``query_id``, ``class_id`` (one for equal texts in canonical form) and ``n_links``: queries of the other side that ask for the same."""
        n = self.members.groupBy("bag", "side").agg(F.count(F.lit(1)).alias("n"))
        there = {s: n.where(F.col("side") == s).select(F.col("bag").alias(s), "n") for s in ("held", "train")}
        links = [self.pairs.join(there[other], other).groupBy(mine).agg(F.sum("n").alias("n_links")).select(F.col(mine).alias("bag"), F.lit(mine).alias("side"), "n_links") for mine, other in (("held", "train"), ("train", "held"))]
        linked = cut(links[0].unionByName(links[1]))
        return lookup(self.members, linked, ["bag", "side"], "left").select("query_id", F.lower(F.hex("bag")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def per_query(self) -> DataFrame:
        """Every query with ``split``, ``source``, ``covered`` (largest share of a text of it that the other side has) and ``whole`` (it is in a pair)."""
        paired = self.pairs.select(F.col("held").alias("bag"), F.lit("held").alias("side")).union(self.pairs.select(F.col("train").alias("bag"), F.lit("train").alias("side"))).distinct()
        of_text = self.placed.join(self.covered, ["rec", "side"], "left").join(paired.withColumn("whole", F.lit(True)), ["bag", "side"], "left")
        known = lookup(self.asked, cut(of_text.select("text_id", "side", "covered", F.coalesce("whole", F.lit(False)).alias("whole"))), ["text_id", "side"], "left")
        return known.groupBy("query_id", "split", "source").agg(F.coalesce(F.max("covered"), F.lit(0.0)).alias("covered"), F.coalesce(F.max("whole"), F.lit(False)).alias("whole"))

    def exact_copies(self) -> DataFrame:
        """The pairs of queries that have a text letter for letter alike; those are among ``query_pairs`` if the text has a word."""
        same = self.pairs.where("held = train").select(F.col("held").alias("bag"))
        texts = lookup(self.asked.join(self.placed.select("text_id", "side", "bag"), ["text_id", "side"]), cut(same), ["bag"], "left_semi")
        held, train = (texts.where(F.col("side") == s).select("text_id", F.col("query_id").alias(f"query_id_{s}")).distinct() for s in ("held", "train"))
        return held.join(train, "text_id").select("query_id_held", "query_id_train").distinct()


def split_overlap(rows: DataFrame, train: str = "train") -> Overlap:
    """Texts that splits share. ``rows``: ``query_id``, ``query``, ``locale``, ``split``, ``source``.

    Texts in canonical form are laid end to end and their suffixes sorted; neighbours of ``train`` and another split with
    a long common prefix show shared spans, which are merged into the share of each record that the other side has.
    A pair are two texts that are covered from end to end, in canonical word order, but for one tail word a slip or two
    apart. Null and empty texts and those without words share nothing but count as queries, repeated rows count once, a
    query with several texts has those of all of them; a null split is not ``train``.
    """
    side = F.when(F.col("split") == train, "train").otherwise("held")
    some = rows.where(F.col("query_id").isNotNull()).select("query_id", "query", F.coalesce("locale", F.lit("")).alias("locale"), "split", "source", side.alias("side")).distinct()
    asked = cut(some.withColumn("text_id", _id("locale", "query")))
    texts = asked.where(F.col("query").isNotNull()).groupBy("text_id").agg(F.first("locale").alias("locale"), F.first("query").alias("text"), F.collect_set("side").alias("sides"))
    known = canonical(cut(texts)).withColumn("bag", F.array_sort("words"))
    sided = cut(known.join(texts.select("text_id", F.explode("sides").alias("side")), "text_id").select("text_id", "side", "locale", "words", "bag", _id("locale", "side", F.array_join("words", "\x01")).alias("rec"), _id("locale", F.array_join("bag", "\x01")).alias("bag_id")))
    records = cut(sided.groupBy("rec", "side").agg(F.first("locale").alias("locale"), F.first("words").alias("words")))
    bags = cut(sided.groupBy(F.col("bag_id").alias("rec"), "side").agg(F.first("locale").alias("locale"), F.first("bag").alias("bag")))
    found = cut(suffix_array(_text_rows(records).unionByName(_bag_rows(bags)).unionByName(_gap_rows(bags))))
    covered = coverage(records, found.where("kind = 'span'").select("rec", "start", "length"))
    pairs = cut(found.where("kind = 'pair'").select(F.col("rec").alias("held"), F.col("other").alias("train")).distinct())
    placed = cut(sided.select("text_id", "side", "rec", F.col("bag_id").alias("bag")))
    return Overlap(asked.select("query_id", "text_id", "split", "source", "side"), placed, covered, pairs)
