"""Listings of one product brought together (problem 6): token blocks, a weighted graph, pruning, rules, clusters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.brands import _compact, map_names, name_cores
from shelfspark.llm.pairs import CHUNK, _chunked, _ordinary
from shelfspark.llm.textform import folded
from shelfspark.operators.graph import components
from shelfspark.operators.sizing import lookup
from shelfspark.operators.units import UNITS, quantities
from shelfspark.session import cut

#: Sizes this close are one size, rounded or converted differently.
SIZE_ALIKE = 0.02
#: Rare tokens of a listing that are paired to blocks, and how many times as large as its smallest block such a block may be.
RARE_TOKENS, SPREAD = 4, 4
#: Least share of the listings of a series word and number that one brand has, where a rarer one mostly stands beside it; those of "new 2024" have all brands.
ONE_BRAND = 0.1
#: Share of their blocks two listings must have in common if not both name a model number.
WITHOUT_MODEL = 0.6
#: Edges of a component that one task joins; a larger component is joined in rounds.
LARGE = 1_000_000

# How packs are written, and words typed for a brand where there is none.
PACK = r"pack of (\d+)|(\d+)[ -]?pack\b|paquete de (\d+)|pack de (\d+)|(\d+)個(?:セット|入り?|パック)"
NO_BRAND = "na none no nobrand unbranded generic genérico generico various varios unknown desconocido sinmarca seedescription verdescripción verdescripcion ノーブランド ノーブランド品 その他 なし 不明 other otros"

_pack = re.compile(PACK)
_no_brand = {_compact(w) for w in NO_BRAND.split()}
_model = re.compile(r"([^\W\d_]{3,})[ -]?(\d{3,})(?![\d.,]*\d)")
_word = re.compile(r"[^\W\d_]+")
_number = re.compile(r"(?<![\d.,])\d{3,}(?![\d.,]*\d)")
_latin = re.compile(r"[a-zà-ɏ]+")
_dims = re.compile(r"\d\s*[\"a-z]*\s*[x×*]\s*\d")
_side_before = re.compile(r"[x×*]\s*[a-z]?$")
_side_behind = re.compile(r"\s*[^\d\s]*\s*[x×*]\s*[a-z]?\d")
_sizes = {q: [float(s) for s in sizes] for q, sizes in UNITS.items()}
_letters = re.compile("[^\\W\\d_]")


def _features(b: pd.DataFrame) -> pd.DataFrame:
    """What a batch of listings says about its products."""
    out: dict[str, list] = {c: [] for c in ("models", "tokens", "size_of", "size", "bare", "pack", "colour", "words", "grams")}
    for title, locale, colour, measures, pack in zip(b["title"], b["locale"], b["color"], b["attr_measures"], b["attr_pack_count"]):
        t, comma = folded(title or ""), locale == "es"
        sizes = quantities(t, comma)
        starts = {a for _, q, _, a, _ in sizes if q}
        models = {f"{m[1]} {m[2]}" for m in _model.finditer(t) if m.start(2) not in starts}
        own = next(((q, float(v * s)) for v, q, s, a, _ in sizes if q and "x" not in t[max(0, a - 2) : a]), None)
        if own and _dims.search(t):  # the numbers of a dimension are not the size
            flat = [(q, float(v * s)) for v, q, s, a, e in sizes if q and not _side_before.search(t[max(0, a - 4) : a]) and not _side_behind.match(t[e : e + 14])]
            own = flat[0] if flat else None
        bare = None
        for entry in measures if own is None and measures is not None else []:
            read = quantities(entry or "", comma)
            known = [(q, float(v * s)) for v, q, s, *_ in read if q]
            if known:
                own = (known[0][0], sum(x for q, x in known if q == known[0][0]))
                break
            if len(read) == 1 and bare is None and "/" not in entry and not _letters.search(entry):
                bare = float(read[0][0])
                break
        found = _pack.search(t)
        words = _word.findall(t)
        names = [w for w in words if _latin.fullmatch(w)]
        out["models"].append(sorted(models))
        out["tokens"].append(sorted({w for w in words if len(w) > 1} | {m[0] for m in _number.finditer(t) if m.start() not in starts}))
        out["size_of"].append(own[0] if own else None)
        out["size"].append(own[1] if own else None)
        out["bare"].append(bare if own is None else None)
        out["pack"].append(int(pack) if pd.notna(pack) and pack else int(next(g for g in found.groups() if g)) if found else 1)
        out["colour"].append(folded(colour).strip() or None if colour else None)
        out["words"].append(sorted(set(words) | {f"{x} {y}" for x, y in zip(words, words[1:])}))
        out["grams"].append(sorted({_compact(w) for w in names} | {_compact(x + y) for x, y in zip(names, names[1:])}))
    return pd.DataFrame(out, index=b.index)


_FEATURES = "doc_id string, locale string, brand string, attr_colour string, material string, audience string, category string, models array<string>, tokens array<string>, size_of string, size double, bare double, pack int, colour string, words array<string>, grams array<string>"
_FACTS = ["brand_key", "colour", "size_of", "size", "bare", "pack", "material", "audience", "category"]
_EQUAL = ["brand_key", "colour", "category"]


def _facts(catalog: DataFrame, brands: DataFrame) -> DataFrame:
    """``doc_id``, ``locale``, ``models``, ``tokens`` and the facts of each listing, brands and colours in one spelling."""
    first = lambda c: F.get(F.col(c), 0)
    rows = catalog.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.coalesce("locale", F.lit("")).alias("locale"), "brand", "title", "color", "attr_measures", "attr_pack_count", first("attr_colors").alias("attr_colour"), first("attr_materials").alias("material"), first("attr_audience").alias("audience"), "category"
    )
    kept = ["doc_id", "locale", "brand", "attr_colour", "material", "audience", "category"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[kept], _features(b)], axis=1)

    parsed = cut(rows.dropDuplicates(["doc_id"]).mapInPandas(read, _FEATURES))

    # brands: of the title, else of the column
    typed = parsed.select("brand").where(F.col("brand").isNotNull()).groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    listed = map_names(typed.select(F.col("brand").alias("value")), brands).select(F.col("value").alias("brand"), "brand_id")

    def cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spelt = [name_cores(v) for v in b["brand"]]
            yield pd.DataFrame({"brand": b["brand"], "n": b["n"], "brand_id": b["brand_id"], "core": [None if not s or any(c in _no_brand for c in s) else s[0] for s in spelt]})

    cored = cut(typed.join(listed, "brand").mapInPandas(cores, "brand string, n long, brand_id long, core string"))
    key = F.when(F.col("brand_id") >= 0, F.concat(F.lit("#"), F.col("brand_id"))).otherwise(F.col("core"))
    of_column = cored.select("brand", key.alias("column_key"), F.col("core").alias("column_form")).where(F.col("column_key").isNotNull())
    reference = brands.select("brand_id", F.explode(F.array("brand_name", "brand_kana")).alias("v")).where(F.col("v").isNotNull())
    forms = reference.mapInPandas(lambda bs: (pd.DataFrame({"form": b["v"].map(lambda v: _compact(folded(v))), "key": "#" + b["brand_id"].astype(str)}) for b in bs), "form string, key string")
    typed_forms = cored.where("brand_id < 0 AND core IS NOT NULL").groupBy("core").agg(F.sum("n").alias("n")).where("n > 2")
    forms = cut(forms.unionByName(typed_forms.select(F.col("core").alias("form"), F.col("core").alias("key"))).groupBy("form").agg(F.min("key").alias("key")))
    in_title = lookup(parsed.select("doc_id", F.explode("grams").alias("form")), forms, ["form"]).groupBy("doc_id").agg(F.max(F.struct(F.length("form"), "key", "form")).alias("t")).select("doc_id", F.col("t.key").alias("title_key"), F.col("t.form").alias("title_form"))

    # colours in the words of the attribute column, learned from listings that have both
    both = parsed.where(F.col("attr_colour").isNotNull() & F.col("colour").isNotNull()).groupBy("locale", "colour", "attr_colour").agg(F.count(F.lit(1)).alias("n"))
    names = cut(both.groupBy("locale", "colour").agg(F.max_by("attr_colour", F.struct("n", "attr_colour")).alias("known"), F.sum("n").alias("n")).where("n > 1").drop("n"))
    from_title = lookup(parsed.where(F.col("attr_colour").isNull() & F.col("colour").isNull()).select("doc_id", "locale", F.explode("words").alias("colour")), names, ["locale", "colour"])
    from_title = from_title.groupBy("doc_id").agg(F.max_by("known", F.struct(F.length("colour"), "known")).alias("title_colour"))

    facts = lookup(parsed.drop("words", "grams"), cut(of_column), ["brand"], "left")
    facts = lookup(facts, names, ["locale", "colour"], "left").join(in_title, "doc_id", "left").join(from_title, "doc_id", "left")
    named = F.concat(F.coalesce("title_form", F.lit("")), F.lit(" "), F.coalesce("column_form", F.lit("")))
    facts = facts.withColumn("brand_key", F.coalesce("title_key", "column_key")).withColumn("colour", F.coalesce("attr_colour", "known", "title_colour"))
    tokens = F.concat(F.filter(F.col("tokens"), lambda w: ~F.contains(named, w)), F.when(F.col("brand_key").isNotNull(), F.array(F.concat(F.lit("@"), "brand_key"))).otherwise(F.array().cast("array<string>")))
    return cut(facts.select("doc_id", "locale", "models", tokens.alias("tokens"), *_FACTS))


def _strange(facts: DataFrame, counts: DataFrame) -> DataFrame:
    """``locale``, ``model``, ``token`` of words and numbers that are no models, as "new 2024".

    In most of their listings stands a rarer one that other listings name as well, and no brand has ``ONE_BRAND`` of
    them. Brands alone don't tell: the more listings there are, the more brands use the same series word and number.
    """
    several = facts.where(F.size("models") > 1).select("doc_id", "locale", F.explode("models").alias("token"))
    several = lookup(several, counts.where("model").drop("model"), ["locale", "token"], count="n")
    beside = several.groupBy("doc_id", "locale").agg(F.collect_list(F.struct("token", "n")).alias("t"))
    beside = beside.select("locale", F.explode(F.transform("t", lambda m: F.struct(m["token"].alias("token"), m["n"].alias("n"), F.exists("t", lambda o: (o["n"] > 1) & (o["n"] < m["n"])).alias("rarer")))).alias("m")).select("locale", "m.*")
    common = cut(beside.where("rarer").groupBy("locale", "token", "n").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > F.col("n") / 2).select("locale", "token"))
    named = facts.where("brand_key IS NOT NULL").select("locale", "brand_key", F.explode("models").alias("token"))
    branded = lookup(named, common, ["locale", "token"], "left_semi").groupBy("locale", "token", "brand_key").agg(F.count(F.lit(1)).alias("k"))
    shares = branded.groupBy("locale", "token").agg((F.max("k") / F.sum("k")).alias("share"))
    return cut(shares.where(F.col("share") < ONE_BRAND).select("locale", F.lit(True).alias("model"), "token"))


def _nodes(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the listing graph and the node of each listing. Listings that say the same are one node, however many they are.

    A node's ``blocks`` are its model numbers, with the series word or with the brand, and pairs of its ``RARE_TOKENS``
    rarest tokens that are not far larger than its smallest block; blocks of one listing are left out. ``main`` is its rarest model. What
    ``_strange`` finds is no model.
    """
    named = F.concat(F.transform("models", lambda m: F.struct(F.lit(True).alias("model"), m.alias("token"))), F.transform("tokens", lambda t: F.struct(F.lit(False).alias("model"), t.alias("token"))))
    each = facts.select("doc_id", "locale", F.explode(named).alias("t")).select("doc_id", "locale", "t.*")
    counts = cut(each.groupBy("locale", "model", "token").agg(F.count(F.lit(1)).alias("n")).where("model OR n > 1"))
    counts = cut(lookup(counts, _strange(facts, counts), ["locale", "model", "token"], "left_anti"))
    seen = lookup(each, counts, ["locale", "model", "token"], count="n").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "model", "token"))).alias("t"))
    models = F.transform(F.filter("t", lambda x: x["model"]), lambda x: x["token"])
    rare = F.array_sort(F.transform(F.slice(F.filter("t", lambda x: ~x["model"]), 1, RARE_TOKENS), lambda x: x["token"]))
    known = facts.drop("tokens", "models").join(seen.select("doc_id", models.alias("models"), rare.alias("rare")), "doc_id")

    def block(kind: int, *parts: Column) -> Column:
        return F.struct(F.lit(kind < 2).alias("model"), F.xxhash64(F.lit(kind), "locale", "pack", *parts).alias("block"))

    pairs = F.flatten(F.transform("rare", lambda x, i: F.transform(F.slice("rare", i + 2, RARE_TOKENS), lambda y: block(2, x, y))))
    numbers = F.transform(F.filter("models", lambda m: F.col("brand_key").isNotNull()), lambda m: block(0, F.col("brand_key"), F.substring_index(m, " ", -1)))
    known = cut(known.withColumn("blocks", F.array_distinct(F.concat(F.transform("models", lambda m: block(1, m)), numbers, pairs))).drop("rare"))
    each = known.select("doc_id", F.inline("blocks"))
    counts = cut(each.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    ranked = lookup(each, counts, ["block"], count="n").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "block", "model"))).alias("b"))
    kept = ranked.select("doc_id", F.filter("b", lambda x: x["model"] | (x["n"] <= SPREAD * F.col("b")[0]["n"])).alias("blocks"))
    whole = known.drop("blocks").join(kept, "doc_id").withColumn("main", F.get("models", F.lit(0)))
    sign = F.md5(F.to_json(F.struct("locale", "models", "blocks", *_FACTS)))
    whole = cut(whole.withColumn("node", F.unhex(sign)))
    nodes = whole.groupBy("node").agg(*[F.first(c).alias(c) for c in ("main", "models", "blocks", *_FACTS)])
    return cut(nodes), whole.select("doc_id", "node")


def _graph(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``a``, ``b``, ``w``: nodes that share blocks, weighted by the rarity of the blocks, without the edges that are weak at both ends.

    An edge stays if it weighs at least the mean of the edges of one of its nodes, or if it stands for a common model number. Other packs
    are never one product, so a block holds one size of pack. Blocks of more than ``chunk`` nodes are
    cut into chunks that meet in tasks of their own.
    """
    total = nodes.count() or 1
    member = nodes.select(F.col("node").alias("item"), F.inline("blocks")).select(F.col("block").alias("basket"), "item", F.greatest(F.log(F.lit(float(total) + 1) / F.col("n")), F.lit(0.1)).cast("float").alias("rarity"), "model")
    member = cut(member)
    sizes = cut(member.groupBy("basket").agg(F.count(F.lit(1)).alias("n"), F.max("rarity").alias("rarity"), F.max("model").alias("model")).where("n > 1"))
    large = cut(sizes.where(F.col("n") > chunk))
    some = lookup(member.select("basket", "item"), sizes.where(F.col("n") <= chunk), ["basket"])
    met = some.join(some.select("basket", F.col("item").alias("b")), "basket").where(F.col("item") < F.col("b")).select(F.col("item").alias("a"), "b", "rarity", "model")
    if large.limit(1).count():
        far = _chunked(lookup(member.select("basket", "item"), large.select("basket"), ["basket"], "left_semi"), large.select("basket", "n"), chunk, keep_basket=True)
        met = met.unionByName(lookup(far, large.select("basket", "rarity", "model"), ["basket"]).select("a", "b", "rarity", "model"))
    edges = cut(met.groupBy("a", "b").agg(F.sum("rarity").alias("w"), F.max("model").alias("model")))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.avg("w").alias("mean"))
    ends = cut(ends)
    seen = lookup(lookup(edges, ends.select(F.col("node").alias("a"), F.col("mean").alias("mean_a")), ["a"]), ends.select(F.col("node").alias("b"), F.col("mean").alias("mean_b")), ["b"])
    return seen.where(F.col("model") | (F.col("w") >= F.least("mean_a", "mean_b") - 1e-9)).select("a", "b", "w")


def _same_or_unknown(c: str) -> Column:
    return F.coalesce(F.col(f"x.{c}") == F.col(f"y.{c}"), F.lit(True))


def _bare_fits(x: str, y: str) -> Column:
    """Whether the number without unit of one side is the size of the other in some unit."""
    fits = F.lit(False)
    for q, units in UNITS.items():
        near = reduce(lambda p, r: p | r, [F.abs(F.col(f"{x}.bare_lo") * float(u) - F.col(f"{y}.size_lo")) <= SIZE_ALIKE * F.col(f"{y}.size_lo") for u in units])
        fits = fits | ((F.col(f"{y}.size_of") == q) & near)
    return F.when(F.col(f"{x}.bare_lo").isNotNull() & F.col(f"{y}.size_of").isNotNull(), F.coalesce(fits, F.lit(False))).otherwise(F.lit(True))


def _compatible() -> Column:
    """Whether no fact tells the clusters ``x`` and ``y`` apart."""
    lo, hi = F.least("x.size_lo", "y.size_lo"), F.greatest("x.size_hi", "y.size_hi")
    sizes = (F.col("x.size_of") != F.col("y.size_of")) | (hi - lo <= SIZE_ALIKE * hi)
    ok = (F.col("x.pack") == F.col("y.pack")) & F.coalesce(sizes, F.lit(True)) & _bare_fits("x", "y") & _bare_fits("y", "x")
    return reduce(lambda p, c: p & _same_or_unknown(c), _EQUAL, ok)


def _agreement() -> Column:
    """Weight of the facts two nodes share."""
    both = lambda c: F.coalesce(F.col(f"x.{c}") == F.col(f"y.{c}"), F.lit(False))
    weight = reduce(lambda p, c: p + F.when(both(c), 2.0).otherwise(0.0), [*_EQUAL, "size_of"], F.lit(0.0))
    for x, y in (("x", "y"), ("y", "x")):
        weight = weight + F.when(F.col(f"{x}.bare_lo").isNotNull() & F.col(f"{y}.size_of").isNotNull(), 1.5).otherwise(0.0)
    weight = weight + F.when(both("bare_lo"), 1.5).otherwise(0.0)
    for c in ("material", "audience"):
        weight = weight + F.coalesce(F.when(F.col(f"x.{c}") == F.col(f"y.{c}"), 1.0).otherwise(F.when(F.col(f"x.{c}").isNotNull() & F.col(f"y.{c}").isNotNull(), -1.0)), F.lit(0.0))
    return weight


def _same_model() -> Column:
    """A model number of either is the other's, or is misspelt by a slip; without one, most of the blocks are common."""
    xm, ym = F.col("x.main"), F.col("y.main")
    word, number = (lambda m: F.substring_index(m, " ", 1)), (lambda m: F.substring_index(m, " ", -1))
    near = lambda m, n: (number(m) == number(n)) & F.levenshtein(word(m), word(n), 2).between(0, 2) & (F.least(F.length(word(m)), F.length(word(n))) >= 5)
    slip = F.exists("x.models", lambda m: F.exists("y.models", lambda n: near(m, n)))
    known = F.array_contains("x.models", ym) | F.array_contains("y.models", xm) | slip
    blocks = lambda s: F.transform(F.col(f"{s}.blocks"), lambda b: b["block"])
    common = F.size(F.array_intersect(blocks("x"), blocks("y"))) >= WITHOUT_MODEL * F.greatest(F.size(blocks("x")), F.size(blocks("y")))
    return F.when(xm.isNotNull() & ym.isNotNull(), F.coalesce(known, F.lit(False))).otherwise(F.coalesce(common & (F.col("x.brand_key") == F.col("y.brand_key")), F.lit(False)))


class _Cluster:
    """What a group of nodes is known to be, as ``_compatible`` has it in columns."""

    __slots__ = ("equal", "pack", "size_of", "lo", "hi", "bare")

    def __init__(self, equal, pack, size_of, size, bare):
        self.equal, self.pack, self.size_of, self.lo, self.hi, self.bare = equal, pack, size_of, size, size, bare

    def _bare_fits(self, other: "_Cluster") -> bool:
        return self.bare is None or other.size_of is None or any(abs(self.bare * u - other.lo) <= SIZE_ALIKE * other.lo for u in _sizes[other.size_of])

    def fits(self, other: "_Cluster") -> bool:
        if self.pack != other.pack or any(x is not None and y is not None and x != y for x, y in zip(self.equal, other.equal)):
            return False
        if self.size_of is not None and self.size_of == other.size_of:
            hi = max(self.hi, other.hi)
            if hi - min(self.lo, other.lo) > SIZE_ALIKE * hi:
                return False
        return self._bare_fits(other) and other._bare_fits(self)

    def take(self, other: "_Cluster") -> None:
        most = lambda x, y: y if x is None else x if y is None else max(x, y)
        self.equal = [most(x, y) for x, y in zip(self.equal, other.equal)]
        self.size_of = most(self.size_of, other.size_of)
        self.lo, self.hi = (y if x is None else x if y is None else f(x, y) for f, x, y in ((min, self.lo, other.lo), (max, self.hi, other.hi)))
        self.bare = most(self.bare, other.bare)


_ITEM = "component binary, node binary, other binary, w double, h long, brand_key string, colour string, category string, pack int, size_of string, size double, bare double"


def _join_clusters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All components of a partition: edges by falling weight join two clusters if no fact tells them apart."""
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    b = pd.concat(rows, ignore_index=True)
    is_node = b["other"].isna()
    n = b[is_node]
    n = n.astype(object).where(n.notna(), None)
    cluster = {bytes(k): _Cluster(list(e), p, q, s, r) for k, *e, p, q, s, r in zip(n["node"], *(n[c] for c in _EQUAL), n["pack"], n["size_of"], n["size"], n["bare"])}
    root = {k: k for k in cluster}

    def find(x: bytes) -> bytes:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = b[~is_node].sort_values(["w", "h"], ascending=False)
    for x, y in zip(edges["node"], edges["other"]):
        x, y = find(bytes(x)), find(bytes(y))
        if x != y and cluster[x].fits(cluster[y]):
            x, y = min(x, y), max(x, y)
            cluster[x].take(cluster.pop(y))
            root[y] = x
    yield pd.DataFrame({"node": list(root), "cluster": [find(x) for x in root]})


def _clusters(nodes: DataFrame, edges: DataFrame, large: int = LARGE) -> DataFrame:
    """``node``, ``cluster``: groups of nodes joined along falling weights, unless a known fact of one group differs from one of the other.

    ``edges``: ``a``, ``b``, ``w``, ``h`` (parts equal weights). Connected components stand together in a task; one of over
    ``large`` edges is joined in rounds over all tasks, with the same result.
    """
    of = cut(components(edges, "a", "b"))
    sized = lookup(edges, of.select(F.col("node").alias("a"), "component"), ["a"])
    giant = cut(sized.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("component"))
    facts = nodes.select("node", *_EQUAL, "pack", "size_of", "size", "bare")
    placed = facts.join(of, "node")
    none = lambda kinds: [F.lit(None).cast(k).alias(c) for c, k in kinds]
    some_giant = giant.limit(1).count() > 0
    usual = (lambda d: lookup(d, giant, ["component"], "left_anti")) if some_giant else (lambda d: d)
    as_node = usual(placed).select("component", "node", *none([("other", "binary"), ("w", "double"), ("h", "bigint")]), *_EQUAL, "pack", "size_of", "size", "bare")
    as_edge = usual(sized).select("component", F.col("a").alias("node"), F.col("b").alias("other"), "w", "h", *none([("brand_key", "string"), ("colour", "string"), ("category", "string"), ("pack", "int"), ("size_of", "string"), ("size", "double"), ("bare", "double")]))
    together = as_node.unionByName(as_edge).repartition("component").mapInPandas(_join_clusters, "node binary, cluster binary")
    if some_giant:
        rest = lookup(sized, giant, ["component"], "left_semi")
        together = together.unionByName(_rounds(lookup(placed, giant, ["component"], "left_semi").drop("component"), rest.select("a", "b", "w", "h")))
    return together


def _rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``_join_clusters`` without a task that holds a component.

    In each round every two clusters that are each other's best merge, which is what falling weights do with them; their
    facts become one, edges to a third are put together, and edges between clusters told apart go, until no edge is left.
    """
    state = cut(nodes.select(F.col("node").alias("cluster"), *_EQUAL, "pack", "size_of", F.col("size").alias("size_lo"), F.col("size").alias("size_hi"), F.col("bare").alias("bare_lo")))
    of = nodes.select("node", F.col("node").alias("cluster"))
    while True:
        x, y = state.select(F.col("cluster").alias("a"), F.struct("*").alias("x")), state.select(F.col("cluster").alias("b"), F.struct("*").alias("y"))
        open_ = cut(lookup(lookup(edges, x, ["a"]), y, ["b"]).where(_compatible()).select("a", "b", "w", "h"))
        if not open_.limit(1).count():
            return of
        ends = open_.select(F.explode(F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("other")), F.struct(F.col("b").alias("me"), F.col("a").alias("other")))).alias("e"), "w", "h").select("e.*", "w", "h")
        best = cut(ends.groupBy("me").agg(F.max(F.struct("w", "h", "other")).alias("m")).select("me", F.col("m.other").alias("other")))
        merged = cut(best.alias("p").join(best.alias("q"), (F.col("p.other") == F.col("q.me")) & (F.col("q.other") == F.col("p.me")) & (F.col("p.me") > F.col("p.other"))).select(F.col("p.me").alias("old"), F.col("p.other").alias("new")))
        of = cut(lookup(of, merged.withColumnRenamed("old", "cluster"), ["cluster"], "left").select("node", F.coalesce("new", "cluster").alias("cluster")))
        moved = lookup(state, merged.withColumnRenamed("old", "cluster"), ["cluster"], "left").withColumn("cluster", F.coalesce("new", "cluster"))
        state = cut(moved.groupBy("cluster").agg(*[F.max(c).alias(c) for c in (*_EQUAL, "pack", "size_of")], F.min("size_lo").alias("size_lo"), F.max("size_hi").alias("size_hi"), F.max("bare_lo").alias("bare_lo")))
        for end in ("a", "b"):
            open_ = lookup(open_, merged.withColumnRenamed("old", end), [end], "left").withColumn(end, F.coalesce("new", end)).drop("new")
        edges = open_.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.struct("w", "h")).alias("m")).select("a", "b", "m.*")


def product_groups(catalog: DataFrame, brands: DataFrame) -> DataFrame:
    """``doc_id``, ``locale``, ``group_id`` of every listing; listings of one product share the group.

    Blocks are pairs of rare title tokens (the brand is one); listings that share blocks are joined by edges weighted by
    the blocks' rarity, weak edges are pruned at their nodes, and an edge survives if the model number is the same and no
    known fact (brand, colour, category, pack, size) differs. Clusters grow along the edges with most facts in common,
    as long as no fact of one differs from a fact of the other.

    Null and blank fields tell nothing; a pack that is not named is one. A ``doc_id`` delivered twice counts
    once; other columns are ignored. Brands are read from the title and the column by ``brands``
    (``brand_id``, ``brand_name``, ``brand_kana``) and by what the column itself has several times.
    """
    facts = _facts(catalog, brands)
    nodes, of_listing = _nodes(facts)
    edges = _graph(nodes)
    one = F.struct("node", "main", "models", "blocks", *_FACTS, F.col("size").alias("size_lo"), F.col("size").alias("size_hi"), F.col("bare").alias("bare_lo"))
    x, y = nodes.select(F.col("node").alias("a"), one.alias("x")), nodes.select(F.col("node").alias("b"), one.alias("y"))
    verified = lookup(lookup(edges, x, ["a"]), y, ["b"]).where(_compatible() & _same_model())
    weighted = cut(verified.select("a", "b", (_agreement() + F.col("w") / (F.col("w") + 100.0)).alias("w"), F.xxhash64("a", "b").alias("h")))
    of_node = _clusters(nodes, weighted)
    grouped = of_listing.join(of_node, "node", "left").select("doc_id", F.lower(F.hex(F.coalesce("cluster", "node"))).alias("group_id"))
    placed = facts.select("doc_id", "locale").join(grouped, "doc_id", "left")
    return placed.select("doc_id", "locale", F.coalesce("group_id", F.concat(F.lit("="), F.col("doc_id"))).alias("group_id"))


def group_pairs(groups: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """All pairs of a group's listings, ``doc_id_a`` < ``doc_id_b``; groups over ``chunk`` are paired chunk by chunk."""
    sizes = cut(groups.groupBy(F.col("group_id").alias("basket")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = groups.select(F.col("group_id").alias("basket"), F.col("doc_id").alias("item"))
    pairs = _ordinary(lookup(members, sizes.where(F.col("n") <= chunk), ["basket"], "left_semi"))
    large = sizes.where(F.col("n") > chunk)
    if large.limit(1).count():
        pairs = pairs.unionByName(_chunked(lookup(members, large.select("basket"), ["basket"], "left_semi"), large, chunk))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))
