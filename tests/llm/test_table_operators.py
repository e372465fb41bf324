"""Brands, overlap, fusion, pairs and listings."""

import math
import random
from collections import Counter
from itertools import combinations
from statistics import median

import pytest


from shelfspark.llm import brands, fusion, listings, overlap, pairs, setjoin

REFERENCE = [(1, "Tikalo", None, "Home"), (2, "Tikalo Kids", None, "Home"), (3, "Zabotem Foods", "ザボテムフーズ", "Grocery"), (4, "Nozaha", "ノザハ", "Tools")]
REFERENCE_SCHEMA = "brand_id long, brand_name string, brand_kana string, top_category string"


@pytest.mark.parametrize(
    ("typed", "brand_id"),
    [
        ("TIKALO", 1), ("tikalo inc.", 1), ("Visit the Tikalo Store", 1), ("Tiklo", 1), ("Tiaklo", 1), ("Tikalo Kids Official", 2), ("tikalo kds", 2), ("Zabótem Foods S.L.", 3),
        ("ｚａｂｏｔｅｍ　ｆｏｏｄｓ", 3), ("ザボテムフーズ公式", 3), ("ﾉｻﾞﾊ", 4), ("ブランド: Nozaha", 4), ("Noz-aha®", 4), ("Νοzaha", 4), ("N/A", -1), ("Markasel", -1), ("【Nozaha】", 4), ("x" * 50_000, -1), ("NOZAHA(ノザハ)", 4),
    ],
)
def test_map_names(spark, typed, brand_id, cache={}):
    if not cache:
        table = spark.createDataFrame(REFERENCE, REFERENCE_SCHEMA)
        every = [m.args[1] for m in test_map_names.pytestmark if m.name == "parametrize"][0]
        values = spark.createDataFrame([(t, 9) for t, _ in every] * 2 + [(None, 9), ("  ", 9)], "value string, brand_id long")
        cache.update({r.value: r.brand_id for r in brands.map_names(values, table).collect()})
        assert None not in cache and cache["  "] == -1
        assert {r.brand_id for r in brands.map_names(values, table.limit(0)).collect()} == {-1}
        assert brands.map_names(values.limit(0), table).count() == 0
    assert cache[typed] == brand_id


def _slips(word, rng):
    i = rng.randrange(len(word))
    letter = rng.choice("abcz")
    j = rng.randrange(max(1, len(word) - 1))
    return {word[:i] + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :], word[:j] + word[j + 1 : j + 2] + word[j : j + 1] + word[j + 2 :]}


def test_every_single_slip_is_found(spark):
    rng = random.Random(7)
    names = sorted({"".join(rng.choice("abcd") for _ in range(n)) for n in range(2, 13) for _ in range(12)} | {"zavo", "nexo", "qi"})
    typed = sorted({t for n in names for _ in range(8) for t in _slips(n, rng)} - {""} | {"zvao", "neox", "qo"})
    values = spark.createDataFrame([(t,) for t in typed], "value string")
    table = spark.createDataFrame([(i, n, None, None) for i, n in enumerate(names)], REFERENCE_SCHEMA)
    near = {t: {i for i, n in enumerate(names) if n == t} or {i for i, n in enumerate(names) if overlap.slips(t, n, 1) <= 1} for t in typed}
    got = {r.value: r.brand_id for r in brands.map_names(values, table).collect()}
    for t in typed:
        assert got[t] in near[t] if near[t] else got[t] == -1, t


def test_prefix_join_against_brute_force(spark):
    rng = random.Random(1)
    sets = [("k%d" % i, [rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 8))]) for i in range(60)] + [("null", None), ("same", ["a", "b"]), ("same2", ["b", "a", "a"])]
    df = spark.createDataFrame(sets, "key string, tokens array<string>")
    for t in (0.3, 0.5, 0.8, 1.0):
        got = {(r.left_key, r.right_key): round(r.jaccard, 9) for r in setjoin.prefix_join(df, df, t).collect()}
        want = {}
        for (a, x), (b, y) in ((p, q) for p in sets for q in sets):
            x, y = set(x or []), set(y or [])
            if x and y and len(x & y) / len(x | y) >= t - 1e-9:
                want[a, b] = round(len(x & y) / len(x | y), 9)
        assert got == want


def _brute_fusion(rows, scores):
    out = {}
    for s in range(len(scores)):
        known = [v[s] for v in rows.values() if v[s] is not None]
        if not known:
            continue
        m = median(known)
        off = [abs(x - m) for x in known]
        d = median(off) * 1.4826 if median(off) > 0 else sum(off) / len(off) * 1.2533
        for k, v in rows.items():
            x = v[s] if v[s] is not None else min(known)
            z = max(-30, min(30, (x - m) / d)) if d > 0 else 0
            out.setdefault(k, []).append(math.log(1 / (1 + math.exp(-z))))
    return {k: round(math.exp(sum(out[k]) / len(out[k])), 9) if k in out else 0.0 for k in rows}


def test_fuse_scores(spark):
    rng = random.Random(2)
    scores = ["a", "b"]
    rows, tables = [], {}
    for r in range(6):
        for d in range(rng.choice([1, 2, 7, 40])):
            v = (rng.choice([None, rng.gauss(0, 5), 1e30]) if r else 2.0, None if r == 3 else rng.random() * 100)
            tables.setdefault(r, {})[f"d{d:03}"] = v
            rows.append((r, f"d{d:03}", 1, *v, "x"))
    rows += rows[:5] + [(None, "d", 1, 1.0, 1.0, "x"), (9, None, 1, 1.0, 1.0, "x"), (8, "n", 1, None, None, "x"), (7, "inf", 1, float("inf"), float("nan"), "x")]
    df = spark.createDataFrame(rows, "request_id long, doc_id string, ingested_at long, a double, b double, fused string")
    usual = {(r.request_id, r.doc_id): (r.fused, r.rk) for r in fusion.fuse_scores(df, scores).collect()}
    for r, table in tables.items():
        want = _brute_fusion(table, scores)
        assert {d: usual[r, d][0] for d in table} == pytest.approx(want, abs=2e-9)
        assert [d for d in sorted(table, key=lambda d: usual[r, d][1])] == sorted(table, key=lambda d: (-usual[r, d][0], d))
    assert usual[8, "n"] == (0.0, 1) and usual[7, "inf"] == (0.0, 1)
    assert len(usual) == sum(map(len, tables.values())) + 2
    hot = {(r.request_id, r.doc_id): (r.fused, r.rk) for r in fusion.fuse_scores(df, scores, hot_rows=5).collect()}
    assert hot.keys() == usual.keys()
    for k in usual:
        assert hot[k][0] == pytest.approx(usual[k][0], abs=2e-9) and hot[k][1] == usual[k][1]
    assert fusion.fuse_scores(df.limit(0), scores).count() == 0


def test_associated_pairs(spark):
    rng = random.Random(3)
    rows = [(q, f"i{rng.randrange(12)}") for q in range(80) for _ in range(rng.randrange(1, 5))] + [(q, x) for q in range(100, 106) for x in ("p", "q")]
    rows += [(200, f"big{i}") for i in range(40)] + rows[:20] + [(None, "i1"), (1, None)]
    df = spark.createDataFrame(rows, "q long, item string").selectExpr("*", "1 AS n_a")
    baskets = {}
    for q, i in rows:
        if q is not None and i is not None:
            baskets.setdefault(q, set()).add(i)
    n = Counter(i for b in baskets.values() for i in b)
    ab = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    for least, lift in ((4, 6), (1, 1), (2, 1.5)):
        want = {(a, b, c) for (a, b), c in ab.items() if c >= least and c * len(baskets) >= lift * n[a] * n[b]}
        for chunk in (256, 3):
            got = [(r.item_a, r.item_b, r.n_ab) for r in pairs.associated_pairs(df, "q", "item", least, lift, chunk=chunk).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    assert pairs.associated_pairs(df.limit(0), "q", "item", 1, 1).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "most", "d"), [("abc", "abc", 2, 0), ("abc", "acb", 2, 1), ("abc", "ab", 2, 1), ("abcd", "badc", 2, 2), ("abc", "xyz", 2, 3), ("", "ab", 2, 2), ("a", "abcdef", 2, 3)]
)
def test_slips(a, b, most, d):
    assert overlap.slips(a, b, most) == d


@pytest.mark.parametrize(
    ("one", "other", "locale"),
    [("wall shelves", "wall shelf", "us"), ("green teas", "green tea", "us"), ("cat litters", "cat litter", "us"), ("lociones", "locion", "es"), ("tiendas", "tienda", "es"), ("cables", "cable", "es"), ("tes verdes", "te verde", "es"), ("hervidores", "hervidor", "es"), ("boxes", "box", "us"), ("hoses", "hose", "us"), ("cases", "case", "us"), ("dresses", "dress", "us"), ("gloves", "glove", "us")],
)
def test_stem(one, other, locale):
    assert [overlap.stem(w, locale) for w in one.split()] == [overlap.stem(w, locale) for w in other.split()]


def _queries():
    base = ["tikalo wall shelf 30 cm", "nozaha green kettle 500 ml", "zabotem almond flour", "tikalo steel bottle 2 l"]
    rows = [(100 + i * 10 + j, b, "us", "train", "s") for i, b in enumerate(base) for j in range(6)]
    rows += [(500 + k, f"kettle almond flour {w}", "us", "train", "s") for k, w in enumerate("quartz velvet pumice walnut saffron juniper cobalt thistle".split())]
    held = [(1, "Wall  Shelves, TIKALO 30-cm", "us", "test", "s"), (2, "nozaha green ketle 500 ml", "us", "dev", None), (3, "nozaha red kettle 500 ml", "us", "test", "s"), (4, "tikalo wall shelf 40 cm", "us", "test", "s"), (5, "the zabotem almondflour", "us", "test", "s"), (6, "tikalo wall shelf 30 cm", "es", "test", "s")]
    odd = [(7, None, "us", "test", "s"), (8, "", "us", "test", "s"), (None, "zabotem almond flour", "us", "test", "s"), (9, "x" * 50_000, "us", "test", "s")]
    return rows + held + odd + held[:2]


def test_split_overlap(spark):
    df = spark.createDataFrame(_queries(), "query_id long, query string, locale string, split string, source string").selectExpr("*", "1 AS words")
    found = overlap.split_overlap(df)
    got = [(r.query_id_held, r.query_id_train) for r in found.query_pairs().collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(h, 100 + i * 10 + j) for h, i in ((1, 0), (2, 1), (5, 2)) for j in range(6)}
    of = {r.query_id: r for r in found.per_query().collect()}
    assert of[1].whole and of[1].covered == 1 and not of[4].whole and 0 < of[4].covered < 1 and of[6].covered == 0
    empty = overlap.split_overlap(df.limit(0))
    assert empty.query_pairs().count() == empty.per_query().count() == empty.classes().count() == empty.exact_copies().count() == 0


CATALOG = "doc_id string, locale string, title string, brand string, color string, category string, doc_text string, attr_measures array<string>, attr_colors array<string>, attr_materials array<string>, attr_audience array<string>, attr_pack_count int, group_id string"


def _listing(doc, title, brand="Tikalo", color=None, measures=None, pack=None, category="Home"):
    return (doc, "us", title, brand, color, category, title, measures, [color.lower()] if color else None, None, None, pack, "x")


def test_product_groups(spark):
    rows = [
        _listing("a1", "Tikalo Marwen 300 wall shelf 59.1 in", color="Green", measures=["59.1 in"]),
        _listing("a2", "best seller tikalo MARWEN-300 floating ledge 150 cm", brand="Tikalo Inc.", color="green"),
        _listing("a3", "Marwen300 shelf green 4.92 ft", brand=None, color="GREEN"),
        _listing("b1", "Tikalo Marwen 300 wall shelf 75 cm", color="green"),
        _listing("c1", "Tikalo Marwen 300 wall shelf 150 cm", color="red"),
        _listing("d1", "Tikalo Marwen 300 wall shelf 150 cm Pack of 3", color="green", pack=3),
        _listing("e1", "Nozaha Marwen 300 wall shelf 150 cm", brand="Nozaha", color="green"),
        _listing("f1", "Tikalo Marwen 305 wall shelf 150 cm", color="green"),
        _listing("a4", "Tikalo Marwen 300 wall shelf 150 cm ref 99812", color="green"),
        _listing("i1", "Nozaha velvet garden stool round 40 cm", brand="Nozaha", color="red"),
        _listing("i2", "round velvet stool for the garden, Nozaha 40 cm", brand="Nozaha", color="red"),
        _listing("i3", "Nozaha velvet garden stool round 60 cm", brand="Nozaha", color="red"),
        _listing("k1", "Zabotem Foods Kelvaro 710 new 2024", brand="Zabotem Foods"),
        _listing("k2", "Zabotem Foods Dremilo 560 new 2024", brand="Zabotem Foods"),
        _listing("k3", "Zabotem Foods Kelvario 710 tea", brand="Zabotem Foods"),
        _listing("g1", None, brand=None),
        _listing("g2", "", brand="N/A"),
        _listing("h1", "word " * 30_000),
        (None, *_listing("x", "Tikalo Marwen 300")[1:]),
    ]
    df = spark.createDataFrame(rows + rows[:2], CATALOG)
    reference = spark.createDataFrame(REFERENCE, REFERENCE_SCHEMA)
    groups = listings.product_groups(df, reference)
    got = {}
    for r in groups.collect():
        assert r.doc_id not in got
        got[r.doc_id] = r.group_id
    assert got.keys() == {r[0] for r in rows if r[0]}
    assert got["a1"] == got["a2"] == got["a3"] == got["a4"]
    assert got["i1"] == got["i2"] and got["k1"] == got["k3"]
    assert len({got[k] for k in ("a1", "b1", "c1", "d1", "e1", "f1", "g1", "g2", "h1", "i1", "i3", "k1", "k2")}) == 13
    want = {("a1", "a2"), ("a1", "a3"), ("a1", "a4"), ("a2", "a3"), ("a2", "a4"), ("a3", "a4"), ("i1", "i2"), ("k1", "k3")}
    for chunk in (256, 2):
        assert {(r.doc_id_a, r.doc_id_b) for r in listings.group_pairs(groups, chunk).collect()} == want
    assert listings.product_groups(df.limit(0), reference).count() == 0


def test_models_of_many_brands(spark):
    """A series word and number that many brands use, as they do in large tables, is still a model; "new 2024" is none."""
    names = ["Tikalo", "Nozaha", "Zabure", "Quimo", "Velda", "Horpen", "Lasto", "Brimel", "Fandor", "Gelvos", "Jarniq", "Pomdel"]
    rows, want = [], set()
    for i, brand in enumerate(names):
        for model in ("Marwen 300", "Dremilo 560"):
            one, two = f"{i:02}{model[0]}1", f"{i:02}{model[0]}2"
            rows.append(_listing(one, f"floating ledge {model} oak finish for the hall", brand=brand, color="Green", measures=["59.1 in"]))
            rows.append(_listing(two, f"new 2024 {model} - kitchen board, best seller 150 cm", brand=brand, color="green"))
            want.add((one, two))
    df = spark.createDataFrame(rows, CATALOG)
    found = listings.group_pairs(listings.product_groups(df, spark.createDataFrame(REFERENCE, REFERENCE_SCHEMA)))
    assert {(r.doc_id_a, r.doc_id_b) for r in found.collect()} == want
    facts = spark.createDataFrame([(f"z{i}", "us", names[i % 12], ["new 2024", f"marwen {100 + i // 16}"]) for i in range(48)], "doc_id string, locale string, brand_key string, models array<string>")
    counts = facts.selectExpr("locale", "true AS model", "explode(models) AS token").groupBy("locale", "model", "token").count().withColumnRenamed("count", "n")
    assert [r.token for r in listings._strange(facts, counts).collect()] == ["new 2024"]


def test_large_components_and_blocks(spark):
    """Rounds over all tasks give what one task gives, and chunks of a block what the block gives."""
    rng = random.Random(9)
    colours, sizes = [None, "red", "green"], [None, 100.0, 101.0, 150.0]
    rows = [(bytearray(f"{i:03}".encode()), None, rng.choice(colours), None, 1, "length" if s else None, s, rng.choice([None, 10.0]) if s is None else None) for i in range(24) for s in [rng.choice(sizes)]]
    nodes = spark.createDataFrame(rows, "node binary, brand_key string, colour string, category string, pack int, size_of string, size double, bare double")
    pairs = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(60)})
    edges = spark.createDataFrame([(rows[a][0], rows[b][0], float(rng.randrange(5)), rng.randrange(10**9)) for a, b in pairs], "a binary, b binary, w double, h long")
    one, many = ({bytes(r.node): bytes(r.cluster) for r in listings._clusters(nodes, edges, large=n).collect()} for n in (10**6, 0))
    assert one == many and 1 < len(set(one.values())) < 24
    facts = {bytes(r[0]): r for r in rows}
    for c in set(one.values()):
        members = [facts[k] for k, v in one.items() if v == c]
        assert len({m[2] for m in members} - {None}) <= 1 and len({m[6] for m in members} - {None, 100.0}) <= 1
    blocks = spark.createDataFrame([(bytearray(f"{i}".encode()), [(40, 99, False), (2 + i % 3, i % 7, True)]) for i in range(40)], "node binary, blocks array<struct<n:long,block:long,model:boolean>>")
    got = [{(bytes(r.a), bytes(r.b), round(r.w, 6)) for r in listings._graph(blocks, chunk).collect()} for chunk in (256, 4)]
    assert got[0] and {e[:2] for e in got[0]} == {e[:2] for e in got[1]}


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_ranking", "p5_found", "p6_found", "p7_found", "p8_packing", "p9_found", "p10_found"])
def test_queries_run(spark, name):
    from shelfspark.llm.registry import QUERIES

    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() == df.distinct().count() >= 0
    columns = {
        "p1_found": "src_field string, rec_key string, brand_id bigint", "p2_found": "query_id_a bigint, query_id_b bigint", "p5_found": "doc_id_a string, doc_id_b string", "p6_found": "doc_id_a string, doc_id_b string",
        "p7_found": "src_field string, rec_key string", "p9_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint",
    }
    if name in columns:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns[name]
