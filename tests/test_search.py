"""Search, models, mentions and draws against small cases and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.engine import Engine
from shelfspark.functions import draws as D
from shelfspark.functions import text as T
from shelfspark.operators import graph, models, retrieval, sampling, sizing, spelling
from shelfspark.operators.matching import brand_mentions
from shelfspark.plans import search


def test_bm25_against_brute_force(spark):
    rng = random.Random(1)
    docs = [(f"d{i:02}", rng.choice(["us", "es"]), [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 9))]) for i in range(60)] + [("none", "us", None)]
    asked = [(q, g, t, n) for q in range(20) for g in [rng.choice(["us", "es"])] for t, n in {rng.choice("abcdefghz"): rng.randrange(1, 3) for _ in range(3)}.items()]
    d = spark.createDataFrame([(g, i, t) for i, g, t in docs], "group string, doc string, terms array<string>").repartition(5)
    a = spark.createDataFrame(asked, "query long, group string, term string, qtf long")
    want = {}
    for q in range(20):
        own = {t: n for x, _, t, n in asked if x == q}
        group = next(g for x, g, _, _ in asked if x == q)
        texts = {i: t or [] for i, g, t in docs if g == group}
        some = [t for i, g, t in docs if g == group]
        mean = sum(len(t) if t is not None else -1 for t in some if t is not None) / sum(t is not None for t in some)
        scores = {}
        for i, t in texts.items():
            for w, n in own.items():
                df = sum(w in x for x in texts.values())
                if w in t:
                    tf = t.count(w)
                    scores[i] = scores.get(i, 0) + n * math.log1p((len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        for k, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:4], 1):
            want[q, k] = (i, s)
    for block in (4096, 3):
        got = {(r.query, r.rk): (r.doc, r.score) for r in retrieval.bm25_topk(d, a, 4, block=block).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-5) for k in want)
    assert retrieval.bm25_topk(d, a.limit(0), 4).count() == retrieval.bm25_topk(d.limit(0), a, 4).count() == 0


def test_queries_are_not_broadcast_for_their_statistics(spark, tmp_path, monkeypatch):
    titles = [("a", "us", "red cup"), ("b", "us", "red red pan"), ("b", "us", "pan red red"), ("c", "us", None), ("d", "es", "taza"), ("e", None, "red")]
    spark.createDataFrame(titles, "doc_id string, locale string, title string").write.parquet(f"{tmp_path}/catalog.parquet")
    asked = spark.range(20_000).select(F.col("id").alias("query_id"), F.lit("us").alias("locale"), F.lit("red cup red taza").alias("query"))
    asked.union(spark.createDataFrame([(-1, "es", "taza cup"), (-2, "jp", "red"), (-3, None, "red")], "query_id long, locale string, query string")).coalesce(1).write.parquet(f"{tmp_path}/queries.parquet")
    idf = lambda n, df: math.log1p((n - df + 0.5) / (df + 0.5))
    for small in (True, False):
        if not small:
            monkeypatch.setattr(sizing, "small", lambda *_: False)
        out = search.bm25_query_stats(spark, str(tmp_path))
        got = {r.query_id: (r.max_score, r.n_known) for r in out.collect()}
        assert len(got) == 20_001 and got[-1] == (pytest.approx(2.2 * idf(1, 1), abs=1e-6), 1)
        assert all(got[i] == (pytest.approx(2.2 * (2 * idf(4, 2) + idf(4, 1)), abs=1e-6), 2) for i in (0, 19_999))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) == small


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(5, None)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {x: x for e in edges if None not in e for x in e}
    for _ in range(70):
        for a, b in edges:
            if b is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_mentions_against_brute_force(spark):
    names = [("us", "red fox"), ("us", "fox"), ("us", "old red fox inn"), ("jp", "水筒"), ("jp", "水"), ("es", "fox")]
    texts = [(1, "us", "the old red fox inn!"), (2, "us", "redfox"), (3, "jp", "赤い水筒です"), (4, "es", "fox-fox"), (5, "us", None), (6, "us", ""), (7, "de", "fox")]
    got = {(r.rec, r.name) for r in brand_mentions(spark.createDataFrame(texts, "rec long, locale string, text string"), spark.createDataFrame(names, "locale string, name string")).collect()}
    assert got == {(1, "red fox"), (1, "fox"), (1, "old red fox inn"), (3, "水筒"), (3, "水"), (4, "fox")}


def test_corrections_of_texts(spark):
    words = spark.createDataFrame([("wireless", 3000), ("wirele", 1), ("mouse", 500), ("zavix", 1), ("zavis", 900)], "term string, df long")
    texts = spark.createDataFrame([(1, "wireles mouse"), (2, "zavix the mouse"), (3, None), (4, "")], "k long, t string")
    got = {r.k: r for r in spelling.correct(texts, "k", "t", words, spark.createDataFrame([("zavix",)], "term string")).collect()}
    assert (got[1].expanded, got[1].replaced, got[1].changes) == ("wireles wireless mouse", "wireless mouse", 1)
    assert got[2].changes == 0 and got[2].replaced == "zavix the mouse" and got[3].replaced is None and got[4].replaced == ""
    assert spelling.correct(texts, "k", "t", words).where("k = 2").first().replaced == "zavis the mouse"


def test_draws(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string").select("v", D.stable_hash64(F.col("v"), "s").alias("h"))
    rows = {r.v: r for r in df.select("v", "h", D.mixed_uniform(F.col("h"), 0).alias("u"), D.mixed_uniform(F.col("h"), 1).alias("w")).collect()}
    import hashlib

    assert int(rows["a"].h) == int.from_bytes(hashlib.md5(b"s|a").digest()[:8], "little") and rows[None].h is None and rows[None].u is None
    assert 0 <= rows["a"].u < 1 and rows["a"].u != rows["a"].w
    u = np.array([r[0] for r in spark.range(20_000).select(D.mixed_uniform(D.stable_hash64(F.col("id"), "t"), 3)).collect()])
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.histogram(u, 10)[0] / 2000 - 1).max() < 0.1
    z = [r[0] for r in spark.createDataFrame([(0.5,), (0.975,), (0.0,), (None,)], "p double").select(D.inverse_normal(F.col("p"))).collect()]
    assert z[0] == pytest.approx(0) and z[1] == pytest.approx(1.959964, abs=1e-5) and z[2:] == [None, None]
    t = spark.createDataFrame([("kettle", 0.1, 0.0), ("kettle", 0.5, 0.99), ("kettle", 0.9, 0.5), ("cup", 0.1, 0.1)], "w string, k double, p double").select(D.typo(F.col("w"), F.col("k"), F.col("p")))
    assert [r[0] for r in t.collect()] == ["ktetle", "kette", "ketttle", "cup"]


def test_weighted_draws_and_quantiles(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 9), (4, None), (None, 5)], "k long, w long")
    got = [r.k for r in sampling.weighted_draws(df, "k", "w", 4000).collect()]
    assert len(got) == 4000 and set(got) == {1, 3} and abs(got.count(3) / 4000 - 0.9) < 0.03
    assert sampling.weighted_draws(df.limit(0), "k", "w", 10).count() == 0
    rng = random.Random(3)
    xs = [rng.gauss(0, 1) for _ in range(200)]
    rows = spark.createDataFrame([(i, "a", i / 50) for i in range(51)] + [(99, "b", 0.5), (100, "a", None)], "i long, g string, u double")
    made = {r.i: r.value for r in sampling.quantile_map(rows, "g", "u", spark.createDataFrame([("a", x) for x in xs] + [("a", None)], "g string, x double"), "x").collect()}
    assert all(made[i] == pytest.approx(float(np.quantile(xs, i / 50))) for i in range(51)) and made[99] is None and made[100] is None


def test_rerank_puts_the_tail_below(spark):
    rows = spark.createDataFrame([("q", f"d{i}", 10.0 - i, float(i), i + 1) for i in range(6)], "query_id string, doc_id string, s double, m double, first int")
    got = [(r.doc_id, r.final) for r in models.rerank(rows, "query_id", "s", "m", "first", 3).orderBy("rk").collect()]
    assert [d for d, _ in got] == ["d2", "d1", "d0", "d3", "d4", "d5"] and got[3][1] == pytest.approx(-1) and got[4][1] < got[3][1]


def test_engine(spark):
    engine = Engine(spark, "/root/testdata/sf0.001")
    title = engine.catalog.where("locale = 'us' AND title IS NOT NULL").orderBy("doc_id").first()
    found = engine.search([title.title, "qqqq"], "us", k=3, field="title").collect()
    assert found[0].text == title.title and found[0].rk == 1 and found[0].title.split()[0] and len(found) == 3 and found[0].terms
    assert engine.search([title.title], "us", department="no such").count() == 0
    own = engine.search([title.title], "us", k=50, department=title.category or "Home")
    assert own.join(engine.catalog.where(F.col("category") == (title.category or "Home")).select("doc_id"), "doc_id", "left_anti").count() == 0


def test_cosines_against_numpy(spark):
    from shelfspark.plans import learned

    got = learned.dense_cosines(spark, "/root/testdata/sf0.001").collect()
    assert got and all(-1.000001 <= r.dense_cos <= 1.000001 for r in got) and any(r.dense_cos > 0.2 for r in got)


def test_registry_lists(spark):
    from shelfspark.plans import learned

    got = {(r.version, r.alias, r.meta) for r in learned.registered_models(spark, "/root/testdata/sf0.001").collect()}
    assert got == {("1", "candidate", '{"size": 8}'), ("2", "production", '{"size": 16}')}


def test_held_out_departments(spark):
    from shelfspark.plans import learned

    got = learned.predicted_departments(spark, "/root/testdata/sf0.01").where("held AND department <> 'Unknown'").collect()
    assert sum(r.predicted == r.department for r in got) > 0.7 * len(got)
    assert T.terms  # the model's terms are the index's
