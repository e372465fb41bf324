"""Ranks, vectors, samples and joins by size."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import ranking, retrieval, sizing
from shelfspark.plans import search


def test_distributed_positions(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.randrange(5), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, x long, id long")
    got = {r.id: r.rk for r in ranking.distributed_positions(df, ["g"], [F.desc("x"), F.asc("id")], parts=7).collect()}
    for g in range(3):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))


def test_running_total(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(100)], "id long, v double")
    assert {r.id: r.s for r in ranking.running_total(df, [F.col("id")], "v", "s", parts=5).collect()} == {i: float(i) for i in range(100)}


def test_lookup(spark):
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2)], "k string, v long")
    mapping = spark.createDataFrame([("a", "A"), ("c", "C")], "k string, m string")
    for options in ({"limit": 10}, {"limit": 0}, {"limit": 0, "hot": 7}):
        assert sizing.lookup(rows, mapping, ["k"], **options).count() == 50
        assert sizing.lookup(rows, mapping, ["k"], "left", **options).count() == 52
        assert sizing.lookup(rows, mapping.select("k"), ["k"], "left_anti", **options).count() == 2
        assert sizing.lookup(rows, mapping.select("k"), ["k"], "left_semi", **options).count() == 50
        assert sizing.lookup(rows, mapping.union(mapping), ["k"], **options).count() == 100


def test_small(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 20, "t string")
    assert sizing.small(df) and not sizing.small(df, rows=19) and not sizing.small(df, size=10_000)
    assert sizing.small(df.limit(0), rows=0)


def test_knn_blocks_and_recall(spark):
    rng = random.Random(2)
    v = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(300)]
    vectors = spark.createDataFrame(v + [(999, None, 0)], "vec long, v array<float>, group long")
    queries = vectors.where("vec % 20 = 0").select(F.col("vec").alias("query"), F.col("v").alias("q"), F.lit(None).cast("long").alias("group"))
    one = {(r.query, r.rk): r.vec for r in retrieval.knn_exact(queries, vectors, 5).collect()}
    assert one == {(r.query, r.rk): r.vec for r in retrieval.knn_exact(queries, vectors, 5, block=4).collect()} and len(one) == 75
    found = retrieval.ivf_search(retrieval.ivf_cells(vectors, 6), queries, vectors.where("v IS NOT NULL"), 5, probes=5).collect()
    exact = {(q, x) for (q, _), x in one.items()}
    assert len(exact & {(r.query, r.vec) for r in found}) >= 0.9 * len(exact)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_knn_ivf_recall(spark, size):
    exact, found = ({(r.query, r.vec) for r in q(spark, f"/root/testdata/{size}").collect()} for q in (search.knn_exact, search.knn_ivf))
    assert len(exact & found) >= 0.9 * len(exact)
