"""Inverted index, BM25, vector search and fusion, for all queries of a batch at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.ranking import top_k
from shelfspark.operators.sizing import lookup, spread
from shelfspark.session import cut

K1, B = 1.2, 0.75
RRF = 60
#: Stated queries that meet the vectors in one pass.
QUERY_BLOCK = 4096
#: Queries scored against a batch of vectors at once.
TILE = 256
#: Share of the exact neighbours a cell search has to find, and the vectors on which that is measured.
RECALL, RECALL_SAMPLE = 0.9, 256


def postings(docs: DataFrame, doc: str, group: str, terms: Column) -> DataFrame:
    """``group``, ``term``, ``doc``, ``tf`` and the document's length ``dl`` in terms; texts without terms have none."""
    each = docs.select(F.col(group).alias("group"), F.col(doc).alias("doc"), terms.alias("terms"))
    each = each.select("group", "doc", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return each.groupBy("group", "doc", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25_index(docs: DataFrame, doc: str, group: str, terms: Column, k1: float = K1, b: float = B) -> DataFrame:
    """Postings with their BM25 ``weight`` and the term's ``idf``; frequencies and lengths are per group."""
    read = analysed(docs, doc, group, terms)
    posted = postings(read, "doc", "group", F.col("terms"))
    totals = read.select("group", F.size("terms").alias("dl")).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = posted.groupBy("group", "term").agg(F.count(F.lit(1)).alias("df"))
    whole = posted.join(df, ["group", "term"]).join(totals, "group")
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return whole.select("group", "term", "doc", "tf", "df", idf.alias("idf"), weight.alias("weight"))


def term_idfs(docs: DataFrame, doc: str, group: str, terms: Column) -> DataFrame:
    """``group``, ``term`` and ``idf`` as ``bm25_index`` has them; the postings are only counted, not joined."""
    read = analysed(docs, doc, group, terms)
    df = postings(read, "doc", "group", F.col("terms")).groupBy("group", "term").agg(F.count(F.lit(1)).alias("df"))
    totals = cut(read.groupBy("group").agg(F.count(F.lit(1)).alias("n")))
    return lookup(df, totals, ["group"]).select("group", "term", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(queries: DataFrame, key: str, group: str, terms: Column) -> DataFrame:
    """``query``, ``group``, ``term``, ``qtf``."""
    each = queries.select(F.col(key).alias("query"), F.col(group).alias("group"), F.explode(terms).alias("term"))
    return each.groupBy("query", "group", "term").agg(F.count(F.lit(1)).alias("qtf"))


def analysed(docs: DataFrame, doc: str, group: str, terms: Column) -> DataFrame:
    """``group``, ``doc``, ``terms``: every text analysed once, for the statistics and the search."""
    return cut(spread(docs).select(F.col(group).alias("group"), F.col(doc).alias("doc"), terms.alias("terms")))


def bm25_topk(docs: DataFrame, asked: DataFrame, k: int, block: int = QUERY_BLOCK, k1: float = K1, b: float = B) -> DataFrame:
    """The best ``k`` documents of each query: ``query``, ``doc``, ``score``, ``n_matched``, ``rk`` (score descending, document ascending).

    ``docs``: as ``analysed``; ``asked``: as ``query_terms``. The queries go block by block, with the document frequencies
    of their terms, to the documents; each task indexes the terms asked for of its own documents, scores them there
    and keeps the best ``k`` a query, so neither postings nor candidates are shuffled, whatever documents a term has.
    """
    totals = docs.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    df = docs.select("group", F.explode(F.array_distinct("terms")).alias("term")).groupBy("group", "term").agg(F.count(F.lit(1)).alias("df"))
    known = cut(lookup(asked, cut(df), ["group", "term"]).join(totals, "group"))
    blocks = max(1, -(-known.select("query").distinct().count() // block))
    best = None
    for n in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).toPandas()
        sent = docs.sparkSession.sparkContext.broadcast(_TermQueries(rows, k1, b))
        part = docs.mapInPandas(_score(sent, k), f"query long, doc {dict(docs.dtypes)['doc']}, score double, n_matched long")
        best = part if best is None else best.unionByName(part)
    return top_k(best, ["query"], [F.desc("score"), F.asc("doc")], k)


class _TermQueries:
    """A block of queries by group: the terms they have, their inverse frequencies, and each query's terms and how often it has them."""

    def __init__(self, rows: pd.DataFrame, k1: float, b: float):
        self.k1, self.b = k1, b
        self.groups: dict = {}
        for group, g in rows.groupby("group", dropna=False, sort=False):
            g = g.sort_values("query", kind="stable")
            codes, terms = pd.factorize(g["term"])
            ids = {t: i for i, t in enumerate(terms)}
            first = np.unique(codes, return_index=True)[1]
            n, df = g["n"].to_numpy(float)[first], g["df"].to_numpy(float)[first]
            idf = np.log1p((n - df + 0.5) / (df + 0.5))
            queries, begins = np.unique(g["query"].to_numpy(), return_index=True)
            of = list(zip(queries.tolist(), np.split(codes, begins[1:]), np.split(g["qtf"].to_numpy(float), begins[1:])))
            self.groups[group] = (ids, idf, float(g["avgdl"].iloc[0]), of)


def _score(sent, k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = sent.value
        names: dict = {}
        posted: dict = {}
        for b in batches:
            for group, doc, terms in zip(b["group"], b["doc"], b["terms"]):
                if group in block.groups and terms is not None and len(terms):
                    ids = block.groups[group][0]
                    docs, found = names.setdefault(group, []), posted.setdefault(group, [])
                    counts = Counter(i for i in map(ids.get, terms) if i is not None)
                    if counts:
                        found += [(i, len(docs), n, len(terms)) for i, n in counts.items()]
                        docs.append(doc)
        for group, found in posted.items():
            ids, idf, avgdl, queries = block.groups[group]
            term, doc, tf, dl = np.array(found, np.int64).reshape(-1, 4).T
            order = np.argsort(term, kind="stable")
            term, doc = term[order], doc[order]
            weight = (idf[term] * tf[order] * (block.k1 + 1) / (tf[order] + block.k1 * (1 - block.b + block.b * dl[order] / avgdl))) if len(term) else np.zeros(0)
            ends = np.searchsorted(term, np.arange(len(idf) + 1))
            docs = np.array(names.get(group, []), object)
            out: list[tuple] = []
            for query, its, qtf in queries:
                spans = [slice(ends[i], ends[i + 1]) for i in its]
                at = np.concatenate([doc[s] for s in spans])
                if not len(at):
                    continue
                hit, place, matched = np.unique(at, return_inverse=True, return_counts=True)
                score = np.round(np.bincount(place, np.concatenate([weight[s] * n for s, n in zip(spans, qtf)])), 6)
                if len(hit) > k:
                    some = score >= np.partition(score, len(score) - k)[len(score) - k]
                    hit, score, matched = hit[some], score[some], matched[some]
                first = np.lexsort((docs[hit], -score))[:k] if len(hit) > 1 else [0]
                out += [(query, docs[hit[i]], score[i], matched[i]) for i in first]
            yield pd.DataFrame(out, columns=["query", "doc", "score", "n_matched"])

    return search


def bm25_pairs(index: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """``query``, ``doc``, ``score``, ``n_matched`` and the matched ``terms`` of given pairs that share a term."""
    wanted = asked.join(pairs.select("query", "doc"), "query")
    hits = wanted.join(index, ["group", "term", "doc"])
    return hits.groupBy("query", "doc").agg(F.round(F.sum(F.col("weight") * F.col("qtf")), 6).alias("score"), F.count(F.lit(1)).alias("n_matched"), F.array_sort(F.collect_list("term")).alias("terms"))


def max_scores(index: DataFrame, asked: DataFrame, k1: float = K1) -> DataFrame:
    """Per query what a document could score at most, and the number of its terms the index (as ``bm25_index`` or ``term_idfs``) knows.

    Only the known terms may be broadcast, behind their count. Spark takes ``asked`` for as small as the file it came
    from and would send it whole through the driver; the hint keeps it in shuffles.
    """
    known = cut(index.select("group", "term", "idf").distinct())
    met = lookup(asked.hint("merge"), known, ["group", "term"])
    return met.groupBy("query").agg(F.round(F.sum(F.col("idf") * (k1 + 1) * F.col("qtf")), 6).alias("max_score"), F.count(F.lit(1)).alias("n_known"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest vectors of each stated query by inner product: ``query``, ``vec``, ``score``, ``rk``.

    ``queries``: ``query``, ``q``, ``group``; ``vectors``: ``vec``, ``v``, ``group``. A query meets the vectors of
    its group (a null group: all), but not the vector of its own id; that is a filter before the choice of the best.
    The query set goes block by block to the vectors; every batch of vectors keeps its own best ``k`` per query, so
    what is shuffled doesn't grow with the pairs. Vectors that are null or of another length are left out.
    """
    asked = queries.where(F.col("q").isNotNull()).select("query", "q", "group")
    blocks = max(1, -(-asked.count() // block))
    best = None
    for n in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).collect()
        part = vectors.select("vec", "v", "group").mapInPandas(_nearest(rows, k), "query long, vec long, score double")
        best = part if best is None else best.unionByName(part)
    return top_k(best, ["query"], [F.desc("score"), F.asc("vec")], k)


def _nearest(rows: list, k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not rows:
            return
        ids = np.array([r["query"] for r in rows])
        q = np.array([r["q"] for r in rows], np.float64)
        groups = np.array([r["group"] for r in rows], object)
        free = np.array([g is None for g in groups])
        for b in batches:
            b = b[[x is not None and len(x) == q.shape[1] for x in b["v"]]]
            if not len(b):
                continue
            vec, of = b["vec"].to_numpy(), b["group"].to_numpy(object)
            v = np.stack(b["v"].to_numpy()).astype(np.float64).T
            for lo in range(0, len(ids), TILE):
                tile = slice(lo, lo + TILE)
                scores = np.round(q[tile] @ v, 6)
                scores[~((free[tile, None] | (groups[tile, None] == of[None, :])) & (ids[tile, None] != vec[None, :]))] = -np.inf
                least = np.partition(scores, max(len(vec) - k, 0), axis=1)[:, max(len(vec) - k, 0)]
                row, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))  # the best k of each row and what ties with the last
                yield pd.DataFrame({"query": ids[tile][row], "vec": vec[col], "score": scores[row, col]})

    return search


def ivf_cells(vectors: DataFrame, cells: int, sample: int = 20_000, seed: int = 7):
    """A k-means model of ``cells`` cells, fitted on at most ``sample`` vectors (the bound of what is fitted on)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col("v").isNotNull()).select("vec", array_to_vector("v").alias("features"))
    picked = rows.orderBy(F.xxhash64("vec"), "vec").limit(sample)
    return KMeans(k=cells, seed=seed, featuresCol="features", predictionCol="cell").fit(picked)


def _by_nearness(model) -> Column:
    """The cells in order of the distance of their centre from ``q``."""
    centres = [c.tolist() for c in model.clusterCenters()]
    far = F.transform(F.lit(centres), lambda c: F.aggregate(F.zip_with(F.col("q"), c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return F.transform(F.array_sort(F.transform(far, lambda d, i: F.struct(d.alias("d"), i.alias("cell")))), lambda x: x["cell"])


def ivf_probes(model, vectors: DataFrame, k: int, recall: float = RECALL, sample: int = RECALL_SAMPLE) -> int:
    """The fewest cells that find ``recall`` of the exact ``k`` neighbours, measured on ``sample`` of the vectors.

    A neighbour is found if its cell is probed. The mean over the sample has to lie three standard errors above
    ``recall``, so that other queries reach it too; where no fewer cells do, all are probed.
    """
    from pyspark.ml.functions import array_to_vector

    cells = len(model.clusterCenters())
    rows = vectors.where(F.col("v").isNotNull())
    asked = rows.orderBy(F.xxhash64("vec", F.lit(1)), "vec").limit(sample).select(F.col("vec").alias("query"), F.col("v").alias("q"), F.lit(None).cast("long").alias("group"))
    placed = model.transform(rows.select("vec", array_to_vector("v").alias("features"))).select("vec", "cell")
    near = knn_exact(asked, rows, k).select("query", "vec").join(placed, "vec").join(asked.select("query", _by_nearness(model).alias("cells")), "query")
    ranks: dict[int, list[int]] = {}
    for r in near.select("query", F.array_position("cells", F.col("cell")).alias("rank")).collect():
        ranks.setdefault(r["query"], []).append(r["rank"])
    for probes in range(1, cells):
        found = np.array([np.mean(np.array(x) <= probes) for x in ranks.values()])
        if len(found) > 1 and found.mean() - 3 * found.std(ddof=1) / len(found) ** 0.5 >= recall:
            return probes
    return cells


def ivf_search(model, queries: DataFrame, vectors: DataFrame, k: int, probes: int) -> DataFrame:
    """Approximate nearest vectors: every vector is indexed by its cell, a query scores those of its ``probes`` nearest cells."""
    from pyspark.ml.functions import array_to_vector

    placed = model.transform(vectors.select("vec", "v", array_to_vector("v").alias("features"))).select("vec", "v", "cell")
    asked = queries.select("query", "q", F.explode(F.slice(_by_nearness(model), 1, probes)).alias("cell"))
    scored = asked.join(placed, "cell").where(F.col("query") != F.col("vec")).select("query", "vec", F.round(dot(F.col("q"), F.col("v")), 6).alias("score"))
    return top_k(scored, ["query"], [F.desc("score"), F.asc("vec")], k)


def rrf(lists: DataFrame, k: int = RRF) -> DataFrame:
    """``lists``: ``query``, ``doc``, ``rk`` (from 1) of any number of rankings; ``score`` is the sum of 1/(k + rk)."""
    return lists.groupBy("query", "doc").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rk"))), 9).alias("score"))


def zscore(x: Column, over: Window, least: float = 1e-9) -> Column:
    """Population z-score within a window; 0 where there is no spread."""
    sd = F.stddev_pop(x).over(over)
    return F.when((F.count(x).over(over) >= 2) & (sd > least), (x - F.avg(x).over(over)) / F.when(sd > least, sd)).otherwise(F.lit(0.0))


def z_fusion(candidates: DataFrame, query: str, a: str, b: str, alpha: float) -> DataFrame:
    """``alpha`` z(a) + (1 - alpha) z(b) within the query's candidates, as column ``fused``."""
    over = Window.partitionBy(query)
    mixed = alpha * F.coalesce(zscore(F.col(a), over), F.lit(0.0)) + (1 - alpha) * F.coalesce(zscore(F.col(b), over), F.lit(0.0))
    return candidates.withColumn("fused", F.round(mixed, 6))
