"""Containers of fixed capacity filled with texts (problem 8)."""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from os.path import basename

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.sizing import spread
from shelfspark.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pre-tokenisation of the byte-level vocabulary (a fixed value of the tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items a task packs at a time, and the fill below which a container is opened again for the next round.
GROUP, KEEP = 20_000, 0.995
#: Kinds of containers packed in one pass; further kinds are packed in further passes over the counts.
KINDS_A_PASS = 100


@lru_cache(maxsize=2)
def load_encoding(path: str):
    """The byte-level encoding of a vocabulary file (one line per token: its bytes in base 64, its rank)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``item`` and ``n_tokens`` of every text under a public byte-level tokenizer; null and empty texts have 0.

    The vocabulary file ``tokenizer`` need only be on the driver: Spark ships it to the executors.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = basename(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_encoding(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"item": b[key], "n_tokens": [len(encode(t)) if t else 0 for t in b[text]]})

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, text)).mapInPandas(count, f"item {kind}, n_tokens long")


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in ``sizes`` (each 1..capacity): the largest item left opens a bin, and the subset of the
    others that fills the rest best is found by a subset-sum over the lengths still available."""
    left: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(sizes):
        left[s].append(i)
    lengths = sorted(left, reverse=True)
    bins = []
    while lengths:
        first = lengths[0]
        own = [left[first].pop()]
        if not left[first]:
            lengths.pop(0)
        rest = capacity - first
        reach, mask, steps = 1, (1 << rest + 1) - 1, []
        for s in lengths:  # bit b of reach: some subset of the lengths so far sums to b
            if s > rest:
                continue
            for _ in range(min(len(left[s]), rest // s)):
                steps.append((s, reach))
                reach |= reach << s & mask
                if reach >> rest or reach == steps[-1][1]:
                    break
            if reach >> rest:
                break
        total = reach.bit_length() - 1
        for s, before in reversed(steps):
            if not before >> total & 1:
                own.append(left[s].pop())
                total -= s
                if not left[s]:
                    lengths.remove(s)
        bins.append(own)
    return bins


def _packer(round_: int):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "item", "piece"]).reset_index(drop=True)
        c, g = int(pdf["c"][0]), int(pdf["g"][0])
        place, filled = [""] * len(pdf), [0.0] * len(pdf)
        sizes = pdf["n"].tolist()
        for k, bin_ in enumerate(fill(sizes, c)):
            total = sum(sizes[i] for i in bin_) / c
            for i in bin_:
                place[i], filled[i] = f"{round_}-{g}-{k}", total
        return pd.DataFrame({"container_kind": pdf["container_kind"], "c": c, "container": place, "item": pdf["item"], "piece": pdf["piece"], "n": pdf["n"], "filled": filled})

    return one


def pack(items: DataFrame, capacities: DataFrame, group: int = GROUP, keep: float = KEEP) -> DataFrame:
    """Each item's container: ``container_kind``, ``container`` (string), ``item``, ``piece``, ``n_tokens``.

    ``items``: ``item``, ``n_tokens``, computed once; ``capacities``: ``container_kind``, ``capacity_tokens``, of
    which ``KINDS_A_PASS`` are packed at a time.
    Only items larger than the capacity are cut, into full containers and one rest (pieces from 0). Items
    without tokens take no space and stand in no container. Repeated items are packed as often as they
    come. Items are hashed into groups of about ``group``, packed by minimum bin slack; containers filled
    below ``keep`` are opened again and their items packed in ever fewer groups, as long as that halves
    what is left. Containers are named by round, group and number.
    """
    kinds = [tuple(r) for r in capacities.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("long")).distinct().orderBy("container_kind", "capacity_tokens").collect()]
    counted = cut(items.where(F.col("n_tokens") > 0).select("item", "n_tokens"))
    out = items.select(F.lit("").alias("container_kind"), F.lit("").alias("container"), "item", F.lit(0).cast("long").alias("piece"), "n_tokens").limit(0)
    for at in range(0, len(kinds), KINDS_A_PASS):
        out = out.unionByName(_pack_kinds(counted, kinds[at : at + KINDS_A_PASS], group, keep))
    return out


def _pack_kinds(items: DataFrame, kinds: list[tuple[str, int]], group: int, keep: float) -> DataFrame:
    kind = items.schema["item"].dataType.simpleString()
    schema = f"container_kind string, c long, container string, item {kind}, piece long, n long, filled double"
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("c")) for k, c in kinds]))
    found = items.select("item", "n_tokens", each.alias("k")).select("k.*", "item", "n_tokens")
    n_pieces = F.ceil(F.col("n_tokens") / F.col("c"))
    pieces = found.select("container_kind", "c", "item", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), n_pieces - 1)).alias("piece"))
    pieces = pieces.withColumn("n", F.when((F.col("piece") + 1) * F.col("c") <= F.col("n_tokens"), F.col("c")).otherwise(F.col("n_tokens") % F.col("c"))).drop("n_tokens")
    full = pieces.where("n = c").select("container_kind", F.concat(F.lit("full-"), F.col("item").cast("string"), F.lit("-"), "piece").alias("container"), "item", "piece", F.col("n").alias("n_tokens"))
    rest = cut(pieces.where("n < c"))
    done = [full]
    salt, before = 0, float("inf")
    while True:
        most = rest.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if not most:
            break
        groups, last = max(1, -(-most // group)), most <= group or most > before / 2

        spread = rest.select("container_kind", "c", "item", "piece", "n", F.pmod(F.xxhash64("item", "piece", F.lit(salt)), F.lit(groups)).cast("int").alias("g"))
        placed = cut(spread.groupBy("container_kind", "g").applyInPandas(_packer(salt), schema))
        closed = placed if last else placed.where(F.col("filled") >= keep)
        done.append(closed.select("container_kind", "container", "item", "piece", F.col("n").alias("n_tokens")))
        if last:
            break
        rest = cut(placed.where(F.col("filled") < keep).select("container_kind", "c", "item", "piece", "n"))
        salt, before = salt + 1, most
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
