"""How a public tokenizer takes a text: characters per token, byte fallback and token entropy, with bands per script (problem 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from os.path import basename

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.sizing import lookup, spread
from shelfspark.session import cut

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Robust deviations from the median of its script a measure may have.
BAND = 4.0
#: Makes the median absolute deviation estimate a standard deviation.
MAD_TO_SD = 1.4826
MEASURES = ["chars_per_token", "byte_share", "entropy_share"]

_kana = re.compile(r"[぀-ヿㇰ-ㇿ㐀-鿿豈-﫿]")
_letter = re.compile(r"[^\W\d_]")


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.vocab_size())])


def script(text: str) -> str:
    """``cjk``, ``latin``, ``other``: the script of most letters; ``none`` without letters."""
    n = len(_letter.findall(text))
    if not n:
        return "none"
    if 2 * len(_kana.findall(text)) > n:
        return "cjk"
    return "latin" if 2 * sum(c.isalpha() and c < "ɐ" for c in text) > n else "other"


def measure(ids: np.ndarray, is_byte: np.ndarray, n_chars: int) -> tuple[int, float, float, float, float]:
    """Tokens, characters per token, share of byte tokens, entropy of the tokens in bits and as share of the most that many can have."""
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0, 1.0
    p = np.unique(ids, return_counts=True)[1] / n
    entropy = float(-(p * np.log2(p)).sum())
    return n, n_chars / n, float(is_byte[ids].mean()), entropy, entropy / np.log2(n) if n > 1 else 1.0


def fertility(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``script``, ``n_tokens``, ``chars_per_token``, ``byte_share``, ``entropy``, ``entropy_share`` of every document.

    Null and empty texts have no tokens and the entropy share 1; repeated rows come out as often as they come in; other
    columns are ignored. Texts are read whole. The vocabulary file need only be on the driver.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = basename(tokenizer)
    kind = documents.schema[key].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, is_byte = _pieces(SparkFiles.get(name))
        for b in batches:
            texts = [t or "" for t in b[text]]
            rows = [(script(t), *measure(np.array(ids, int), is_byte, len(t))) for t, ids in zip(texts, model.encode(texts, num_threads=1))]
            out = pd.DataFrame(rows, columns=["script", "n_tokens", "chars_per_token", "byte_share", "entropy", "entropy_share"])
            out.insert(0, "doc_id", b[key].to_numpy())
            yield out

    return spread(documents.select(key, text)).mapInPandas(read, f"doc_id {kind}, script string, n_tokens long, chars_per_token double, byte_share double, entropy double, entropy_share double")


def bands(measured: DataFrame, width: float = BAND) -> DataFrame:
    """``script`` and the least and largest value of each measure: the median, give or take ``width`` robust deviations (at least a fiftieth)."""
    some = measured.where("n_tokens > 0")
    middle = cut(some.groupBy("script").agg(*[F.percentile_approx(m, 0.5, 10_000).alias(f"m_{m}") for m in MEASURES]))
    off = lookup(some, middle, ["script"]).groupBy("script").agg(*[F.percentile_approx(F.abs(F.col(m) - F.col(f"m_{m}")), 0.5, 10_000).alias(f"d_{m}") for m in MEASURES])
    reach = {m: F.lit(width) * F.greatest(F.col(f"d_{m}") * MAD_TO_SD, F.lit(0.02) * F.greatest(F.col(f"m_{m}"), F.lit(0.05))) for m in MEASURES}
    return middle.join(off, "script").select("script", *[x for m in MEASURES for x in ((F.col(f"m_{m}") - reach[m]).alias(f"lo_{m}"), (F.col(f"m_{m}") + reach[m]).alias(f"hi_{m}"))])


def outside(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``rejected``, the names of the measures that lie outside their script's band (empty: none)."""
    joined = lookup(measured, limits, ["script"], "left")
    flags = F.array(*[F.when((F.col(m) < F.col(f"lo_{m}")) | (F.col(m) > F.col(f"hi_{m}")), F.lit(m)) for m in MEASURES])
    return joined.select(*measured.columns, F.filter(flags, lambda x: x.isNotNull()).alias("rejected"))
