"""Hashes and draws that never change: 64-bit hashes, mixed uniforms, normal scores, typing errors."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def stable_hash64(value: Column, salt: str) -> Column:
    """The first eight bytes of md5("salt|value"), read little-endian, as decimal(20,0). Null for null."""
    digest = F.md5(F.concat(F.lit(f"{salt}|"), value.cast("string")))
    little = F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in reversed(range(8))])
    return F.conv(little, 16, 10).cast("decimal(20,0)")


def _mixed(hashes: np.ndarray, stream: int) -> np.ndarray:
    """SplitMix64 of hash and stream, wrapping at 2^64."""
    with np.errstate(over="ignore"):
        z = hashes + np.uint64((stream + 1) * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def mixed_uniform(hash64: Column, stream: int) -> Column:
    """A uniform number in [0, 1) of 53 bits from a 64-bit hash; each stream is independent of the others."""

    @F.pandas_udf("double")
    def draw(values: pd.Series) -> pd.Series:
        known = values.notna()
        out = pd.Series(np.nan, index=values.index)
        out[known] = (_mixed(values[known].map(int).to_numpy(np.uint64), stream) >> np.uint64(11)) / 2.0**53
        return out.astype(object).where(known, None)

    return draw(hash64)


@F.pandas_udf(DoubleType())
def inverse_normal(p: pd.Series) -> pd.Series:
    """The standard normal score of a probability; null outside (0, 1)."""
    f = NormalDist().inv_cdf
    return p.map(lambda x: f(x) if 0 < x < 1 else None, na_action="ignore").astype(object).where(p.between(0, 1, inclusive="neither"), None)


def typo(word: Column, kind: Column, place: Column) -> Column:
    """A word with one typing error inside, by two uniform numbers: two letters swapped, one left out or one doubled. Words under four letters stay."""
    n = F.char_length(word)
    i = (F.floor(place * (n - 2)) + 2).cast("int")
    piece = lambda a, size: F.substring(word, a, size)
    head, tail = piece(F.lit(1), i - 1), piece(i + 1, n)
    swapped = F.concat(head, piece(i + 1, F.lit(1)), piece(i, F.lit(1)), piece(i + 2, n))
    changed = F.when(kind < 1 / 3, swapped).when(kind < 2 / 3, F.concat(head, tail)).otherwise(F.concat(head, piece(i, F.lit(1)), piece(i, F.lit(1)), tail))
    return F.when(n < 4, word).otherwise(changed)
