"""Level shifts in histories of one quantity, and the change of unit that explains them."""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.units import UNITS

#: Penalty of a segment in variances of the noise, times the logarithm of the history's length.
PENALTY = 3.0
#: A shift is a known factor if it differs by at most this share.
FACTOR_ALIKE = 0.05


def known_factors(quantity: str) -> list[float]:
    """How many times one unit of a quantity is as large as another, one included."""
    sizes = [float(s) for s in UNITS.get(quantity, {})]
    return sorted({a / b for a in sizes for b in sizes} | {1.0})


def segments(n: np.ndarray, s: np.ndarray, q: np.ndarray, penalty: float) -> list[int]:
    """Begins of the segments that minimise squared deviation plus ``penalty`` a segment, exactly.

    ``n``, ``s``, ``q``: count, sum and sum of squares of each step of time. Of the last changepoints only those are kept
    that can still be best (pruned exact linear time).
    """
    cn, cs, cq = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, s, q))
    best, last = np.zeros(len(n) + 1), np.zeros(len(n) + 1, int)
    best[0] = -penalty
    able = np.array([0])
    for t in range(1, len(n) + 1):
        cost = best[able] + (cq[t] - cq[able]) - (cs[t] - cs[able]) ** 2 / (cn[t] - cn[able])
        k = int(np.argmin(cost))
        best[t], last[t] = cost[k] + penalty, able[k]
        able = np.append(able[cost <= best[t]], t)
    begins, t = [], len(n)
    while t:
        t = int(last[t])
        begins.append(t)
    return begins[::-1]


def _noise(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> float:
    """Variance of one value, from values of one step and from neighbouring steps, whichever is known and less."""
    within = (q - s * s / n).sum() / max((n - 1).sum(), 1) if (n > 1).any() else np.inf
    mean = s / n
    steps = np.diff(mean) / np.sqrt(1 / n[1:] + 1 / n[:-1]) if len(n) > 1 else np.array([0.0])
    between = (np.median(np.abs(steps)) * 1.4826) ** 2
    return max(min(within, between) if np.isfinite(within) and within > 0 else between, 1e-6)


def _segmented(quantity: str, n: np.ndarray, s: np.ndarray, q: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begins = segments(n, s, q, penalty * _noise(n, s, q) * log(max(n.sum(), 2.0)))
    number = np.searchsorted(begins, np.arange(len(n)), "right") - 1
    size = np.bincount(number, n)
    level = np.bincount(number, s) / size
    shift = level - level[int(np.argmax(size))]  # against the level most values have
    logs = np.log(known_factors(quantity))
    near = logs[np.abs(shift[:, None] - logs).argmin(1)]
    factor = np.where(np.abs(shift - near) <= FACTOR_ALIKE, np.exp(near), 1.0)
    return number, level[number], factor[number]


def unit_shifts(history: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """``source``, ``quantity``, ``day``, ``n``, ``segment``, ``level`` (mean logarithm) and ``factor`` of each day of each history.

    ``history``: ``source``, ``quantity``, ``day``, ``value``. Each history of logarithms is cut into segments by exact
    penalised search; a segment whose level differs from the main one by a known factor between two units was
    recorded in the other unit, and its values divided by ``factor`` are in the main one; 1 if none explains it. Null
    sources are one source; rows without day or quantity and values that are null, NaN or not positive are left out, repeated
    rows count as often as they come. Values are summed per day before the shuffle, so a task holds the days of a
    history and never its rows.
    """
    x = F.ln(F.col("value").cast("double"))
    good = (F.col("value") > 0) & ~F.isnan(F.col("value").cast("double")) & (F.col("value") < float("inf")) & F.col("day").isNotNull() & F.col("quantity").isNotNull()
    days = history.where(good).groupBy("source", "quantity", "day").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    kinds = dict(days.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        number, level, factor = _segmented(pdf["quantity"].iloc[0], *(pdf[c].to_numpy(float) for c in "nsq"), penalty)
        return pdf[["source", "quantity", "day", "n"]].assign(segment=number, level=level, factor=factor)

    return days.groupBy("source", "quantity").applyInPandas(one, f"source {kinds['source']}, quantity string, day {kinds['day']}, n long, segment int, level double, factor double")
