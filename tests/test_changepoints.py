"""Level shifts and changes of unit."""

import itertools

import numpy as np
import pytest

from shelfspark.operators import changepoints as C


def _cost(x, begins, penalty):
    return sum(((p - p.mean()) ** 2).sum() + penalty for p in np.split(x, begins[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_segments_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, 11) + np.repeat(rng.normal(0, 3, 4), 3)[:11], 3)
    for penalty in (0.1, 1.0, 5.0, 50.0):
        got = C.segments(np.ones(11), x, x * x, penalty)
        best = min(_cost(x, [0, *c], penalty) for k in range(11) for c in itertools.combinations(range(1, 11), k))
        assert got[0] == 0 and _cost(x, got, penalty) == pytest.approx(best)


def _history():
    rng = np.random.default_rng(3)
    rows = []
    for source, unit_from, factor in (("a", 200, 28.349523125), ("b", 120, 0.001), ("c", 400, 1.0)):
        for d in range(300):
            for _ in range(3):
                v = float(np.exp(rng.normal(5.0, 0.3))) * (factor if d >= unit_from else 1.0)
                rows.append((source, "mass", d, v))
    return rows


def test_unit_shifts(spark):
    rows = _history() + [("a", "mass", 5, None), ("a", "mass", 5, -1.0), ("a", "mass", 5, float("nan")), ("a", None, 5, 1.0), ("a", "mass", None, 1.0), (None, "mass", 5, 2.0), ("d", "mass", 1, 3.0), ("d", "volume", 1, 3.0)]
    df = spark.createDataFrame(rows, "source string, quantity string, day int, value double").selectExpr("*", "1 AS n")
    got = {(r.source, r.quantity, r.day): r for r in C.unit_shifts(df).collect()}
    assert len(got) == 903
    assert all(got["c", "mass", d].factor == 1.0 and got["c", "mass", d].segment == 0 for d in range(300))
    assert all(got["a", "mass", d].factor == pytest.approx(1.0 if d < 200 else 28.349523125) for d in range(300))
    assert all(got["b", "mass", d].factor == pytest.approx(1000.0 if d < 120 else 1.0) for d in range(300))  # most are in the later unit
    assert C.unit_shifts(df.limit(0)).count() == 0
