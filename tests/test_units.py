"""Quantities in common units."""

import pytest

from shelfspark.operators.units import common_units, entry_amounts


@pytest.mark.parametrize(
    ("entry", "comma", "want"),
    [
        ("1 1/2 l", False, [(0, "volume", 1500000)]), ("3 ½㎏", False, [(0, "mass", 3500000)]), ("約1/2 キロ", False, [(0, "mass", 500000)]), ("2 in 1", False, []), ("24/7", False, []), ("3-way", False, []), ("", False, []),
        ("5 libras, 8 onzas", True, [(0, "mass", 2494758)]), ("2 m, 40 cm", False, [(0, "length", 2400000)]), ("1,000,000 MB", False, [(0, "storage", 1000000)]), ("0,9\xa0mts", True, [(0, "length", 900000)]),
        ('approx. 17.7"', False, [(0, "length", 449580)]), ("16.9-fl. oz", False, [(0, "volume", 499793)]), ("20000mAh", False, [(0, "charge", 20000)]), ("1.2 kw", False, [(0, "power", 1200000)]), ("29.5型", False, [(0, "length", 749300)]),
    ],
)
def test_measures(entry, comma, want):
    assert entry_amounts(entry, (), comma, False) == want


@pytest.mark.parametrize(
    ("entry", "want"),
    [("L35 x W76 x H49 cm", [350000, 760000, 490000]), ("14.16 in x 1.48 ft", [359664, 451104]), ("90 × 830mm", [90000, 830000]), ("幅４２cm 奥行２７cm 高さ１１cm", [420000, 270000, 110000]), ("73x42x13", [])],
)
def test_dimensions(entry, want):
    assert entry_amounts(entry, (), False, True) == [(i, "length", x) for i, x in enumerate(want)]


def test_unit_of_the_text():
    assert entry_amounts("35.4", ("shelf 200 35.4 in",), False, False) == [(0, "length", 899160)]
    assert entry_amounts("0,25", ("botella 0,25 litros",), True, False) == [(0, "volume", 250000)]
    assert entry_amounts("73x42", ("box 73 x 42 cm",), False, True) == [(0, "length", 730000), (1, "length", 420000)]
    assert entry_amounts("35.4", ("shelf 35",), False, False) == []


def test_common_units(spark):
    rows = [("a", "us", ["1 l", None, "", "junk"], "t"), ("a", "us", ["1 l", None, "", "junk"], "t"), ("b", "us", None, None), ("c", None, ["9" * 5000 + " g x", "2 kg"], "t"), (None, "us", ["1 l"], "t")]
    df = spark.createDataFrame(rows, "doc_id string, locale string, m array<string>, title string").selectExpr("*", "1 AS amount")
    got = common_units(df, "doc_id", "locale", "m", ["title"], "f").where("amount < 1e12").collect()
    assert sorted((r.rec_key, r.entry_no, r.quantity, r.amount) for r in got) == [("a", 0, "volume", 1000000), ("c", 1, "mass", 2000000)]
    assert common_units(df.limit(0), "doc_id", "locale", "m", ["title"], "f").count() == 0
