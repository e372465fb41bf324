"""Overlap of splits."""

import itertools
import random

import pytest

from shelfspark.llm import overlap

SCHEMA = "query_id long, query string, locale string, split string, source string"


def _asked(spark, held, train):
    texts = [(t, "test") for t in held] + [(t, "train") for t in train]
    return spark.createDataFrame([(i, t, "us", s, "a") for i, (t, s) in enumerate(texts)], SCHEMA)


def _pairs(found, **options):
    rows = [tuple(r) for r in found.query_pairs(**options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_tails_between_equal_texts(spark):
    longer = [" ".join(w) + " red lamp" for w in itertools.permutations(["amber", "birch", "cedar", "fern"], 1)]
    for held, train in ((["red lamp"], ["red lamp", *longer]), (["red lamp", *longer], ["red lamp"])):
        assert _pairs(overlap.split_overlap(_asked(spark, held, train))) == {(0, len(held))}


def test_whole_among_tails_of_both_sides(spark):
    own = [f"{w} red lamp" for w in ("amber", "birch", "cedar")]
    found = overlap.split_overlap(_asked(spark, ["red lamp", *own], ["red lamp", *[f"{w} red lamp" for w in ("acorn", "badge", "coral")]]))
    assert _pairs(found) == {(0, 4)}


def test_copies_with_longer_texts_are_all_found(spark):
    names = [(f"x{a}", f"y{b}") for a, b in zip("abcdefghijklmnopqrst", "tsrqponmlkjihgfedcba")]
    copies = [" ".join(n) + "lor" for n in names]
    longer = [f"{w}{i} {c}" for w in ("un", "do", "tre") for i, c in zip("abcdefghijklmnopqrst", copies)]
    alone = _pairs(overlap.split_overlap(_asked(spark, copies, copies)))
    with_longer = _pairs(overlap.split_overlap(_asked(spark, copies, copies + longer)))
    n = len(copies)
    assert alone == with_longer >= {(i, n + i) for i in range(n)}


def test_texts_of_many_corrections_and_none(spark):
    frequent = ["keyboard", "monitor", "speaker"]
    held = ["keybaord montior speeker", "!!", "", None]
    train = ["keybaord montior speeker", *[f"{w} {i}" for w in frequent for i in range(100, 110)]]
    found = overlap.split_overlap(_asked(spark, held, train))
    assert _pairs(found) == {(0, len(held))}
    got = {r.query_id: (r.covered, r.whole) for r in found.per_query().collect()}
    assert len(got) == len(held) + len(train) and got[0] == got[len(held)] == (1.0, True)
    assert got[1] == got[2] == got[3] == (0.0, False)


def test_slips_in_tail_words(spark):
    held = ["wenjorvar green shelf", "wenjorvar green shelf 30 cm", "tilbo green shelf", "wenjorvar"]
    train = ["wenjorvaa shelf green", "wenjorvra green shelf 40 cm", "tolba green shelf", "wenjorvaa"]
    assert _pairs(overlap.split_overlap(_asked(spark, held, train))) == {(0, 4)}


def test_hot_texts_and_classes(spark):
    rows = [(i, "red lamps" if i % 2 else "Red lamp", "us", "train" if i % 3 else "dev", None) for i in range(60)] + [(100, "blue lamp", "us", "train", "s"), (100, "blue lamp", "us", "train", "s")]
    found = overlap.split_overlap(spark.createDataFrame(rows, SCHEMA))
    want = {(h, t) for h in range(0, 60, 3) for t in range(60) if t % 3}
    assert _pairs(found) == _pairs(found, chunk=7) == want
    classes = {r.query_id: r for r in found.classes().collect()}
    assert len(classes) == 61 and len({r.class_id for r in classes.values()}) == 2
    assert classes[0].n_links == 40 and classes[1].n_links == 20 and classes[100].n_links == 0
    exact = {tuple(r) for r in found.exact_copies().collect()}
    assert exact == {(h, t) for h, t in want if h % 2 == t % 2}


def test_long_texts(spark):
    rng = random.Random(6)
    words = ["w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(600)]
    held = [" ".join(words[:300]), " ".join(words[:300]) + " lamp"]
    train = [" ".join(words[:300]), " ".join(words[150:450])]
    found = overlap.split_overlap(_asked(spark, held, train))
    assert (0, 2) in _pairs(found) and (1, 2) not in _pairs(found)
    got = {r.query_id: r.covered for r in found.per_query().collect()}
    assert got[0] == 1.0 and got[1] == pytest.approx(300 / 301, abs=0.01) and got[3] == pytest.approx(0.5, abs=0.02)


def _best(w, i, others):
    return max((next((k for k in range(min(len(w) - i, len(x) - j)) if w[i + k] != x[j + k]), min(len(w) - i, len(x) - j)) for x in others for j in range(len(x))), default=0)


@pytest.mark.parametrize("parts", [1, 5])
def test_suffix_array_against_brute_force(spark, parts):
    rng = random.Random(parts)
    records = {(side, loc, tuple(rng.choice("abc") for _ in range(rng.randrange(1, 7)))) for _ in range(25) for side in ("train", "held") for loc in ("us", "es")}
    named = {r: f"{n:04}".encode() for n, r in enumerate(sorted(records))}
    df = spark.createDataFrame([(loc, bytearray(n), side, list(w)) for (side, loc, w), n in named.items()], "locale string, rec binary, side string, words array<string>")
    found = overlap.suffix_array(overlap._text_rows(df), parts=parts)
    got = {(bytes(r.rec), r.start): r.length for r in found.where("kind = 'span'").collect()}
    covered = {bytes(r.rec): r.covered for r in overlap.coverage(df, found.where("kind = 'span'")).collect()}
    for (side, loc, w), n in named.items():
        others = [x for s, o, x in records if s != side and o == loc]
        best = [_best(w, i, others) for i in range(len(w))]
        assert [got.get((n, i), 0) for i in range(len(w))] == best
        assert covered[n] == pytest.approx(len({k for i, b in enumerate(best) for k in range(i, i + b)}) / len(w))


def test_pairs_against_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["lamp", "lamps", "kettle", "shelf", "the", "oak"]) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    found = overlap.split_overlap(_asked(spark, texts[:30], texts[30:]))
    form = lambda t: sorted({"lamps": "lamp"}.get(w, w) for w in t.split() if w != "the") or sorted(t.split())
    assert _pairs(found) == {(i, 30 + j) for i, a in enumerate(texts[:30]) for j, b in enumerate(texts[30:]) if form(a) == form(b)}


def test_same_rows_as_the_exact_join(spark):
    from shelfspark.llm.registry import QUERIES

    exact, found = ({tuple(r) for r in QUERIES[q](spark, "/root/testdata/sf0.01").collect()} for q in ("p2_exact", "p2_found"))
    assert exact and exact <= found
