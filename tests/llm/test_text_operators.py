"""Plain forms, packing, leaks and repetition."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.llm import leaks, packing, repetition, textform

WORDS = "lamp bottle river stone copper meadow window garden silver engine pillow basket ladder candle mirror carpet bucket violin saddle hammer needle ribbon anchor barrel".split()


@pytest.mark.parametrize(
    ("odd", "even"),
    [
        ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"),
        ("ﾊﾝﾄﾞｸﾘｰﾑ", "ハンドクリーム"),
        ("café", "café"),
        ("zero​width﻿", "zerowidth"),
        ("no break", "no break"),
        ("hy‐phen−minus", "hy-phen-minus"),
        ("wаll shеlf", "wall shelf"),
        ("bοttle", "bottle"),
        ("bօttle", "bottle"),
        ("ᏟᎪᎡPET", "CARPET"),
        ("ﬂour", "flour"),
        ("登山口ープ", "登山ロープ"),
        ("モ二ター", "モニター"),
    ],
)
def test_plain(odd, even):
    assert textform.plain(odd) == even
    assert textform.plain(even) == even


@pytest.mark.parametrize("text", ["強力カッティング", "工具箱 木工用", "niño café", "Москва", "", "折りたたみ", "2個セット"])
def test_plain_texts_stay(text):
    assert textform.plain(text) == text


@settings(max_examples=5000, deadline=None)
@given(st.text(max_size=60))
def test_plain_is_idempotent(text):
    once = textform.plain(text)
    assert textform.plain(once) == once
    assert textform.folded(textform.folded(text)) == textform.folded(text)


def test_plain_forms(spark):
    long = "x" * 200_000 + "​"
    rows = [(1, "ok", "a"), (2, "a b", "a"), (2, "a b", "a"), (3, None, "a"), (4, "", "a"), (None, "​", "a"), (5, long, "a")]
    df = spark.createDataFrame(rows, "key long, text string, rec_key string")
    got = textform.plain_forms(df, "key", "text", "f").collect()
    assert sorted((r.src_field, r.rec_key) for r in got) == [("f", "2"), ("f", "5")]
    assert next(r.plain for r in got if r.rec_key == "2") == "a b"
    assert textform.plain_forms(df.limit(0), "key", "text", "f").count() == 0


def test_fold_column(spark):
    rows = [("  ABC  d",), ("Ｅｆ​",), (None,), ("",)]
    got = spark.createDataFrame(rows, "t string").select(textform.fold_column(F.col("t"))).collect()
    assert [r[0] for r in got] == ["abc d", "ef", None, ""]


def _brute_share(units, size):
    seen, covered = [], [False] * len(units)
    for i in range(len(units) - size + 1):
        g = units[i : i + size]
        if g in seen:
            covered[i : i + size] = [True] * size
        seen.append(g)
    return sum(len(u) for u, c in zip(units, covered) if c) / max(1, sum(map(len, units)))


def test_repeated_share_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        units = [rng.choice(WORDS[:4]) for _ in range(rng.randrange(0, 60))]
        assert repetition.repeated_share(" ".join(units)) == pytest.approx(_brute_share(units, 8))


def test_repeated_share_cases():
    one = " ".join(WORDS[:10])
    assert repetition.repeated_share(None) == repetition.repeated_share("") == repetition.repeated_share(one) == 0
    assert repetition.repeated_share(f"[1] {one}! [2] {one.upper()}... [3] {one}") == pytest.approx(2 / 3)
    assert repetition.repeated_share(one + " very" * 90) > 0.7
    assert repetition.repeated_share("重いねじが厚手の覆いを温めたまま看護師は止まった。" * 2) == pytest.approx(0.5)
    assert repetition.repeated_share(one * 20_000) > 0.99


def test_repetition_table(spark):
    rows = [(1, "a", 0.5), (1, "a", 0.5), (2, None, 1.0), (3, "", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, repeated_share double")
    assert sorted((r.doc_id, r.repeated_share) for r in repetition.repetition(df).collect()) == [(1, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]
    assert repetition.repetition(df.limit(0)).count() == 0


def test_wu_manber_against_brute_force():
    import numpy as np

    rng = random.Random(2)
    for _ in range(40):
        patterns = np.array([rng.choice([0, 1, 2, 3]) for _ in range(30)])
        stream = np.array([rng.choice([0, 1, 2, 3]) for _ in range(60)])
        found = leaks.WuManber(patterns, 3, 2, 4).search(stream)
        want = {(i, j) for i in range(58) for j in range(28) if 0 not in patterns[j : j + 3] and (stream[i : i + 3] == patterns[j : j + 3]).all()}
        assert set(zip(*map(list, found))) == want


@pytest.mark.parametrize(("length", "block", "base", "share"), [(3, 2, 500, 0.55), (8, 3, 500, 0.2)])
def test_wu_manber_skips(length, block, base, share):
    import numpy as np

    rng = np.random.default_rng(1)
    patterns = rng.integers(1, 250, 400)
    stream = rng.integers(250, base, 50_000)
    stream[1000 : 1000 + length] = patterns[20 : 20 + length]
    finder = leaks.WuManber(patterns, length, block, base)
    ends, looked = finder.candidates(stream)
    assert looked < share * len(stream) and 1000 + length - block in ends
    assert (1000, 20) in set(zip(*map(list, finder.search(stream))))


def _corpus():
    rng = random.Random(3)
    return {i: [rng.choice(WORDS) for _ in range(40)] for i in range(8)}


def test_leaked_passages(spark):
    items = _corpus()
    rng = random.Random(4)
    noise = lambda n: [rng.choice(WORDS) for _ in range(n)]
    changed = list(items[3][5:30])
    changed[9] = "something"
    docs = [
        (1, " ".join(noise(30) + items[0][3:20] + noise(10))),
        (2, "<p>" + "</b> ".join(items[1][10:26]).upper().replace("A", "Ａ") + "&nbsp;</p>"),
        (3, " ".join(noise(5) + items[2][0:8] + noise(30))),
        (4, " ".join(noise(5) + changed + noise(5))),
        (5, None),
        (6, ""),
        (7, " ".join(noise(50))),
        (8, " ".join(noise(20_000) + items[4] + noise(20_000))),
    ]
    d = spark.createDataFrame(docs + docs[:1], "doc_id long, text string").selectExpr("*", "doc_id AS item_id")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(90, None), (91, ""), (92, "too short")], "item_id long, text string")
    want = {(1, 0), (2, 1), (4, 3), (8, 4)}
    every = []
    for a_pass in (1, 7 * 250, 10**9):  # one, about seven and all items a pass
        got = leaks.leaked_passages(d, e, chars_a_pass=a_pass).collect()
        assert len(got) == len(want) and {(r.doc_id, r.item_id) for r in got} == want
        every.append({(r.doc_id, r.item_id): r.share for r in got})
    assert every[0] == every[1] == every[2]
    assert leaks.leaked_passages(d.limit(0), e).count() == 0
    assert leaks.leaked_passages(d, e.limit(0)).count() == 0


def test_leaked_japanese(spark):
    item = "試験開始から二時間後、手元の取っ手は外せる底板に耐えたうえに、四個目の取っ手も遅れて届いた。二巡目では太めの布を温めたから段ボールのふたまで遅れて届いた。"
    d = spark.createDataFrame([(1, "前置き。" + item[5:60].replace("、", " ") + "後書き"), (2, item[:20] + "全く別の文章が続いている。")], "doc_id long, text string")
    e = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks.leaked_passages(d, e).collect()] == [(1, 7)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(40, 60))
def test_fill(sizes, capacity):
    bins = packing.fill(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    assert len(bins) <= 2 * (-(-sum(sizes) // capacity)) + 1


def test_pack(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(1, 90)) for i in range(500)] + [(1000, 0), (1001, 100), (1002, 350), (1003, 350)]
    items = spark.createDataFrame(rows, "item long, n_tokens long").selectExpr("*", "'x' AS container")
    caps = spark.createDataFrame([("a", 100), ("b", 256)], "container_kind string, capacity_tokens long")
    for group in (20_000, 60):
        got = packing.pack(items, caps, group=group).collect()
        for kind, c in (("a", 100), ("b", 256)):
            own = [r for r in got if r.container_kind == kind]
            loads, parts = {}, {}
            for r in own:
                loads[r.container] = loads.get(r.container, 0) + r.n_tokens
                parts.setdefault(r.item, []).append(r.n_tokens)
            assert max(loads.values()) <= c
            assert {i: sum(p) for i, p in parts.items()} == {i: n for i, n in rows if n}
            assert all(len(p) == -(-n // c) for i, n in rows if n for p in [parts[i]])
            assert sum(n for _, n in rows) / c / len(loads) > (0.97 if group > 60 else 0.8)
    assert packing.pack(items.limit(0), caps).count() == 0
    assert packing.pack(items, caps.limit(0)).count() == 0
    assert {tuple(r) for r in packing.pack(items, caps, group=60).collect()} == {tuple(r) for r in got}
    many = spark.createDataFrame([(f"k{i}", 100) for i in range(packing.KINDS_A_PASS + 1)], "container_kind string, capacity_tokens long")
    assert packing.pack(items.where("item >= 1000"), many).select("container_kind").distinct().count() == packing.KINDS_A_PASS + 1


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "x" * 100_000), (5, "日本語")], "doc_id long, text string")
    got = {r.item: r.n_tokens for r in packing.token_counts(df).collect()}
    encode = packing.load_encoding(packing.TOKENIZER)
    for r in df.collect():
        ids = encode.encode_ordinary(r.text or "")
        assert got[r.doc_id] == len(ids) and encode.decode(ids) == (r.text or "")
    assert got[2] == got[3] == 0 and got[4] > 1000


def test_fertility(spark):
    import sentencepiece

    from shelfspark.llm import fertility as fe

    rng = random.Random(11)
    ordinary = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(60, 90)))) for i in range(60)]
    odd = [(100, "buy lamp now " * 60), (101, "\U0001f9ff\U0001fae0" * 60 + " lamp"), (102, None), (103, ""), (104, "x" * 50_000), (105, "重いねじが厚手の覆いを温めた")]
    df = spark.createDataFrame(ordinary + odd + ordinary[:1], "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "'z' AS script")
    measured = fe.fertility(df)
    model = sentencepiece.SentencePieceProcessor(model_file=fe.TOKENIZER)
    got = {r.doc_id: r for r in measured.collect()}
    assert measured.count() == len(ordinary) + len(odd) + 1
    for i, text in ordinary + odd:
        ids = model.encode(text or "")
        assert got[i].n_tokens == len(ids) and got[i].byte_share == pytest.approx(sum(map(model.is_byte, ids)) / max(1, len(ids)))
    assert got[105].script == "cjk" and got[0].script == "latin" and got[103].script == "none" and got[101].byte_share > 0.5
    flagged = {r.doc_id: r.rejected for r in fe.outside(measured, fe.bands(measured)).collect()}
    assert "entropy_share" in flagged[100] and "byte_share" in flagged[101] and flagged[102] == [] and sum(bool(flagged[i]) for i, _ in ordinary) <= 3
    assert fe.outside(measured.limit(0), fe.bands(measured.limit(0))).count() == 0
