"""Packed values (p4) and per-key totals under skew (p6)."""

import random
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.operators import heavy_keys as H
from inkstone.operators.packed_values import SEPARATORS, split_values, tokenize


@pytest.mark.parametrize(
    ("text", "places"),
    [
        ("a|b", ["a", "b"]),
        ("a||b|", ["a", "", "b", ""]),
        ("a / 　b\t;c", ["a", "b", "", "c"]),
        ("a\r\nb\nc", ["a", "b", "c"]),
        ("'a|b'|c", ["a|b", "c"]),
        (' "a""b" ; "c\\"|d" ', ['a"b', 'c"|d']),
        ("'a''|b'¦c", ["a'|b", "c"]),
        ("'a|b", ["'a", "b"]),
        ("'a'b|c", ["'a'b", "c"]),
        ("春（一作甲|乙）|夏", ["春（一作甲|乙）", "夏"]),
        ("春（一(二|三)四/五）/夏", ["春（一(二|三)四/五）", "夏"]),
        ("春（一|夏", ["春（一", "夏"]),
        ("春（一|二)|夏", ["春（一|二)", "夏"]),
        ('""|a|b', ["", "a", "b"]),
        ("a\\|b", ["a\\", "b"]),
        ("春，夏。", ["春，夏。"]),
        ("a\rb|c", ["a\rb", "c"]),
        ("", [""]),
        (" ", [""]),
    ],
)
def test_tokenize(text, places):
    assert tokenize(text) == places


@pytest.mark.parametrize("text", ["(a|" * 50_000, "'a|" * 50_000, '"(|' * 50_000, "(|)" * 50_000])
def test_unclosed_signs_take_no_longer_than_others(text):
    began = time.time()
    assert tokenize(text) and time.time() - began < 2


PART = st.text("春夏，。ab （）()\"'\\" + SEPARATORS, max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(PART, min_size=1, max_size=6), st.lists(st.sampled_from(SEPARATORS), min_size=6, max_size=6), st.sampled_from("\"'"))
def test_quoting_round_trip(values, separators, quote):
    text = "".join(f"{quote}{v.replace(quote, quote * 2) if not v.endswith(chr(92)) else ''}{quote}{s}" for v, s in zip(values, separators, strict=False))
    values = [v if not v.endswith("\\") else "" for v in values]
    if any("\\" in v for v in values):
        return  # a backslash before a quote escapes it
    assert tokenize(text)[:-1] == [v.strip() for v in values]


def test_split_values_rows(spark, rows):
    data = [
        (1, ["一|二", None, "", "三；四", " 五 / '六/七' / 八 "], "x"),
        (1, ["一|二", None, "", "三；四", " 五 / '六/七' / 八 "], "y"),
        (2, None, "x"),
        (3, [], "x"),
        (None, ["a|b"], "x"),
        (4, ["a||", "|", "注（甲|乙）"], "x"),
        (5, ["a|" * 3000 + "b"], "x"),
    ]
    df = spark.createDataFrame(data, "rec_id long, paragraphs array<string>, value string")
    got = rows(split_values(df))
    assert [r for r in got if r[0] < 5] == [(1, 0, 0, "一"), (1, 0, 1, "二"), (1, 4, 0, "五"), (1, 4, 1, "六/七"), (1, 4, 2, "八")]
    assert len([r for r in got if r[0] == 5]) == 3001
    assert split_values(df.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [1, 7, None])
def test_key_totals(spark, blocks):
    rng = random.Random(1)
    data = []
    for i in range(2000):
        key = rng.choice(["熱"] * 6 + [None, "", *map(str, range(40))])
        data.append((i, key, "同", rng.choice([None, *range(5)])))
    data += data[:300] + [(None, "熱", "同", 5)]
    df = spark.createDataFrame(data, "rec_id long, a string, b string, n long").repartition(5)
    n, total = Counter(), Counter()
    for _, key, b, v in data[:2000]:
        for f, k in (("a", key), ("b", b)):
            if k is not None:
                n[f, k] += 1
                total[f, k] += v or 0
    got = {(r.key_field, r.key_value): (r.records, r.n) for r in H.key_totals(df, ["a", "b"], ["n"], blocks=blocks).collect()}
    assert got == {k: (n[k], total[k]) for k in n}
    heavy = {tuple(r) for r in H.heavy_keys(df, ["a", "b"], percent=5, blocks=blocks).collect()}
    assert heavy == {k for k, v in n.items() if v * 100 >= 2000 * 5}


def test_more_keys_than_a_split_holds(spark, monkeypatch):
    monkeypatch.setattr(H, "_HELD", 1000)
    big = 1 << 60
    df = spark.range(30_000).selectExpr("id as rec_id", "cast(id % 20000 as string) as a", f"{big} + id as n").repartition(3)
    got = {r.key_value: (r.records, r.n) for r in H.key_totals(df, ["a"], ["n"], blocks=2).collect()}
    assert got == {str(i): (2, 2 * big + 2 * i + 20000) if i < 10000 else (1, big + i) for i in range(20000)}


def test_key_totals_of_nothing(spark):
    df = spark.createDataFrame([], "rec_id long, a string")
    assert H.key_totals(df, ["a"]).count() == 0 and H.heavy_keys(df, ["a"]).count() == 0
    nulls = spark.createDataFrame([(1, None)], "rec_id long, a string")
    assert H.key_totals(nulls, ["a"]).count() == 0


def test_a_tie_at_the_threshold_counts(spark):
    df = spark.createDataFrame([(i, "k" if i == 0 else f"v{i}") for i in range(50)], "rec_id long, a string")
    assert H.heavy_keys(df, ["a"], percent=2).count() == 50
