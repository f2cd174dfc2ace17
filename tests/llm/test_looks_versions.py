"""p3 and p5: spellings and versions."""

import itertools
import random

import numpy as np
import pytest

import golay
from inkstone.llm import expand, versions
from inkstone.llm import lookalike as L

SAME = [
    ("力更，老。", "カ更,⽼｡"),
    ("來", "來"),
    ("（音ｙuè）", "(音yuè)"),
    ("a b", "a　b"),
    ("a b", "a b"),
    ("春​夏﻿­͏︎", "春夏"),
    (" 春夏\r", "　春夏"),
    ("ΡХ", "PX"),
    ("ｴ", "工"),
    ("﹖﹗", "？!"),
    ("ガ", "ガ"),
    ("…", "..."),
    ("a\r\nb", "a\nb"),
]
SAME += [("v", "ν"), ("i", "ι"), ("o", "օ"), ("A", "Ꭺ"), ("l", "ⅼ"), ("-", "‐"), ("・", "·"), ("—", "―"), ("○", "〇"), ("a", "ɑ"), ("v", "ѵ"), ("VIII", "Ⅷ"), ("fi", "ﬁ"), ("∶", ":")]
DIFFERENT = [("1", "l"), ("I", "l"), ("0", "O"), ("m", "rn"), ("“", "”"), ("〔", "("), ("ǎ", "ă"), ("土", "士"), ("A", "𝐀"), ("絶", "絕"), ("—", "一"), ('"', "''"), ("1", "⑴"), ("1", "①"), ("1", "¹"), ("e", "è"), ("è", "ē"), ("鄰", "隣"), ("，", "。"), ("ab", "a b"), ("a", "A"), ("|", "¦"), ("来", "來"), ("カ", "ガ")]


@pytest.fixture(scope="module")
def look(spark):
    return L.Look(L.prototypes(spark))


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(look, a, b):
    assert look.skeleton(a) == look.skeleton(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_look(look, a, b):
    assert look.skeleton(a) != look.skeleton(b)


@pytest.mark.parametrize("text", [x for p in SAME + DIFFERENT for x in p] + ["", " ​ "])
def test_spelling_is_stable(look, text):
    assert look.skeleton(look.skeleton(text)) == look.skeleton(text) == look.skeleton(look.readable(text))


def test_every_character_is_spelt_stably(look):
    for p in range(0x21, 0x110000):
        if not 0xD800 <= p < 0xE000 and look.skeleton(chr(p)) != chr(p):
            once = look.skeleton(f"x{chr(p)}x")
            assert look.skeleton(once) == once, hex(p)


def test_pairs_and_spelling(spark, rows):
    data = [(1, ["春，", "夏"]), (2, ["春,", "夏"]), (2, ["春,", "夏"]), (3, ["春，", "夏"]), (4, ["春，夏"]), (5, ["春，", "夏 "]), (6, []), (7, None), (8, [" ", None]), (9, ["​", ""]), (None, ["春,", "夏"]), (10, ["x", None]), (11, ["x", ""])]
    df = spark.createDataFrame([(i, p, "x", "y") for i, p in data], "rec_id long, paragraphs array<string>, look string, spelling string")
    assert sorted(rows(L.same_look_pairs(df))) == [(1, 2), (1, 5), (2, 3), (2, 5), (3, 5), (10, 11)]
    spelt = {r.rec_id: (r.spelling, r.look) for r in L.consistent_spelling(df).collect()}
    assert spelt[1] == spelt[2] and spelt[8] == ([""] + [None], None) and spelt[6] == ([], None) and 7 not in spelt
    assert L.same_look_pairs(df.limit(0)).count() == 0


def test_copies_of_one_spelling_are_never_paired(spark):
    data = [(i, ["同樣的詩"]) for i in range(3000)] + [(9000, ["同樣的詩 "])]
    df = spark.createDataFrame(data, "rec_id long, paragraphs array<string>")
    assert L.same_look_pairs(df).count() == 3000


def test_golay_words_within_two_errors_share_a_codeword():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000).astype(np.uint32)
    keys = golay.nearby(words)
    assert (keys[:, 0] == golay.nearest(words)).all()
    for k in (1, 2):
        other = words.copy()
        for row, places in enumerate(rng.permuted(np.tile(np.arange(23), (len(words), 1)), axis=1)[:, :k]):
            for p in places:
                other[row] ^= np.uint32(1 << p)
        more = golay.nearby(other)
        assert ((keys[:, :, None] == more[:, None, :]) & (keys[:, :, None] >= 0)).any((1, 2)).all()
    assert set(np.unique((keys >= 0).sum(1))) <= {1, 6}


SCHEMA = "rec_id long, title string, paragraphs array<string>, pairs string, class long"


def brute(records, least=0.5):
    sets, look = {}, L.Look({})  # these texts hold no look-alikes
    for i, t, p in records:
        if i is not None and p and any(look.skeleton(e or "") for e in p):
            s = versions.bare(look, t, p)
            sets[i] = {s[k : k + 2] for k in range(len(s) - 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def poems(n, seed):
    rng = random.Random(seed)
    line = lambda k: "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(k))
    records = []
    for i in range(n):
        if records and rng.random() < 0.5:
            _, t, p = rng.choice(records)
            p = list(p)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(p))
                c = list(p[k])
                c[rng.randrange(len(c))] = rng.choice(["", line(1), line(2)])
                p[k] = "".join(c) or "空"
            if rng.random() < 0.3:
                rng.shuffle(p)
            records.append((i, t if rng.random() < 0.7 else line(3), p))
        else:
            records.append((i, line(4), [line(rng.choice((5, 7))) for _ in range(rng.choice((4, 8)))]))
    return records


def test_versions_against_all_pairs(spark):
    records = poems(400, 3)
    expected = brute(records)
    df = spark.createDataFrame([(*r, "x", 1) for r in records + records[:30]], SCHEMA)
    got = [tuple(r) for r in versions.version_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= expected
    assert len(got) >= 0.99 * len(expected) > 100


def test_version_edges(spark, rows):
    p = ["春眠不覺曉處處聞啼鳥", "夜來風雨聲花落知多少"]
    records = [(1, None, p), (2, "", p), (2, "", p), (3, "題", p), (4, "題", None), (5, "題", []), (6, "題目甲乙", [" ", None]), (7, None, ["春"]), (8, None, ["春"]), (None, "題", p), (9, None, ["，。"])]
    df = spark.createDataFrame([(*r, "x", 1) for r in records], SCHEMA)
    assert rows(versions.version_pairs(df)) == [(1, 2), (1, 3), (2, 3)]
    groups = {r.rec_id: (r.class_id, r.group_id, r.links) for r in versions.version_groups(df).collect()}
    assert groups == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 1, 1)}
    assert versions.version_pairs(df.limit(0)).count() == 0


def test_many_copies_form_one_class(spark):
    p = ["白日依山盡黃河入海流"]
    df = spark.createDataFrame([(i, "t", p, "x", 1) for i in range(2000)] + [(5000, "t", ["白日依山盡黃河入海留"], "x", 1)], SCHEMA)
    g = versions.version_groups(df).groupBy("class_id", "group_id", "links").count().collect()
    assert sorted(map(tuple, g)) == [(0, 0, 1, 2000), (5000, 0, 1, 1)]


def near(seed, lowest, unions=(20, 40, 60, 80), each=40):
    """Records in twos: a common text and an end of its own each, so that the similarity is from `lowest` to lowest + 0.05."""
    rng = random.Random(seed)
    records = []
    for union, k in itertools.product(unions, range(each)):
        common = -(-int(lowest * 1000) * union // 1000) + k % (union // 20 + 1)
        text = "".join(map(chr, rng.sample(range(0x4E00, 0x9F00), union + 1)))
        for end in (text[common + 1 : common + 1 + k % (union - common)], text[common + 1 + k % (union - common) :]):
            records.append((len(records), None, [text[: common + 1], end]))
    return records


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_versions_at_other_thresholds_are_whole(spark, least):
    records = near(1, least, each=20)
    expected = brute(records, least)
    assert len(expected) >= len(records) / 2
    got = [tuple(r) for r in versions.version_pairs(spark.createDataFrame([(*r, "x", 1) for r in records], SCHEMA), least).collect()]
    assert sorted(got) == sorted(expected)


def test_versions_near_the_threshold_are_whole(spark):
    records = near(2, 0.5)
    expected = brute(records)
    assert len(expected) >= len(records) / 2
    got = [tuple(r) for r in versions.version_pairs(spark.createDataFrame([(*r, "x", 1) for r in records], SCHEMA)).collect()]
    assert sorted(got) == sorted(expected)


def test_short_versions(spark, rows):
    texts = ["春眠", "春眠不", "春眠不覺", "眠不覺", "日山河海", "日山河海流", "日山河海入流", "甲乙丙", "甲乙丁戊"]
    records = [(i, None, [t]) for i, t in enumerate(texts)]
    expected = brute(records)
    assert {(0, 1), (1, 2), (2, 3), (4, 5)} <= expected
    assert rows(versions.version_pairs(spark.createDataFrame([(*r, "x", 1) for r in records], SCHEMA))) == sorted(expected)


@pytest.mark.parametrize(("a", "b"), [("⺅⺡⻄⻢⻳", "亻氵西马龟"), ("⻏⻖", "阝阝"), ("yuɑnɡ", "yuang"), ("ɑ̄", "ā"), ("Ӏӏ", "Il")])
def test_radicals_supplement_and_latin_letters(look, a, b):
    assert look.skeleton(a) == look.skeleton(b) and look.readable(a) == b
    assert look.skeleton(look.skeleton(a)) == look.skeleton(a)


@pytest.mark.parametrize("group", [2, 7])
def test_a_frequent_pair_is_split_into_chunks(spark, group):
    """All texts share their beginning; with groups this small every key is split."""
    records = [(i, None, ["甲乙丙丁" + "".join(map(chr, random.Random(i // 3).sample(range(0x4E00, 0x9F00), 6))) + "春夏秋冬"[i % 3 : i % 3 + 2]]) for i in range(60)]
    expected = brute(records)
    sets = versions.text_sets(spark.createDataFrame([(*r, "x", 1) for r in records], SCHEMA))
    members, links = versions.similar_classes(sets, 0.5, group)
    got = [tuple(r) for r in links.collect()]
    assert members.count() == 60 and len(got) == len(set(got)) and set(got) == expected


def test_expanded_pairs(spark):
    members = [("a", i) for i in range(30)] + [("b", i) for i in range(100, 150)] + [("c", 7000)]
    df = spark.createDataFrame(members, "group string, rec_id long")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "c"), ("c", "c")], "a string, b string")
    got = [tuple(r) for r in expand.expand_pairs(pairs, df, chunk=8).collect()]
    expected = set(itertools.combinations(range(30), 2)) | set(itertools.product(range(30), range(100, 150))) | {(i, 7000) for i in range(100, 150)}
    assert len(got) == len(set(got)) and set(got) == expected
