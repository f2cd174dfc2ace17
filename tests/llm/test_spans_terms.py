"""p1 and p2 against brute force."""

import random
from collections import Counter, defaultdict

import pytest

from inkstone.llm import spans, terms

SCHEMA = "rec_id long, paragraphs array<string>, body string, key long"


def frame(spark, records):
    return spark.createDataFrame([(i, p, "clash", 7) for i, p in records], SCHEMA)


def brute(records, least):
    bodies = {i: "\n".join(e for e in p if e is not None) for i, p in records if i is not None and p is not None}
    held = defaultdict(set)
    for i, b in bodies.items():
        for k in range(len(b) - least + 1):
            held[b[k : k + least]].add(i)
    out = set()
    for i, b in bodies.items():
        on = [False] * (len(b) + 1)
        for k in range(len(b) - least + 1):
            if len(held[b[k : k + least]]) > 1:
                on[k : k + least] = [True] * least
        start = None
        for k, v in enumerate(on):
            if v and start is None:
                start = k
            if not v and start is not None:
                out.add((i, start, k - start))
                start = None
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    alphabet = "春夏秋冬花月𤗀a" if seed else "ab"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [word(rng.randint(20, 60)) for _ in range(6)]
    records = []
    for i in range(120):
        parts = [word(rng.randint(0, 20)) for _ in range(rng.randint(0, 3))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            a = rng.randint(0, 10)
            parts.insert(rng.randint(0, len(parts)), word(5) + s[a:] + word(3))
        if rng.random() < 0.2:
            parts.append(None)
        records.append((i, parts))
    records += records[:10]
    got = [tuple(r) for r in spans.shared_spans(frame(spark, records).repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(records, 24)


@pytest.fixture
def tiny_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 3)
    yield
    spark.conf.set(name, before)


def test_groups_that_go_on_over_batches(spark, tiny_batches):
    line = "一二三四五六七八九十甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳"
    records = [(i, [line * 3 if i % 2 else f"第{i}首" + line, "□" * 40]) for i in range(12)] + [(100, ["x" * 30]), (101, [line[1:]])]
    assert {tuple(r) for r in spans.shared_spans(frame(spark, records).coalesce(1)).collect()} == brute(records, 24)


def test_repeats_are_maximal_and_verbatim(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("春夏秋冬花月風雨山水") for _ in range(n))
    shared = [word(60) for _ in range(5)]
    bodies = {i: word(rng.randint(0, 15)) + rng.choice(shared)[rng.randint(0, 20) :] + word(rng.randint(0, 15)) for i in range(80)}
    found = spans.repeats(frame(spark, [(i, [b]) for i, b in bodies.items()])).collect()
    assert found
    for r in found:
        a, b, s, o, n = bodies[r.rec_id], bodies[r.other_id], r.span_start, r.other_start, r.span_chars
        assert r.rec_id != r.other_id and n >= 24 and a[s : s + n] == b[o : o + n]
        assert s == 0 or o == 0 or a[s - 1] != b[o - 1]
        assert s + n == len(a) or o + n == len(b) or a[s + n] != b[o + n]


def test_extension_stops_where_characters_differ():
    import numpy as np

    points = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    assert spans.extended(points("xxabcdefyy"), points("zabcdefw"), 3, 2, 2) == [(2, 6)]
    assert spans.extended(points("abXdefgh"), points("abYdefgh"), 0, 0, 6) == [(0, 2), (3, 5)]


def test_edges(spark, rows):
    line = "一二三四五六七八九十甲乙丙丁戊己庚辛壬癸子丑寅卯"
    records = [(1, [line]), (2, [line]), (2, [line]), (3, [line[:23]]), (4, None), (5, []), (6, ["", None]), (None, [line]), (7, ["□" * 500]), (7, ["□" * 500]), (8, ["x" * 30 + line + "y" * 5000])]
    df = frame(spark, records)
    assert rows(spans.shared_spans(df)) == [(1, 0, 24), (2, 0, 24), (8, 30, 24)]
    records.append((9, ["□" * 24]))
    assert {(7, 0, 500), (9, 0, 24)} <= set(rows(spans.shared_spans(frame(spark, records))))
    share = {r.rec_id: (r.body_chars, r.shared_chars, r.shared_share) for r in spans.shared_share(df).collect()}
    assert share[1] == (24, 24, 1.0) and share[3] == (23, 0, 0.0) and share[4] == (0, 0, 0.0) and share[6] == (0, 0, 0.0)
    assert spans.shared_spans(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spans.shared_spans(df, 8)


def test_a_third_of_all_records_share_a_passage(spark):
    rng = random.Random(5)
    line = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40))
    records = [(i, [f"{chr(0x5000 + i)}{i}", line if i % 3 == 0 else f"獨{i}" * 12]) for i in range(3000)]
    got = {tuple(r) for r in spans.shared_spans(frame(spark, records)).collect()}
    assert got == brute(records, 24) and len(got) == 1000


def test_terms(spark):
    records = [(1, ["春春夏", None, ""]), (1, ["春春夏", None, ""]), (2, ["春\r　"]), (3, ["春𤗀"]), (4, []), (5, None), (6, [None, ""]), (None, ["冬"]), (7, ["秋" * 10000])]
    df = frame(spark, records)
    got = {r.term: (r.occurrences, r.records, r.collection_records, r.mark) for r in terms.term_counts(df, 1, 0.5).collect()}
    assert got == {"春": (4, 3, 4, "common"), "夏": (1, 1, 4, "rare"), "\r": (1, 1, 4, "rare"), "　": (1, 1, 4, "rare"), "𤗀": (1, 1, 4, "rare"), "秋": (10000, 1, 4, "rare")}
    assert terms.term_counts(df.limit(0)).count() == 0
    exactly = frame(spark, [(i, ["甲" if i < 3 else "乙丙"[i % 2]]) for i in range(15)])
    marks = {r.term: r.mark for r in terms.marked_terms(exactly).collect()}
    assert marks == {"乙": "common", "丙": "common"}  # 甲: 3 of 15 are a fifth, not more


def test_terms_against_counting(spark):
    rng = random.Random(2)
    records = [(i, ["".join(chr(0x4E00 + int(rng.expovariate(0.01))) for _ in range(rng.randint(0, 30))) for _ in range(3)]) for i in range(400)]
    occ, rec = Counter(), Counter()
    for _, p in records:
        occ.update("".join(p))
        rec.update(set("".join(p)))
    got = {r.term: (r.occurrences, r.records) for r in terms.term_counts(frame(spark, records + records[:50]).repartition(6)).collect()}
    assert got == {t: (occ[t], rec[t]) for t in occ}


def test_one_partition_is_settled_batch_by_batch(spark, small):
    """The number of shuffle partitions changes nothing: a task settles its rows batch by batch."""
    from inkstone.llm.queries import queries

    name = "spark.sql.shuffle.partitions"
    before, found = spark.conf.get(name), []
    for n in ("1", "16"):
        spark.conf.set(name, n)
        found.append(sorted(map(tuple, queries()["p1_found"](spark, small).collect())))
    spark.conf.set(name, before)
    assert found[0] == found[1]
