import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import classify as K
from inkstone.operators import corpus as C
from inkstone.operators import stats as S
from inkstone.operators import tokens as V

def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


# What each odd text gives: stripped, pieces between blank lines, sublines, without punctuation.
EXPECTED = {
    "": ("", [], [], ""),
    " ": ("", [], [], ""),
    "　花間　": ("花間", ["花間"], ["花間"], "　花間　"),
    "a\r\nb\rc": ("a\r\nb\rc", ["a\nb\nc"], ["a\r\nb\rc"], "a\r\nb\rc"),
    "𤗀𦅍\n\n\n月": ("𤗀𦅍\n\n\n月", ["𤗀𦅍", "\n月"], ["𤗀𦅍\n\n\n月"], "𤗀𦅍\n\n\n月"),
    "春，夏。秋！冬": ("春，夏。秋！冬", ["春，夏。秋！冬"], ["春", "夏", "秋", "冬"], "春夏秋冬"),
    "\n\n\n": ("", [], [], "\n\n\n"),
    "x\n\n \n\ny": ("x\n\n \n\ny", ["x", "y"], ["x\n\n \n\ny"], "x\n\n\n\ny"),
    "。。": ("。。", ["。。"], [], ""),
    "\x1c甲\x85": ("甲", ["甲"], ["甲"], "\x1c甲\x85"),
}


@pytest.mark.parametrize("s", EXPECTED)
def test_text_functions(spark, s):
    stripped, poems, sublines, bare = EXPECTED[s]
    assert one(spark, T.strip, s) == stripped
    assert one(spark, T.poems, s) == poems
    assert one(spark, T.sublines, s) == sublines
    assert one(spark, lambda c: T.without_punctuation(c), s) == bare
    assert one(spark, T.utf8_size, s) == len(s.encode())
    assert [c for c in one(spark, T.characters, s) if c] == list(s)


@pytest.mark.parametrize("s", ["", "a", "it's", 'say "x"', """both ' and \"""", "tab\tline\nback\\slash\r", "\x00\x1f\x7f\x85\xa0", "　春\u200b", "𤗀\U000e0001 é", "\u2028"])
def test_quoted_like_python(spark, s):
    assert one(spark, T.quoted, s) == repr(s)


def test_url_component(spark):
    assert one(spark, T.url_component, "李 白~!*'()-_.&/") == "%E6%9D%8E%20%E7%99%BD~!*'()-_.%26%2F"
    assert one(spark, lambda c: T.padded(c, 6), "bing") == "  bing"
    assert one(spark, lambda c: T.padded(c, 2), "bing") == "bing"
    assert one(spark, T.escape_newlines, "a\nb") == "a\\nb"


def test_corpus_basics(spark):
    df = spark.createDataFrame([(1, "ab\ncd\n\nef"), (2, None), (3, ""), (4, " \n\n ")], "doc_id long, text string")
    r = S.corpus_basics(df).first()
    assert (r.bytes, r.poems, r.lines, r.chars, r.lines_per_poem, r.chars_per_line) == (13, 2, 3, 6, 1.5, 2.0)
    r = S.corpus_basics(df.limit(0)).first()
    assert (r.bytes, r.poems, r.lines, r.chars, r.lines_per_poem, r.chars_per_line) == (0, 0, 0, 0, 0.0, 0.0)


def test_top_n_ties_by_first_place(spark):
    df = spark.createDataFrame([(2, "aaa\nb"), (1, "bb\ncc\ndddd")], "doc_id long, text string")
    got = [(r.length, r.freq) for r in S.top_n(S.line_lengths(df), 2).collect()]
    assert got == [(2, 2), (4, 1)]


def test_export_summary_with_null_source(spark, rows):
    df = spark.createDataFrame([("f", ["a"]), ("f", []), ("g", None), (None, ["b"])], "source_file string, paragraphs array<string>")
    got = {(r.source_file, r.is_total): (r.scanned, r.exported, r.skipped) for r in S.export_summary(df).collect()}
    assert got == {("f", 0): (2, 1, 1), ("g", 0): (1, 0, 1), ("", 0): (1, 1, 0), (None, 1): (4, 2, 2)}


#: Lengths of the sublines of a record, and its reason.
SHAPES = [
    ((5, 5, 5, 5), "passed"),
    ((7,) * 4, "passed"),
    ((5,) * 8, "passed"),
    ((7,) * 8, "passed"),
    ((6,) * 4, "uniform_but_not_5_or_7"),
    ((1,) * 8, "uniform_but_not_5_or_7"),
    ((5, 5, 5, 7), "mixed_subline_lengths"),
    ((7, 5) * 4, "mixed_subline_lengths"),
    ((5,) * 3, "not_4_or_8_sublines"),
    ((5,) * 5, "not_4_or_8_sublines"),
    ((7,) * 9, "not_4_or_8_sublines"),
    ((), "empty_paragraphs"),
]


@pytest.mark.parametrize("seed", range(4))
def test_classifier_on_made_up_records(spark, seed):
    """Records are built from the lengths of their sublines, so the reason is known beforehand."""
    rng = random.Random(seed)
    records, reasons = [], []
    for _ in range(40):
        shape, reason = rng.choice(SHAPES)
        paragraphs, line = [], ""
        for n in shape:
            inner = rng.choice(["", "（", "《", " "])  # counts towards no length
            line += rng.choice(["", "　", "，"]) + "春" * (n - 1) + inner + "夏" + rng.choice("，。！？；：、")
            if rng.random() < 0.4:
                paragraphs.append(line)
                line = ""
            if rng.random() < 0.2 and not line:
                paragraphs.append(rng.choice([None, "", "。", " "]))
        paragraphs += [line] if line else []
        records.append(paragraphs if shape else rng.choice([None, []]))
        reasons.append(reason)
    records += [[None], ["。", " "], ["甲乙，乙，丙，丁"]]
    reasons += ["not_4_or_8_sublines", "not_4_or_8_sublines", "mixed_subline_lengths"]
    df = spark.createDataFrame(list(enumerate(records)), "rec_id long, paragraphs array<string>")
    got = dict(K.classify(df).select("rec_id", "reason").collect())
    assert got == dict(enumerate(reasons))


def test_classifier_summaries(spark):
    five, seven = ["春夏秋冬年，" * 4], ["春夏秋冬年月日，" * 8]
    df = spark.createDataFrame([("f", five), ("f", []), ("g", seven), ("f", ["一"])], "source_file string, paragraphs array<string>")
    c = K.classify(df)
    assert {r.source_file: (r.total, r.passed, r.rejections) for r in K.source_summary(c).collect()} == {"f": (3, 1, {"empty_paragraphs": 1, "not_4_or_8_sublines": 1}), "g": (1, 1, {})}
    assert dict(K.passed_by(c, "num_sublines").collect()) == {4: 1, 8: 1}
    assert dict(K.rejection_counts(c).collect()) == {"empty_paragraphs": 1, "not_4_or_8_sublines": 1}
    assert K.classify(df.limit(0)).count() == 0


# Sizes with separators: 花月 6, ab 10, 一二三 21, c 24, 日落西山 38, x 41.
@pytest.mark.parametrize(("target", "kept"), [(0, 0), (3, 0), (4, 1), (6, 1), (8, 1), (9, 2), (10, 2), (15, 2), (16, 3), (21, 3), (23, 4), (31, 4), (32, 5), (40, 6), (41, 6), (1000, 6)])
def test_subset_by_bytes(spark, target, kept):
    texts = ["花月", "ab", "一二三", "c", "日落西山", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in C.subset_by_bytes(df, [("t", target)]).collect())
    assert got == list(range(kept))


def test_blocks_and_windows(spark):
    texts = ["春眠不覺曉", "", "a", "處處聞啼鳥夜來風雨聲", "花落知多少"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    corpus = "\n\n".join(texts)
    blocks = C.corpus_blocks(df, 4)
    assert "".join(t for _, t in sorted(map(tuple, blocks.collect()))) == corpus
    starts = spark.createDataFrame([(i,) for i in range(len(corpus) + 3)], "start long")
    expected = {s: (corpus[s : s + 4], corpus[s + 1 : s + 5]) for s in range(len(corpus) - 4)}
    for stretch in (3, 1 << 16):
        got = {r.start: (r.x, r.y) for r in C.windows(df, starts, 4, stretch=stretch).collect()}
        assert got == expected
    assert C.windows(df.limit(0), starts, 4).count() == 0


def test_pairs_of_the_joined_corpus(spark):
    texts = ["ab", "", None, "ba", "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    corpus = "\n\n".join(t for t in texts if t is not None)
    assert {(r.x, r.y): r.n for r in V.bigram_counts(df).collect()} == Counter(zip(corpus, corpus[1:], strict=False))
    assert V.bigram_counts(df.limit(0)).count() == 0
    one_ = df.where("doc_id = 0")
    assert [tuple(r) for r in V.bigram_counts(one_).collect()] == [("a", "b", 1)]


def test_numbered(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 as v").repartition(7)
    got = {r.v: r.pos for r in S.numbered(df, F.desc("v")).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got, reverse=True))}
    assert S.numbered(df.limit(0), F.desc("v")).count() == 0


def test_distribution_counts(spark):
    texts = ["a\nbb\n\nccc", "dd\n\n\nee"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = [x for t in texts for p in t.split("\n\n") if p.strip() for x in p.split("\n") if x.strip()]
    assert {r.length: r.freq for r in S.line_lengths(df).collect()} == Counter(map(len, lines))
