"""p7 against a public library, p8 by its invariants."""

import base64
import random
from pathlib import Path

import numpy as np
import pytest

from inkstone.llm import bpe, packing
from inkstone.llm.perfect_hash import PerfectHash

tiktoken = pytest.importorskip("tiktoken")
if not Path(bpe.FOLDER, "byte_bpe_50k.tiktoken").exists():
    pytest.skip("no vocabulary files here", allow_module_level=True)


@pytest.fixture(scope="module")
def reference():
    lines = Path(bpe.FOLDER, "byte_bpe_50k.tiktoken").read_bytes().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(0)
    pools = ["abcdefghij klmnop'st ", "春夏秋冬月花水風 ，。\n", "あいうえおアイ漢字", "가나다라 마바", "абвгд ежз", " \n\t\r  ", "0123456789", "!?.,;:—…“”", "🍂😀𤗀é́", "<|endoftext|>"]
    out = ["", " ", "\n\n", "a", "<|endoftext|>", "□" * 700, "ab" * 400, "word " * 300, "  x  y\n \n z ", "don't I'll we've"]
    out += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 300))) for _ in range(200)]
    out += ["".join(rng.choice(p) for _ in range(rng.randint(1, 150))) for p in pools for _ in range(10)]
    return out


def test_ids_equal_the_public_library(reference):
    v, t = bpe.vocabulary(), texts()
    ids, count = v.encode(t)
    got = np.split(ids, np.cumsum(count)[:-1])
    for a, b in zip(t, got, strict=True):
        assert b.tolist() == reference.encode_ordinary(a), a[:40]
        assert reference.decode(b.tolist()) == a


def plain_merge(ranks, word):
    """The pair of least rank first, the leftmost of equal ones."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_where_a_later_pair_ranks_first():
    """Small made-up vocabularies, in which merging a pair often forms one of lower rank."""
    for seed in range(60):
        rng = random.Random(seed)
        more = {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(40)}
        tokens = [bytes([i]) for i in range(256)] + rng.sample(sorted(more), len(more))
        ranks = {t: i for i, t in enumerate(tokens)}
        v = bpe.Vocabulary(ranks)
        words = ["".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(80)] + ["a" * k for k in range(1, 40)]
        ids, count = v.encode(words)
        for w, got in zip(words, np.split(ids, np.cumsum(count)[:-1]), strict=True):
            assert got.tolist() == ([ranks[w.encode()]] if w.encode() in ranks else plain_merge(ranks, w.encode())), (seed, w)


@pytest.mark.parametrize("length", [31, 32, 95, 96, 97, 98, 300, 20000])
def test_pretokens_of_any_length_take_one_path(reference, length):
    v, rng = bpe.vocabulary(), random.Random(length)
    t = ["".join(rng.choices(pool, k=length // len(pool[0].encode()) + 1)) for pool in ("abcdefghij", "春夏秋冬月花水風", "□", "ab", "😀🍂", "=", "абвгд")]
    ids, count = v.encode(t)
    for a, b in zip(t, np.split(ids, np.cumsum(count)[:-1]), strict=True):
        assert b.tolist() == reference.encode_ordinary(a), a[:30]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    h = PerfectHash(keys, np.arange(len(keys), dtype=np.int32))
    assert (h.find(keys, -1) == np.arange(len(keys))).all()
    assert sorted(h._slots(keys)) == list(range(len(keys)))
    assert (h.find(keys[:50] + np.uint64(1), -1) == -1).sum() >= 49
    assert PerfectHash(keys[:1], np.array([4], np.int32)).find(keys[:2], -1).tolist() == [4, -1]


def test_encode_texts(spark, reference):
    data = [(1, "春眠", "k"), (2, None, "k"), (3, "", "k"), (None, "x y", "k"), (1, "春眠", "k"), (4, "long " * 50000, "k")]
    df = spark.createDataFrame(data, "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode_texts(df).collect()), key=repr)
    assert got == sorted(((i, reference.encode_ordinary(t or "")) for i, t, _ in data), key=repr)
    assert sorted(((r.doc_id, r.n_tokens) for r in bpe.token_counts(df).collect()), key=repr) == sorted(((i, len(x)) for i, x in got), key=repr)
    assert bpe.encode_texts(df.limit(0)).count() == 0
    back = sorted(((r.doc_id, r.text) for r in bpe.decode_ids(bpe.encode_texts(df)).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t, _ in data), key=repr)
    odd = spark.createDataFrame([(1, None), (2, []), (3, bpe.vocabulary().of_byte[[0xE6, 0x98]].tolist())], "doc_id long, ids array<int>")
    assert dict(bpe.decode_ids(odd).collect()) == {1: None, 2: "", 3: "\ufffd"}


def plain_best_fit(sizes, capacity):
    free, out = [], []
    for s in sizes:
        fits = [(f, -i) for i, f in enumerate(free) if f >= s and f > 0]
        if fits:
            f, i = min(fits)
            out.append(capacity - f)
            free[-i] -= s
        else:
            out.append(0)
            free.append(capacity - s)
    return out, free


def test_best_fit_equals_the_plain_one():
    rng = random.Random(3)
    sizes = [rng.randint(0, 50) for _ in range(500)]
    fit = packing.BestFit(50, 10_000)
    bins = {}
    for s in sizes:
        b, at = fit.put(s)
        assert at == bins.get(b, 0)
        bins[b] = at + s
    assert max(bins.values()) <= 50
    assert sorted(bins.values()) == sorted(50 - f for f in plain_best_fit(sizes, 50)[1])


def test_bounded_space_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.put(s)[0] for s in (4, 7, 8)] == [0, 1, 2]  # bin 1 closes
    assert fit.put(3)[0] == 0 and len(fit.still_open()) == 2


def test_plain_online_packing(spark):
    """Without look-ahead and joining, the places are those of items offered one by one."""
    df = spark.createDataFrame([(i, random.Random(i).randint(1, 50)) for i in range(700)], "doc_id long, n_tokens long")
    out = packing.pack_sequences(df, capacity=50, most_open=8, look_ahead=0, join_open=False)
    splits = {}
    for r in out.collect():
        splits.setdefault(r.seq_id >> 32, []).append(r)
    fit = {s: packing.BestFit(50, 8) for s in splits}
    for s, rows in splits.items():
        assert [(r.seq_id & 0xFFFFFFFF, r.seq_offset) for r in rows] == [fit[s].put(r.n_tokens) for r in rows]
    assert tuple(packing.packing_faults(out, df, capacity=50).first()) == (700, 0, 0, 0, 0)


def test_faults_are_seen(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 5), (3, 20), (4, 3)], "doc_id long, n_tokens long")
    packed = spark.createDataFrame([(1, 2, 0, 0), (1, 3, 1, 0), (2, 4, 1, 2), (3, 12, 2, 0), (3, 8, 3, 3)], "doc_id long, n_tokens long, seq_id long, seq_offset long")
    assert tuple(packing.packing_faults(packed, sizes, capacity=10).first()) == (4, 2, 1, 2, 1)


@pytest.mark.parametrize("parts", [1, 7])
def test_packing_is_whole(spark, parts):
    rng = random.Random(4)
    sizes = [(i, rng.choice([0, None, 1, 64, 65, 128, 700, *(rng.randint(1, 64) for _ in range(20))])) for i in range(3000)] + [(None, 5), (7, 9)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").repartition(parts)
    out = packing.pack_sequences(df, capacity=64, most_open=16).collect()
    per, used = {}, {}
    for r in out:
        per.setdefault(r.doc_id, []).append((r.piece, r.piece_start, r.n_tokens))
        used.setdefault(r.seq_id, []).append((r.seq_offset, r.n_tokens))
    for i, n in sizes[:7] + sizes[8:3000]:
        pieces = sorted(per[i])
        assert sum(p[2] for p in pieces) == (n or 0) and len(pieces) == max(1, -(-(n or 0) // 64))
        assert [p[1] for p in pieces] == [64 * k for k in range(len(pieces))]
    assert len(per[7]) >= 2 and per[None] == [(0, 0, 5)]
    for places in used.values():
        at = 0
        for off, n in sorted(p for p in places if p[1]):
            assert off == at
            at += n
        assert at <= 64
    total = sum(n or 0 for _, n in sizes)
    assert len(used) <= 1.05 * total / 64 + 2
    assert packing.pack_sequences(df.limit(0)).count() == 0
    fill = packing.sequence_fill(packing.pack_sequences(df, capacity=64), 64).collect()
    assert sum(r.used for r in fill) == total and all(r.used + r.free == 64 for r in fill)
