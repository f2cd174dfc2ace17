import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.plans import reference
from inkstone.operators import decoding as D
from inkstone.operators import metrics as M
from inkstone.operators import model as N
from inkstone.operators import rank as R
from inkstone.operators import tokens as V
from inkstone.operators.components import connected_components


def test_vocabulary_round_trip(spark):
    texts = ["花月\n", "", "𤗀a花", "é́"]
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    vocab = V.char_vocab(df)
    chars = sorted(set("".join(texts)))
    assert [r.ch for r in vocab.orderBy("id").collect()] == chars
    ids = V.encode(df, vocab)
    assert dict(ids.collect()) == {i: [chars.index(c) for c in t] for i, t in enumerate(texts)}
    assert dict(V.decode(ids, vocab).collect()) == dict(enumerate(texts))
    few = vocab.where("ch <> '月'")
    with pytest.raises(Exception, match="not found in vocabulary"):
        V.encode(df, few).collect()
    assert len(dict(V.encode(df, few, strict=False).collect())[0]) == 2
    art = V.vocab_artefact(vocab, "x.txt").first()
    assert art.vocab_size == len(chars) and art.itos["0"] == chars[0] and art.stoi[chars[-1]] == len(chars) - 1


def test_batch_plan_draws_in_order():
    rng, expected = random.Random(42), []
    for step in range(1, 7):
        expected += [(step, "train", 0, b, rng.randint(0, 100 - 8 - 1)) for b in range(3)]
        if step % 3 == 0:
            expected += [(step, "val", k, b, rng.randint(0, 40 - 8 - 1)) for k in range(2) for b in range(3)]
    assert V.batch_plan(100, 40, 8, 3, 1, 6, eval_every=3, eval_batches=2) == expected
    assert V.batch_plan(100, 40, 8, 3, 4, 4, eval_every=3)[0][4] == random.Random(42).randint(0, 91)
    with pytest.raises(ValueError):
        V.batch_plan(100, 40, 8, 3, 7, 6)
    with pytest.raises(ValueError):
        V.batch_starts(9, 8, 1, 1)
    assert V.batch_starts(10, 8, 1, 1)[0][2] in (0, 1)


def test_small_parts(spark):
    assert V.first_start(9, 8) == 0
    with pytest.raises(ValueError):
        V.first_start(8, 8)
    df = spark.createDataFrame([([1, 2],)], "ids array<int>")
    assert df.select(V.long_ids(F.col("ids")).alias("x")).dtypes == [("x", "array<bigint>")]
    assert df.select(M.step_line(F.lit(7), F.lit(1.5))).first()[0] == "Step 00007: 1.500000"


def test_batches_and_preview(spark):
    w = spark.createDataFrame([(1, 1, "b", "B"), (1, 0, "a", "A"), (2, 0, "c", "C")], "step int, row int, x string, y string")
    assert {r.step: (r.x, r.y) for r in V.batch_rows(w, ["step"]).collect()} == {1: (["a", "b"], ["A", "B"]), 2: (["c"], ["C"])}
    ids = spark.createDataFrame([(i, i * 10) for i in range(20)], "pos long, id int")
    r = V.encoded_preview(ids, "abcdefghij" * 2, 15, first=4, each=3).first()
    assert (r.first_chars, r.first_encoded_ids, r.train_preview_ids, r.val_preview_ids) == ("abcd", [0, 10, 20, 30], [0, 10, 20], [150, 160, 170])


@pytest.mark.parametrize(
    ("engine", "html", "n"),
    [
        ("baidu", "<b>百度为您找到相关结果约1,234个</b>百度为您找到相关结果约9个", 1234),
        ("so360", "<script>找到相关结果约7个</script>找到相关结果约12,000个", 12000),
        ("so360", "<script>找到相关结果约7个</style></script>", 0),
        ("google", "About 1,000 results", 1000),
        ("bing", "<span>5,000 RESULTS</span>", 5000),
        ("bing", '<script a="b">\n>9 results</span>\n</script>', 0),
        ("bing_en", "<script>>9 results</span></script>", 9),
        ("baidu", None, 0),
        ("baidu", "", 0),
    ],
)
def test_result_count(spark, engine, html, n):
    assert spark.createDataFrame([(html,)], "h string").select(R.result_count(F.col("h"), engine)).first()[0] == n


def test_low_counts_and_zeros(spark):
    df = spark.createDataFrame([("f", 0, 0, 201, 300, 200, None), ("f", 1, 100, 200, None, None, 500), ("g", 0, 101, 201, 201, 201, 501)], "source_file string, rec_pos int, baidu long, so360 long, bing long, bing_en long, google long")
    got = {(r.engine, r.source_file): r.low for r in R.low_counts(df).collect()}
    assert got == {("baidu", "f"): 2, ("so360", "f"): 1, ("bing", "f"): 1, ("google", "f"): 1}
    assert [(r.source_file, r.rec_pos) for r in R.any_zero(df).collect()] == [("f", 0)]


LONG = "source_file string, rec_pos int, author string, rhythmic string, engine string, n long"


def test_merge_needs_all_engines_and_checks(spark, rows):
    full = [("f", p, "a", "r", e, p + k) for p in (0, 1) for k, e in enumerate(("baidu", "so360", "bing", "bing_en", "google"))]
    full = [r for r in full if r[1:2] + r[4:5] != (1, "so360")]
    part = [("g", 0, "a", "r", e, 1) for e in ("baidu", "so360", "bing_en")]
    got = rows(R.merge_engines(spark.createDataFrame(full + part, LONG)))
    assert got == [("f", 0, "a", "r", 0, 1, 2, 3, 4), ("f", 1, "a", "r", 1, None, 3, 4, 5)]
    torn = spark.createDataFrame([*full, ("f", 0, "z", "r", "google", 4)], LONG)
    with pytest.raises(Exception, match="bad info f at 0"):
        R.merge_engines(torn, check=True).collect()
    late = [("f", 0, "a", "r", e, 1) for e in ("baidu", "so360", "bing")] + [("f", 0, "b", "q", "google", 1)]
    assert rows(R.merge_engines(spark.createDataFrame(late, LONG)))[0][2:4] == ("b", "q")


def test_upsert_memo_attach(spark, rows):
    s = "source_file string, rec_pos int, baidu long"
    old = spark.createDataFrame([("f", 0, 5), ("f", 1, None), ("f", 2, 7)], s)
    new = spark.createDataFrame([("f", 0, 4), ("f", 1, 3), ("f", 3, 1), ("f", 0, 9)], s)
    assert rows(R.upsert_max(old, new, ["baidu"])) == [("f", 0, 9), ("f", 1, 3), ("f", 2, 7), ("f", 3, 1)]
    memo = spark.createDataFrame([("x", 1)], "kd string, n long")
    wanted = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "kd string")
    assert rows(R.memo_misses(wanted, memo)) == [("y",)]
    fresh = spark.createDataFrame([("y", 2), ("x", 9)], "kd string, n long")
    assert sorted(map(tuple, R.memo_lookup(wanted, memo, fresh).collect()), key=str) == [("x", 1), ("y", 2), ("y", 2), (None, None)]
    side = spark.createDataFrame([("f", 0, ["平"]), ("f", 9, ["仄"])], "source_file string, rec_pos int, strains array<string>")
    main = spark.createDataFrame([("f", 0, "i0"), ("f", 1, "i1")], "source_file string, rec_pos int, id string")
    assert rows(R.attach(side, main, ["id"])) == [("f", 0, ["平"], "i0"), ("f", 1, None, "i1"), ("f", 9, ["仄"], None)]


def test_file_names_and_duplicates(spark):
    df = spark.createDataFrame([("ci.song.2019y.json",), ("poet.tang.0.json",)], "f string")
    assert [r[0] for r in df.select(R.rank_file_name(F.col("f"), "bing")).collect()] == ["ci.song.rank.bing.2019y.json", "poet.tang.rank.bing.0.json"]
    d = spark.createDataFrame([(20000, 20000), (10000, 10000), (30000, None)], "bing long, bing_en long")
    assert [tuple(r) for r in R.ranked(R.duplicate_counts(d)).collect()] == [(20000, 2)]


def test_metrics(spark):
    log = [(s, 8.0 - s / 10, None, 9.0 - s if s % 5 == 0 else None, 1.0 if s % 5 == 0 else None) for s in range(1, 21)]
    log[9] = (10, 7.0, None, -20.0, 1.0)
    df = spark.createDataFrame([("r", *x) for x in log] + [("r", *log[0])], "run string, step int, train_loss double, train_bpc double, avg_val_loss double, avg_val_bpc double")
    once = M.logged_once(df)
    b = M.best_checkpoints(once, 20).first()
    assert tuple(b) == ("r", 10, -20.0, 20, -11.0, 20, -11.0)
    h = {r.metric: r for r in M.history_summary(once).collect()}
    assert h["train_loss"].steps == 20 and h["train_loss"].first == 7.9 and h["avg_val_loss"].last == -11.0 and "train_bpc" not in h
    assert M.validated(once).count() == 4
    assert df.select(M.bits_per_char(F.lit(8.764997482299805))).first()[0] == 12.645218401118179


def test_decoding_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(0, 2, (20, 12)), 1)
    df = spark.createDataFrame([(i, r.tolist(), int(i % 12), float(u)) for i, (r, u) in enumerate(zip(x, rng.random(20), strict=True))], "i int, l array<double>, t int, u double")
    got = df.select("i", D.argmax(F.col("l")).alias("a"), D.softmax(D.top_k(D.scaled(F.col("l"), 0.8), 5)).alias("p"), M.cross_entropy(F.col("l"), F.col("t")).alias("e"), "u", D.draw(D.softmax(F.col("l")), F.col("u")).alias("d"))
    for r in got.collect():
        v = x[r.i]
        assert r.a == int(v.argmax())
        z = v / 0.8
        keep = np.argsort(-z, kind="stable")[:5]
        p = np.zeros(12)
        p[keep] = np.exp(z[keep] - z.max())
        assert np.allclose(r.p, p / p.sum())
        assert math.isclose(r.e, np.log(np.exp(v).sum()) - v[r.i % 12], rel_tol=1e-9)
        c = np.cumsum(np.exp(v) / np.exp(v).sum())
        assert r.d == int(np.searchsorted(c, r.u, side="right"))
    with pytest.raises(ValueError):
        D.scaled(F.col("l"), 0)
    with pytest.raises(Exception, match="k is greater"):
        df.select(D.top_k(F.col("l"), 13)).collect()
    assert df.select(D.top_k(F.col("l"), 0)).first()[0] == x[0].tolist()


def test_model_is_causal_and_generates(spark):
    shape = N.Shape(vocab=11, context=6, width=8, layers=2, heads=2)
    w = N.random_weights(shape)
    ids = np.array([[1, 2, 3, 4]])
    a, b = N.logits(w, shape, ids), N.logits(w, shape, np.array([[1, 2, 3, 9]]))
    assert np.allclose(a[:, :3], b[:, :3]) and not np.allclose(a[:, 3], b[:, 3])
    assert 0 < N.loss(w, shape, ids, ids) < 10
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None), (4, [5] * 9)], "prompt_id long, ids array<int>")
    got = dict(N.generate(df, w, shape, new=4).collect())
    have = [1, 2, 3]
    for _ in range(4):
        have.append(int(N.logits(w, shape, np.array([have[-6:]]))[0, -1].argmax()))
    assert got == {1: have, 2: [], 3: [], 4: got[4]} and len(got[4]) == 13
    drawn = dict(N.generate(df, w, shape, new=4, temperature=1.0, k=3).collect())
    assert drawn == dict(N.generate(df.repartition(3), w, shape, new=4, temperature=1.0, k=3).collect())
    z = np.array([[1.0, 3.0, 3.0, 3.0, 0.0]])
    assert {int(N._next(z, 1.0, 2, np.array([u]))[0]) for u in np.linspace(0, 0.999, 50)} == {1, 2}
    with pytest.raises(ValueError):
        N.Shape(vocab=2, context=2, width=10, heads=3)
    old = N.Shape(vocab=11, context=6, width=8, prototype=True)
    assert N.logits(N.random_weights(old), old, ids).shape == (1, 4, 11)


@pytest.mark.parametrize("n, k", [(1, 1), (5, 5), (7, 1), (21, 20), (30, 20), (100, 3), (3001, 20), (1000, 999)])
@pytest.mark.parametrize("kind", ["apart", "tied", "infinite"])
def test_greatest_logits_by_groups(n, k, kind):
    z = np.random.default_rng(n).normal(size=(30, n)).astype(np.float32)
    if kind == "tied":
        z = np.round(z * 2) / 2
    if kind == "infinite":
        z[:, n // 3 :] = -np.inf
    want = np.sort(np.argsort(-z, axis=-1, kind="stable")[:, :k], -1)
    assert (N._greatest_by_groups(z, k) == want).all()


def test_generates_for_more_prompts_than_are_held_at_once(spark):
    shape = N.Shape(vocab=300, context=4, width=8, heads=2)
    w = N.random_weights(shape)
    w["head_bias"] = np.linspace(-1, 1, 300, dtype=np.float32)
    prompts = [[(i * 7 + j) % 300 for j in range(1 + i % 5)] for i in range(300)]
    df = spark.createDataFrame(list(enumerate(prompts)), "prompt_id long, ids array<int>").coalesce(1)
    hashes = dict(df.select("prompt_id", F.xxhash64("prompt_id")).collect())
    got = dict(N.generate(df, w, shape, new=3, temperature=0.7, k=6).collect())
    for i, have in enumerate(prompts):
        for u in np.random.default_rng([42, hashes[i] & 0xFFFFFFFF]).random(3):
            z = N.logits(w, shape, np.array([have[-4:]]))[0, -1].astype(float) / 0.7
            best = sorted(np.argsort(-z, kind="stable")[:6])
            p = np.exp(z[best] - z.max())
            have = [*have, int(best[min((np.cumsum(p / p.sum()) <= u).sum(), 5)])]
        assert got[i] == have


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (5, 5), (None, 3), (101, 100)] + [(200, x) for x in range(201, 260)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 260)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_report(spark):
    r = spark.range(1).select(D.report(*map(F.lit, ("T", "p", 5, "a\nb", 2, "xy")), F.lit(None).cast("string"), F.lit(20)).alias("r")).first().r
    assert r == "=== T ===\nCheckpoint: p\nCheckpoint step: 5\nPrompt: 'a\\nb'\nMax new chars: 2\nTop-k: 20\n\n=== Generated text ===\nxy\n"


def test_greedy_generation_of_mixed_prompts_against_brute_force(spark):
    shape = N.Shape(vocab=11, context=6, width=8, layers=2, heads=2)
    w = N.random_weights(shape)
    prompts = [[(7 * i + k * k) % 11 for k in range(i)] for i in (0, 1, 2, 5, 6, 7, 30)] * 2 + [None]
    df = spark.createDataFrame(list(enumerate(prompts)), "prompt_id long, ids array<int>").coalesce(1)
    want = {}
    for i, p in enumerate(prompts):
        have = list(p or [])
        for _ in range(10 if p else 0):
            have.append(int(N.logits(w, shape, np.array([have[-6:]]))[0, -1].argmax()))
        want[i] = have
    assert dict(N.generate(df, w, shape, new=10).collect()) == want


def test_generate_query_continues_every_whole_document(spark, small):
    docs = {r.doc_id: r.text for r in reference._docs(spark, small).collect()}
    got = {r.doc_id: r for r in reference.queries()["generate"](spark, small).collect()}
    assert got.keys() == docs.keys() and any(0 < len(t) < 16 for t in docs.values()) and "" in docs.values()
    chars = sorted(set("".join(docs.values())) | {"\n"})
    shape = N.Shape(vocab=len(chars), context=16, width=16, layers=1, heads=2)
    w = N.random_weights(shape)
    hashes = dict(spark.createDataFrame([(i,) for i in docs], "doc_id long").select("doc_id", F.xxhash64("doc_id")).collect())
    for i, t in docs.items():
        assert got[i].n_ids == (len(t) + 200 if t else 0) and len(got[i].generated) == (200 if t else 0)
    for i in sorted(docs, key=lambda i: len(docs[i]))[::20]:
        have = [chars.index(c) for c in docs[i]]
        for u in np.random.default_rng([42, hashes[i] & 0xFFFFFFFF]).random(200) if have else ():
            z = N.logits(w, shape, np.array([have[-16:]]))[0, -1].astype(float) / 0.8
            best = sorted(np.argsort(-z, kind="stable")[:20])
            p = np.exp(z[best] - z.max())
            have.append(int(best[min((np.cumsum(p / p.sum()) <= u).sum(), 19)]))
        assert got[i].generated == "".join(chars[x] for x in have[len(docs[i]) :])


def test_window_cover_holds_the_whole_corpus(spark, small):
    corpus = "\n\n".join(r.text for r in reference._docs(spark, small).orderBy("doc_id").collect())
    got = sorted(map(tuple, reference.queries()["window_cover"](spark, small).collect()))
    n = (len(corpus) - 1) // reference.CONTEXT
    assert [s for s, _, _ in got] == [i * reference.CONTEXT for i in range(n)] and n > 100
    assert "".join(x for _, x, _ in got) == corpus[: n * reference.CONTEXT] and "".join(y for _, _, y in got) == corpus[1 : n * reference.CONTEXT + 1]
