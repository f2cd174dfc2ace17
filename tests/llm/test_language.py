"""p9: gradients, held-out accuracy, runs and labels."""

import random

import numpy as np
import pytest

from inkstone.llm import language as L

WORDS = {
    "en": "the old river hears a lonely candle under this quiet window and her ferry waits".split(),
    "de": "der alte Fluss hört eine einsame Kerze unter diesem stillen Fenster und ihre Fähre wartet".split(),
    "zh": "山 水 月 花 風 夜 春 秋 雨 舟 竹 酒 鳥 霜".split(),
    "ru": "старая река слышит одинокая свеча под этим тихим окном".split(),
}


def line(rng, lang, n=8):
    return ("" if lang == "zh" else " ").join(rng.choice(WORDS[lang]) for _ in range(n)) + rng.choice([".", "。", ""])


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = L.Network(3, hidden=4, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    byte = rng.integers(0, 256, (6, 5))
    byte[4:, 0] = L.PADDING
    mask = (byte < 256).astype(float)
    mask[1] = 0
    label = np.array([0, 1, 2, 1, 0])

    def loss():
        logits = []
        for k, x in enumerate((byte, byte[::-1])):
            h, out = np.zeros((5, 4)), []
            for t in range(6):
                s = h @ net.p["U"][k]
                a = net.p["T"][k, x[t]]
                g = L._sigmoid(a[:, :8] + s[:, :8])
                c = np.tanh(a[:, 8:] + g[:, 4:] * s[:, 8:])
                h = h + g[:, :4] * (c - h)
                out.append(h @ net.p["W"][k])
            logits.append(np.array(out if k == 0 else out[::-1]))
        z = logits[0] + logits[1] + net.p["b"]
        z = z - z.max(-1, keepdims=True)
        nll = np.log(np.exp(z).sum(-1)) - z[:, np.arange(5), label]
        return (nll * mask / mask.sum(0) / 5).sum()

    g = net.train_step(byte, mask, label)
    for name, places in {"U": [(0, 1, 2), (1, 3, 9), (0, 2, 11)], "W": [(0, 1, 1), (1, 2, 0)], "b": [(1,)], "T": [(0, byte[0, 1], 3), (1, byte[2, 2], 10), (0, byte[3, 3], 6)]}.items():
        for at in places:
            before = net.p[name][at]
            net.p[name][at] = before + 1e-4
            up = loss()
            net.p[name][at] = before - 1e-4
            down = loss()
            net.p[name][at] = before
            assert abs((up - down) / 2e-4 - g[name][at]) < 2e-4, (name, at)


def test_scores_equal_the_plain_recurrence():
    net = L.Network(4, seed=0)
    words = [b"the old river", b"abc", "зда".encode(), b"x" * 60, b"1"]
    size = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    letter = data != ord(" ")
    got = net.line_scores(data, letter, np.cumsum(size) - size, size)
    for w, scores in zip(words, got, strict=True):
        x, logits = np.frombuffer(w, np.uint8), 0
        for k, order in enumerate((x, x[::-1])):
            h, out = np.zeros(L.HIDDEN), []
            for b in order:
                s, a = h @ net.p["U"][k], net.p["T"][k, b]
                g = L._sigmoid(a[: 2 * L.HIDDEN] + s[: 2 * L.HIDDEN])
                h = h + g[: L.HIDDEN] * (np.tanh(a[2 * L.HIDDEN :] + g[L.HIDDEN :] * s[2 * L.HIDDEN :]) - h)
                out.append(h @ net.p["W"][k])
            logits = logits + np.array(out if k == 0 else out[::-1])
        e = np.exp(logits + net.p["b"])
        assert np.allclose((e / e.sum(1, keepdims=True))[x != ord(" ")].sum(0), scores, rtol=1e-4)


@pytest.mark.parametrize("positions", [1, 7, 64, 100, 1000])
def test_scores_dont_depend_on_the_stretches(positions):
    net, rng = L.Network(3, seed=2), np.random.default_rng(1)
    size = np.array([0, 1, 5, 63, 64, 65, 300])
    data, letter = rng.integers(97, 123, size.sum()).astype(np.uint8), rng.random(size.sum()) < 0.8
    whole = net.line_scores(data, letter, np.cumsum(size) - size, size)
    assert np.allclose(net.line_scores(data, letter, np.cumsum(size) - size, size, positions), whole, rtol=1e-4, atol=1e-5)


def test_a_network_is_fitted_once(tables, monkeypatch):
    df, names, _ = tables
    rows = L.with_label_language(df.select("doc_id", "text", "lang"), names)
    first = L.train(rows)
    monkeypatch.setattr(L, "fit", None)
    assert L.train(rows) is first


NAMES = [("en", "en"), ("english", "en"), ("de", "de"), ("zh", "zh"), ("ru", "ru"), (None, "xx")]
SCHEMA = "doc_id long, text string, lang string, label_lang string, run int"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(0)
    langs = list(WORDS)
    data, truth = [], {}
    for i in range(400):
        a = rng.choice(langs)
        parts = [(a, rng.randint(1, 4))]
        if rng.random() < 0.2:
            parts.append((rng.choice([x for x in langs if x != a]), rng.randint(1, 3)))
        rows, runs = [], []
        for lang, n in parts:
            for k in range(n):
                if rng.random() < 0.2:
                    rows.append(rng.choice(["", "  ", "— 7 —", "№7", "🍂"]))
                if k == 0:
                    runs.append((len(rows), lang))
                rows.append(line(rng, lang) + ("\r" if i % 9 == 0 else ""))
        label = a if rng.random() < 0.85 else rng.choice([None, "", "??", *langs])
        note = rng.choice(["{}", " {} ", "{}-Hant", "{}_CN"]).format(label.upper()) if label in langs else label
        data.append((i, "\n".join(rows), note, "x", 1))
        truth[i] = (label if label in langs else None, runs)
    data += [(1000, None, "en", "x", 1), (1001, "", "en", "x", 1), (1002, " \n12\n", "zh", "x", 1), (1003, "the river hears " * 4000, None, "x", 1), (1004, line(rng, "en"), "ENGLISH", "x", 1)]
    truth |= {1003: (None, [(0, "en")]), 1004: ("en", [(0, "en")])}
    return spark.createDataFrame(data, SCHEMA), spark.createDataFrame(NAMES, "name string, lang string"), truth


def test_held_out_lines(tables):
    rng = random.Random(9)
    langs = sorted(WORDS)
    make = lambda n: [(x, line(rng, x)) for x in langs for _ in range(n)]
    train, test = make(400), make(100)
    data, letter, begin, length, _, many = L.lines_of([t for _, t in train])
    net = L.fit([data[b : b + n].tobytes() for b, n in zip(begin, length, strict=True)], [letter[b : b + n].astype(np.float32) for b, n in zip(begin, length, strict=True)], np.array([langs.index(x) for x, _ in train]), 4, steps=500)
    data, letter, begin, length, _, many = L.lines_of([t for _, t in test])
    scores = net.line_scores(data, letter, begin, length)
    assert np.mean(scores.argmax(1) == [langs.index(x) for x, _ in test]) >= 0.98
    assert np.allclose(scores.sum(1), many, rtol=1e-3)


def test_runs_and_labels(tables):
    df, names, truth = tables
    expected = {(i, n, x) for i, (label, runs) in truth.items() if label != runs[0][1] or len(runs) > 1 for n, x in runs}
    got = [tuple(r) for r in L.mislabelled_runs(df, names).collect()]
    assert len(got) == len(set(got))
    assert len(set(got) & expected) >= 0.95 * max(len(got), len(expected))
    docs = {r.doc_id: r for r in L.document_languages(df, names).collect()}
    assert set(docs) == set(truth) | {1000, 1001, 1002} and docs[1003].doc_lang == "en" and 0 < docs[1003].doc_confidence <= 1
    assert docs[1004].label_lang == "en"
    assert {tuple(docs[i])[1:] for i in (1000, 1001)} == {("en", None, None, 0)} and docs[1002].doc_lang is None


def test_nothing_to_learn_from(spark):
    names = spark.createDataFrame(NAMES, "name string, lang string")
    df = spark.createDataFrame([(1, "text", "??", "x", 1), (2, None, "en", "x", 1)], SCHEMA)
    assert L.language_runs(df, names).count() == 0 and L.mislabelled_runs(df.limit(0), names).count() == 0


def test_lines_of():
    data, letter, begin, length, whose, many = L.lines_of(["a\n12\n春", "", "x"])
    assert whose.tolist() == [0, 0, 0, 1, 2] and many.tolist() == [1, 0, 3, 0, 1] and length.tolist() == [1, 2, 3, 0, 1]
