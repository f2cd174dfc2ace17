"""Document languages by a bidirectional gated recurrent network over bytes.

The network labels every byte of a line; the probabilities of a line's letters are pooled to the
line, those of its lines to the document. It is trained in numpy by backpropagation through time on
a bounded sample of labelled documents. Labels are often wrong and texts mixed, so lines that a
network trained on the other half of the sample places elsewhere are left out of the training.
"""

from __future__ import annotations

import hashlib
import pickle
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: The training sample: documents at most, evenly over the languages; bytes of one of them at most; lines of one language at most.
SAMPLE_DOCS, SAMPLE_DOC_BYTES, SAMPLE_LINES = 4000, 1 << 15, 6000
HIDDEN = 16
#: Weight decay of the training.
DECAY = 0.02
#: Batches of training and rates of learning: of each network that judges the sample; of the last one, which goes on from the first of them.
STEPS, RATES = (500, 500), (0.03, 0.03)
#: Bytes of a line that one step of backpropagation goes through; where they begin in a longer line is drawn anew each time.
TRAIN_BYTES = 64
#: Byte positions that are labelled at once, and rows; lines of more positions are labelled stretch by stretch with the states carried on.
_POSITIONS, _ROWS = 1 << 18, 2048
#: Stands behind the end of a line; adds nothing to a state.
PADDING = 256
_TEXT_BLOCK = 1 << 22


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Two gated recurrent units (forward and backward) over bytes, and a softmax at every byte."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = hidden
        self.hidden, self.classes = h, classes
        self.p = {
            "T": rng.normal(0, 0.3, (2, 257, 3 * h)),  # what a byte (256: padding) adds to update gate, reset gate and candidate
            "U": rng.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)),
            "W": rng.normal(0, 1 / np.sqrt(h), (2, h, classes)),
            "b": np.zeros(classes),
        }
        self.p["T"][:, PADDING] = 0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def train_step(self, byte: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients; byte (time, rows) with 256 behind the end of a row, mask (time, rows) of the letters.

        The backward unit starts at the padding, which leaves its state at zero.
        """
        p, n = self.p, self.hidden
        steps, rows = byte.shape
        kind = p["U"].dtype
        both = np.stack([byte, byte[::-1]], 1)
        x = p["T"][np.arange(2)[:, None], both]
        h = np.zeros((steps + 1, 2, rows, n), kind)
        gates, inner = np.empty((steps, 2, rows, 2 * n), kind), np.empty((steps, 2, rows, n), kind)
        c = np.empty((steps, 2, rows, n), kind)
        for t in range(steps):
            s = h[t] @ p["U"]
            gates[t] = _sigmoid(x[t, ..., : 2 * n] + s[..., : 2 * n])
            inner[t] = s[..., 2 * n :]
            np.tanh(x[t, ..., 2 * n :] + gates[t, ..., n:] * inner[t], out=c[t])
            h[t + 1] = h[t] + gates[t, ..., :n] * (c[t] - h[t])
        forward, backward = h[1:, 0], h[:0:-1, 1]
        logits = forward @ p["W"][0] + backward @ p["W"][1] + p["b"]
        e = np.exp(logits - logits.max(-1, keepdims=True))
        prob = e / e.sum(-1, keepdims=True)
        weight = mask / np.maximum(mask.sum(0), 1) / rows
        prob[:, np.arange(rows), label] -= 1
        dl = (prob * weight[..., None]).astype(kind)
        g = {"b": dl.sum((0, 1)), "W": np.stack([y.reshape(-1, n).T @ dl.reshape(-1, self.classes) for y in (forward, backward)])}
        ds = np.stack([dl @ p["W"][0].T, (dl @ p["W"][1].T)[::-1]], 1)
        z, r = gates[..., :n], gates[..., n:]
        # What the gradient of a state is multiplied by on its way to the candidate, the update gate and the reset gate.
        to_c = z * (1 - c * c)
        to_z = (c - h[:-1]) * z * (1 - z)
        to_r = inner * r * (1 - r)
        carried = np.zeros((2, rows, n), kind)
        drawn, turned = np.empty((steps, 2, rows, 3 * n), kind), p["U"].transpose(0, 2, 1)
        dss = np.empty((steps, 2, rows, 3 * n), kind)
        for t in range(steps - 1, -1, -1):
            dh = ds[t] + carried
            own = dss[t]
            np.multiply(dh, to_z[t], out=own[..., :n])
            dac = np.multiply(dh, to_c[t], out=drawn[t, ..., 2 * n :])
            np.multiply(dac, to_r[t], out=own[..., n : 2 * n])
            np.multiply(dac, r[t], out=own[..., 2 * n :])
            carried = dh * (1 - z[t]) + own @ turned
        drawn[..., : 2 * n] = dss[..., : 2 * n]
        g["U"] = np.stack([h[:-1, k].reshape(-1, n).T @ dss[:, k].reshape(-1, 3 * n) for k in range(2)])
        g["T"] = np.zeros_like(p["T"])
        for k in range(2):
            flat, which = drawn[:, k].reshape(-1, 3 * n), both[:, k].ravel()
            order = np.argsort(which, kind="stable")
            first = np.flatnonzero(np.diff(which[order], prepend=-1))
            g["T"][k, which[order][first]] = np.add.reduceat(flat[order], first)
        g["T"][:, PADDING] = 0
        return g

    def line_scores(self, data: np.ndarray, letter: np.ndarray, begin: np.ndarray, length: np.ndarray, positions: int = _POSITIONS) -> np.ndarray:
        """Sum over the letters of each run of bytes of the class probabilities.

        Runs of like length go together, as many as have `positions` bytes. One that is longer alone
        is gone through in stretches: forwards for the states at their beginnings, then from the last
        stretch to the first, the backward unit's state being carried on. The result doesn't depend
        on the stretches.
        """
        out = np.zeros((len(begin), self.classes))
        order = np.argsort(length, kind="stable")
        start = 0
        while start < len(order):
            widest = int(length[order[min(start + _ROWS, len(order)) - 1]])
            own = order[start : start + max(1, min(_ROWS, positions // max(widest, 1)))]
            start += len(own)
            steps = int(length[own].max())
            if not steps:
                continue
            cuts = list(range(0, steps, positions)) + [steps]
            inner = np.zeros((len(own), self.hidden), np.float32)
            states = [inner]  # of the forward unit before each stretch
            for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
                states.append(self._stretch(data, letter, begin[own], length[own], a, b, states[-1], None, None)[0])
            back = inner
            for a, b, state in zip(cuts[-2::-1], cuts[:0:-1], states[::-1], strict=True):
                _, back = self._stretch(data, letter, begin[own], length[own], a, b, state, back, out_rows := np.zeros((len(own), self.classes)))
                out[own] += out_rows
        return out

    def _stretch(self, data: np.ndarray, letter: np.ndarray, begin: np.ndarray, length: np.ndarray, a: int, b: int, state: np.ndarray, back: np.ndarray | None, out: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Bytes a to b of each run: the forward unit's state behind them and the backward unit's before them; with out the letters' probabilities are added to it."""
        n, rows, steps, halved = self.hidden, len(begin), b - a, self._halved()
        t = np.arange(a, b)[:, None]
        inside = t < length
        at = np.minimum(begin + t, len(data) - 1)
        byte = np.where(inside, data[at].astype(np.intp), PADDING)
        logits = np.empty((steps, rows, self.classes), np.float32) if out is not None else None
        s, x, one, two = (np.empty((rows, w * n), np.float32) for w in (3, 3, 1, 1))
        more = np.empty((rows, self.classes), np.float32)
        ends = [state, back]
        for k, times in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            if k == 1 and out is None:
                break
            h = ends[k].copy()
            table, inner, outer = halved[k]
            for i in times:
                table.take(byte[i], axis=0, out=x, mode="clip")
                np.matmul(h, inner, out=s)
                g, c = s[:, : 2 * n], s[:, 2 * n :]
                g += x[:, : 2 * n]
                np.tanh(g, out=g)  # gates are (1 + g) / 2; inner holds half of the candidate's weights
                np.add(g[:, n:], 1, out=one)
                c *= one
                c += x[:, 2 * n :]
                np.tanh(c, out=two)
                two -= h
                np.add(g[:, :n], 1, out=one)
                two *= one
                two *= np.float32(0.5)
                h += two
                if out is None:
                    continue
                if k == 0:
                    np.matmul(h, outer, out=logits[i])
                else:
                    logits[i] += np.matmul(h, outer, out=more)
            ends[k] = h
        if out is not None:
            logits += self.p["b"]
            if max(logits.max(), -logits.min()) > 60:  # beyond that exponentials leave the range of the numbers
                logits -= logits.max(-1, keepdims=True)
            np.exp(logits, out=logits)
            weight = (inside & letter[at]) / (logits.reshape(-1, self.classes) @ np.ones(self.classes, np.float32)).reshape(steps, rows)
            out += np.einsum("tbc,tb->bc", logits, weight)
        return ends[0], ends[1]

    def _halved(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Weights with the gates' halves folded in: sigmoid(x) = (1 + tanh(x / 2)) / 2."""
        scale = np.concatenate([np.full(2 * self.hidden, 0.5), np.ones(self.hidden)]).astype(np.float32)
        return [(np.ascontiguousarray(self.p["T"][k] * scale), np.ascontiguousarray(self.p["U"][k] * np.float32(0.5)), np.ascontiguousarray(self.p["W"][k])) for k in range(2)]


def fit(lines: list[bytes], masks: list[np.ndarray], labels: np.ndarray, classes: int, steps: int = 1000, rate: float = 0.03, rows: int = 64, seed: int = 0, start: dict[str, np.ndarray] | None = None) -> Network:
    """Train by backpropagation through time with Adam; of a long line each step takes TRAIN_BYTES bytes from another place. start: weights to go on from."""
    net = Network(classes, seed=seed)
    if start is not None:
        net.p = {k: v.copy() for k, v in start.items()}
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    lengths = np.array([len(w) for w in lines])
    step, batches = 0, -(-len(lines) // rows)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    while step < steps:
        order = rng.permutation(len(lines))  # languages differ in length, so rows of like length would be of few languages
        for k in range(min(batches, steps - step)):
            own = order[k * rows : (k + 1) * rows]
            longest = min(int(lengths[own].max()), TRAIN_BYTES)
            begins = (rng.random(len(own)) * (np.maximum(lengths[own] - TRAIN_BYTES, 0) + 1)).astype(np.int64)
            byte = np.full((longest, len(own)), PADDING)
            mask = np.zeros((longest, len(own)), np.float32)
            for j, (i, a) in enumerate(zip(own.tolist(), begins.tolist(), strict=True)):
                w = np.frombuffer(lines[i], np.uint8)[a : a + TRAIN_BYTES]
                byte[: len(w), j], mask[: len(w), j] = w, masks[i][a : a + TRAIN_BYTES]
            g = net.train_step(byte, mask, labels[own])
            step += 1
            slower = rate * (1 - 0.99 * step / steps)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for name, v in g.items():
                v = v * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.99 * second[name] + 0.01 * v * v
                net.p[name] = (net.p[name] * np.float32(1 - slower * DECAY) - slower * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if step > steps - steps // 3:
                mean = {name: v + net.p[name] for name, v in mean.items()}
    if steps >= 3:
        net.p = {name: v / np.float32(steps // 3) for name, v in mean.items()}  # the mean of the last third of the way
    return net


@lru_cache(1)
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[p for p in range(0x110000) if unicodedata.category(chr(p))[0] == "L"]] = True
    return out


def lines_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, which of them belong to letters, and of each line: begin, length, text, number of letters' bytes."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    letter = np.repeat(_letters()[points], wide)
    data = np.frombuffer(joined.encode(), np.uint8)
    end = np.flatnonzero(data == 10)
    begin = np.concatenate([[0], end[:-1] + 1])
    per_text = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    total = np.concatenate([[0], np.cumsum(letter)])
    return data, letter, begin, end - begin, np.repeat(np.arange(len(texts)), per_text), total[end] - total[begin]


def label_language(names: DataFrame, label):
    """Column expression helper: the plain form of a label (see lang_name)."""
    return F.regexp_replace(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), r"[-_].*$", "")


def with_label_language(df: DataFrame, names: DataFrame, lang: str = "lang", name: str = "name", code: str = "lang") -> DataFrame:
    """df with the column label_lang: the language that the label names, null if it is missing or names none."""
    known = names.select(F.col(name).alias("label_name"), F.col(code).alias("label_lang")).where("label_name is not null").dropDuplicates(["label_name"])
    return df.withColumn("label_name", label_language(names, F.col(lang))).join(known, "label_name", "left").drop("label_name")


def _sample(labelled: DataFrame, key: str, text: str, docs: int) -> list[Row]:
    """h, t, label_lang of at most `docs` labelled documents, as many of each language as there are or as its share allows, chosen by a hash of their key."""
    usable = labelled.where(F.col("label_lang").isNotNull())
    counts = dict(usable.groupBy("label_lang").count().collect())  # a row for each language
    if not counts:
        return []
    quota = max(1, docs // len(counts))
    most = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(int(min(1.0, 1.5 * quota / n) * (1 << 30))))])
    near = usable.withColumn("h", F.xxhash64(key)).where(F.pmod("h", F.lit(1 << 30)) <= most[F.col("label_lang")])
    near = near.where(F.col(text).isNotNull() & (F.octet_length(text) <= SAMPLE_DOC_BYTES)).select("h", F.col(text).alias("t"), "label_lang")
    rows: dict[str, list[Row]] = {}
    for r in sorted(near.collect(), key=lambda r: (r.h, r.t)):  # one and a half times the sample, about
        rows.setdefault(r.label_lang, []).append(r)
    return [r for c in sorted(rows) for r in rows[c][:quota]]


def _judge(lines: list[bytes], masks: list[np.ndarray], label: np.ndarray, half: np.ndarray, classes: int, seed: int):
    """Which lines of each half (0, 1) a network that hasn't seen it, and can't have learned its errors by heart, places where their label does; and the networks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                seen, other = np.flatnonzero(half != k), np.flatnonzero(half == k)
                if len(seen) and len(other):
                    net = fit([lines[i] for i in seen], [masks[i] for i in seen], label[seen], classes, steps=STEPS[0], rate=RATES[0], seed=seed + k)
                    size = np.array([len(lines[i]) for i in other])
                    scores = net.line_scores(np.frombuffer(b"".join(lines[i] for i in other), np.uint8), np.concatenate([masks[i] for i in other]) > 0, np.cumsum(size) - size, size)
                    other = other[scores[np.arange(len(other)), label[other]] >= 0.5 * scores.sum(1)]
                    weights = pickle.dumps(net.p)
                else:
                    weights = None
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([other], pa.list_(pa.int64())), pa.array([weights], pa.binary())], names=["half", "lines", "weights"])

    return run


#: Networks fitted in this process, by a digest of all that went into them.
_FITTED: dict[bytes, tuple[Network, list[str]]] = {}


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, seed: int = 0) -> tuple[Network, list[str]] | None:
    """Fit the network on a bounded sample of documents with a label_lang; None without any.

    A language that no sampled document is labelled with can't be found. The same sample gives the
    same network, which is kept for the next call; the two that judge the sample are trained in
    tasks side by side.
    """
    rows = _sample(labelled, key, text, sample_docs)
    codes = sorted({r.label_lang for r in rows})
    rng = np.random.default_rng(seed)
    lines, masks, labels = [], [], []
    for c, code in enumerate(codes):
        data, letter, begin, length, _, many = lines_of([r.t for r in rows if r.label_lang == code])
        for i in rng.permutation(np.flatnonzero(many > 0))[:sample_lines]:
            b, n = int(begin[i]), int(length[i])
            lines.append(data[b : b + n].tobytes())
            masks.append(letter[b : b + n].astype(np.float32))
            labels.append(c)
    if not lines:
        return None
    digest = hashlib.blake2b(repr((codes, seed, STEPS, RATES, TRAIN_BYTES, HIDDEN, DECAY, labels)).encode())
    for w in lines:
        digest.update(w + b"\n")
    if digest.digest() in _FITTED:
        return _FITTED[digest.digest()]
    label, half = np.array(labels), rng.integers(0, 2, len(labels))
    halves = labelled.sparkSession.range(0, 2, 1, 2).mapInArrow(_judge(lines, masks, label, half, len(codes), seed), "half long, lines array<long>, weights binary")
    judged = sorted(halves.collect(), key=lambda r: r.half)  # numbers of sampled lines, and two networks
    keep = np.array(sorted(i for r in judged for i in r.lines), np.int64)
    if not len(keep):
        keep = np.arange(len(label))
    net = fit([lines[i] for i in keep], [masks[i] for i in keep], label[keep], len(codes), steps=STEPS[1], rate=RATES[1], seed=seed + 2, start=pickle.loads(judged[0].weights) if judged[0].weights else None)
    if len(_FITTED) >= 8:
        _FITTED.pop(next(iter(_FITTED)))
    return _FITTED.setdefault(digest.digest(), (net, codes))


_RUNS = "label_lang string, run int, runs int, first_lang string, first_line long, last_line long, lang string, confidence double, letters long, doc_lang string, doc_confidence double"


def _label(net: Network, codes: list[str], key_type: pa.DataType):
    names = np.array(codes, object)

    def block(keys: pa.Array, known: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        data, letter, begin, length, whose, many = lines_of(texts)
        line_no = np.arange(len(whose)) - np.searchsorted(whose, whose, side="left")
        own = np.flatnonzero(many > 0)
        scores = net.line_scores(data, letter, begin[own], length[own])
        doc, no, best = whose[own], line_no[own], scores.argmax(1)
        new = np.ones(len(own), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (best[1:] != best[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(own)) - 1
        pooled = np.add.reduceat(scores, first) if len(first) else np.zeros((0, len(codes)))
        d = doc[first]
        whole = np.zeros((len(texts), len(codes)))
        np.add.at(whole, doc, scores)
        share = whole / np.maximum(whole.sum(1, keepdims=True), 1e-9)
        opens = np.searchsorted(d, d, side="left")
        arrays = [
            keys.take(pa.array(d)),
            known.take(pa.array(d)),
            pa.array(np.arange(len(d)) - opens, pa.int32()),
            pa.array(np.bincount(d, minlength=len(texts))[d], pa.int32()),
            pa.array(names[best[first][opens]] if len(d) else [], pa.string()),
            pa.array(no[first], pa.int64()),
            pa.array(no[last], pa.int64()),
            pa.array(names[best[first]] if len(d) else [], pa.string()),
            pa.array(pooled[np.arange(len(d)), best[first]] / np.maximum(pooled.sum(1), 1e-9), pa.float64()),
            pa.array(np.rint(pooled.sum(1)), pa.int64(), safe=False),
            pa.array(names[share.argmax(1)][d] if len(d) else [], pa.string()),
            pa.array(share.max(1)[d] if len(d) else [], pa.float64()),
        ]
        columns = ["key"] + [c.split()[0] for c in _RUNS.split(", ")]
        yield pa.RecordBatch.from_arrays(arrays, names=columns)
        bare = pa.array(np.flatnonzero(np.bincount(doc, minlength=len(texts)) == 0))  # texts without letters
        n = len(bare)
        fixed = {"key": keys.take(bare), "label_lang": known.take(bare), "run": pa.array([-1] * n, pa.int32()), "runs": pa.array([0] * n, pa.int32())}
        yield pa.RecordBatch.from_arrays([fixed.get(c, pa.nulls(n, a.type)) for c, a in zip(columns, arrays, strict=True)], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) < _TEXT_BLOCK):
                    size += len(texts[stop])
                    stop += 1
                yield from block(b.column("key").slice(start, stop - start), b.column("label_lang").slice(start, stop - start), texts[start:stop])
                start = stop

    return run


def language_runs(df: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """One row for each run of lines in one language of each document: key, label_lang, run, runs, first_lang, first_line, last_line, lang, confidence, letters, doc_lang, doc_confidence.

    Lines are separated by line feeds; a carriage return is no letter. Lines without letters belong
    to no language and don't break a run; texts that are null, empty or without letters have no
    runs. Confidence is the mean probability over the run's (or document's) letters. Without a
    single labelled text nothing can be learned and the result is empty.
    """
    return _labelled(df, names, key, text, lang, sample_docs, sample_lines).where("run >= 0")


def _labelled(df: DataFrame, names: DataFrame, key: str, text: str, lang: str, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """The runs, and a row with run -1 for each document without letters."""
    rows = with_label_language(df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")), names)
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, {_RUNS}"
    fitted = train(rows, "key", "text", sample_docs, sample_lines)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    return rows.select("key", "label_lang", "text").mapInArrow(_label(*fitted, None), schema).withColumnRenamed("key", key)


def mislabelled_runs(df: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, first_line, lang of all runs of the documents whose label is missing or isn't that of the first run, or that have several runs."""
    runs = language_runs(df, names, key, text, lang)
    return runs.where("label_lang is null or label_lang <> first_lang or runs > 1").select(key, "first_line", "lang")


def document_languages(df: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, label_lang, doc_lang, doc_confidence, runs of every document; without letters the language is null and runs is 0."""
    return _labelled(df, names, key, text, lang).where("run <= 0").select(key, "label_lang", "doc_lang", "doc_confidence", "runs")
