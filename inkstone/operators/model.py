"""A decoder-only character model run in numpy: next-character logits and generation for many prompts.

Weights are a dictionary of arrays with a fixed size, sent to the tasks with the function; prompts
are spread over the tasks and a task generates for all prompts of a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.points import starts_of


#: Prompts that run together, and those of them whose logits over the vocabulary are held at once, so that these stay in the cache.
_ROWS, _HELD = 512, 128


@dataclass(frozen=True)
class Shape:
    vocab: int
    context: int
    width: int = 128
    layers: int = 1
    heads: int = 1
    #: The small prototype has one head scaled by the width and no projection behind it.
    prototype: bool = False

    def __post_init__(self):
        if self.width % self.heads:
            raise ValueError("the width must be a multiple of the number of heads")


def random_weights(shape: Shape, seed: int = 42) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    c = shape.width
    mat = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    w = {"token": rng.normal(0, 0.02, (shape.vocab, c)).astype(np.float32), "place": rng.normal(0, 0.02, (shape.context, c)).astype(np.float32)}
    for i in range(shape.layers):
        w |= {f"{i}.norm1": np.stack([np.ones(c), np.zeros(c)]).astype(np.float32), f"{i}.norm2": np.stack([np.ones(c), np.zeros(c)]).astype(np.float32), f"{i}.qkv": mat(c, 3 * c)}
        if not shape.prototype:
            w |= {f"{i}.out": mat(c, c), f"{i}.out_bias": np.zeros(c, np.float32)}
        w |= {f"{i}.up": mat(c, 4 * c), f"{i}.up_bias": np.zeros(4 * c, np.float32), f"{i}.down": mat(4 * c, c), f"{i}.down_bias": np.zeros(c, np.float32)}
    return w | {"norm": np.stack([np.ones(c), np.zeros(c)]).astype(np.float32), "head": mat(c, shape.vocab), "head_bias": np.zeros(shape.vocab, np.float32)}


def _normal(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    d = x - x.mean(-1, keepdims=True)
    return d / np.sqrt((d * d).mean(-1, keepdims=True) + 1e-5) * w[0] + w[1]


def _attention(x: np.ndarray, qkv: np.ndarray, shape: Shape, last: bool) -> np.ndarray:
    b, t, c = x.shape
    own = 1 if last else t  # places that ask
    split = lambda y, n: y.reshape(b, y.shape[1], n, shape.heads, c // shape.heads).transpose(2, 0, 3, 1, 4)
    (q,), (k, v) = split(x[:, t - own :] @ qkv[:, :c], 1), split(x @ qkv[:, c:], 2)
    score = q @ k.transpose(0, 1, 3, 2) / math.sqrt(c if shape.prototype else c // shape.heads)  # a numpy scalar would widen all to 64 bits
    score = np.where(np.tril(np.ones((t, t), bool))[t - own :], score, -np.inf)
    e = np.exp(score - score.max(-1, keepdims=True))
    return ((e / e.sum(-1, keepdims=True)) @ v).transpose(0, 2, 1, 3).reshape(b, own, c)


def _states(weights: dict[str, np.ndarray], shape: Shape, ids: np.ndarray, last: bool) -> np.ndarray:
    """What the logits are made of: (rows, places, width)."""
    x = weights["token"].take(ids, 0) + weights["place"][: ids.shape[1]]
    for i in range(shape.layers):
        only = last and i == shape.layers - 1  # in the last layer no other place counts any more
        a = _attention(_normal(x, weights[f"{i}.norm1"]), weights[f"{i}.qkv"], shape, only)
        x = (x[:, -1:] if only else x) + (a if shape.prototype else a @ weights[f"{i}.out"] + weights[f"{i}.out_bias"])
        h = np.maximum(_normal(x, weights[f"{i}.norm2"]) @ weights[f"{i}.up"] + weights[f"{i}.up_bias"], 0)
        x = x + h @ weights[f"{i}.down"] + weights[f"{i}.down_bias"]
    return _normal(x, weights["norm"])


def logits(weights: dict[str, np.ndarray], shape: Shape, ids: np.ndarray, last: bool = False) -> np.ndarray:
    """Logits (rows, places, vocabulary) of rows of identifiers no longer than the context; with last, of the last place only."""
    return _states(weights, shape, ids, last) @ weights["head"] + weights["head_bias"]


def loss(weights: dict[str, np.ndarray], shape: Shape, x: np.ndarray, y: np.ndarray) -> float:
    """Mean cross-entropy of the next characters."""
    z = logits(weights, shape, x).astype(np.float64)
    top = z.max(-1, keepdims=True)
    total = np.log(np.exp(z - top).sum(-1)) + top[..., 0]
    return float((total - np.take_along_axis(z, y[..., None], -1)[..., 0]).mean())


def _draw(z: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    c = np.cumsum(p / p.sum(-1, keepdims=True), -1)
    return np.minimum((c <= uniform[:, None]).sum(-1), p.shape[-1] - 1 - np.argmax(p[:, ::-1] > 0, -1))


def _greatest(z: np.ndarray, k: int) -> np.ndarray:
    """Identifiers of each row's k greatest logits, in rising order; of equal logits the lesser identifiers."""
    n = z.shape[-1]
    least = np.partition(z, n - k, axis=-1)[:, n - k, None]
    kept = z >= least
    if np.count_nonzero(kept) > k * len(z):
        above = z > least
        tied = kept & ~above
        kept = above | tied & (np.cumsum(tied, -1) <= k - above.sum(-1, keepdims=True))
    return (np.flatnonzero(kept) % n).reshape(-1, k)


def _greatest_by_groups(z: np.ndarray, k: int) -> np.ndarray:
    """As _greatest, for many logits: they are all within the k groups whose greatest logits are greatest, unless groups tie."""
    rows, n = z.shape
    groups = min(2 * math.isqrt(k * n), n)  # identifiers with the same rest are a group; k at least
    whole = n // groups * groups
    top = z[:, :whole].reshape(rows, -1, groups).max(1)
    np.maximum(top[:, : n - whole], z[:, whole:], out=top[:, : n - whole])
    kept = top >= np.partition(top, groups - k, axis=-1)[:, groups - k, None]
    if np.count_nonzero(kept) > k * rows:
        return _greatest(z, k)
    of = (np.flatnonzero(kept) % groups).reshape(rows, 1, k)
    ids = of + np.arange(0, n, groups)[:, None]  # rising; the last of a group may lie behind the vocabulary
    behind = ids[:, -1] >= n
    at = ids + np.arange(0, rows * n, n)[:, None, None]
    at[:, -1][behind] = 0
    held = z.take(at)
    held[:, -1][behind] = -np.inf
    return np.take_along_axis(ids.reshape(rows, -1), _greatest(held.reshape(rows, -1), k), -1)


def _next(z: np.ndarray, temperature: float | None, k: int | None, uniform: np.ndarray) -> np.ndarray:
    if temperature is None:
        return z.argmax(-1)
    if not k or k < 0:
        return _draw(z.astype(np.float64) / temperature, uniform)
    if k > z.shape[-1]:
        raise ValueError("k is greater than the vocabulary")
    ids = _greatest_by_groups(z, k)
    drawn = _draw(np.take_along_axis(z, ids, -1).astype(np.float64) / temperature, uniform)
    return np.take_along_axis(ids, drawn[:, None], -1)[:, 0]


def generate(prompts: DataFrame, weights: dict[str, np.ndarray], shape: Shape, new: int = 200, temperature: float | None = None, k: int | None = None, key: str = "prompt_id", ids: str = "ids", seed: int = 42) -> DataFrame:
    """key, ids: each prompt's identifiers followed by `new` more; the model sees the last `context` of them.

    temperature None is greedy. Draws depend on key and seed only. Empty and null prompts give an empty list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, biased = np.empty((_HELD, 1, shape.vocab), np.result_type(*weights.values())), weights["head_bias"].any()
        for b in batches:
            lists, keys = b.column("ids"), b.column("h").to_pylist()
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            values, begin = lists.flatten().to_numpy(), starts_of(length)  # the items of null lists aren't among them
            total = length + np.where(length > 0, new, 0)
            offsets = np.concatenate([[0], np.cumsum(total)])
            out = np.empty(offsets[-1], np.int32)
            out[np.repeat(offsets[:-1] - begin, length) + np.arange(len(values))] = values
            seen = np.minimum(length, shape.context)
            for n in np.unique(seen[seen > 0]):  # prompts of which the model sees as many places run together
                of = np.flatnonzero(seen == n)
                for own in (of[i : i + _ROWS] for i in range(0, len(of), _ROWS)):
                    end = begin[own] + length[own]
                    have = np.concatenate([values[end[:, None] - np.arange(n, 0, -1)], np.zeros((len(own), new), np.int32)], 1)
                    uniform = np.stack([np.random.default_rng([seed, keys[i] & 0xFFFFFFFF]).random(new) for i in own])
                    for j in range(new):
                        x = _states(weights, shape, have[:, max(n + j - shape.context, 0) : n + j], last=True)
                        for i in range(0, len(own), _HELD):
                            z = np.matmul(x[i : i + _HELD], weights["head"], out=space[: len(own) - i])[:, 0]  # each by itself: a product of many rounds by their places
                            if biased:
                                z += weights["head_bias"]
                            have[i : i + _HELD, n + j] = _next(z, temperature, k, uniform[i : i + _HELD, j])
                    out[(offsets[own] + length[own])[:, None] + np.arange(new)] = have[:, n:]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([b.column("key"), lists], names=[key, "ids"])

    kind = prompts.schema[key].dataType.simpleString()
    spark = prompts.sparkSession
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # each prompt is much work
    return prompts.select(F.col(key).alias("key"), F.col(ids).alias("ids"), F.xxhash64(key).alias("h")).repartition(spread, "key").mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def save_model(spark: SparkSession, path: str, weights: dict[str, np.ndarray], shape: Shape, vocab: DataFrame) -> None:
    """Keep weights, shape and vocabulary together, so that a text is decoded with the vocabulary the model was trained with."""
    rows = [(name, list(w.shape), str(w.dtype), w.tobytes()) for name, w in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, kind string, data binary").write.parquet(f"{path}/weights")
    spark.createDataFrame([tuple(asdict(shape).values())], ", ".join(f"{f.name} {'boolean' if f.name == 'prototype' else 'int'}" for f in fields(Shape))).write.parquet(f"{path}/shape")
    vocab.select("ch", "id").write.parquet(f"{path}/vocab")


def load_model(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], Shape, DataFrame]:
    """Weights, shape and vocabulary (ch, id) as they were kept."""
    weights = {r.name: np.frombuffer(r.data, r.kind).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/weights").collect()}
    return weights, Shape(**spark.read.parquet(f"{path}/shape").first().asDict()), spark.read.parquet(f"{path}/vocab")


def last_logits(prompts: DataFrame, weights: dict[str, np.ndarray], shape: Shape, key: str = "prompt_id", ids: str = "ids") -> DataFrame:
    """key, logits behind the last of each prompt's identifiers, of which the model sees the last `context`; null for an empty or null prompt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if not x else logits(weights, shape, np.array([x[-shape.context :]]), last=True)[0, 0].tolist() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.list_(pa.float64()))], names=[key, "logits"])

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, logits array<double>")
