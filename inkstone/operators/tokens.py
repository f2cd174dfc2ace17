"""Characters as tokens: vocabulary, encoding, decoding, next-character pairs, sampled windows."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.points import code_points

_POINTS = 0x110000


def char_vocab(df: DataFrame, text: str = "text", *more: str) -> DataFrame:
    """ch, id: distinct characters numbered from 0 in code-point order; `more` are characters the corpus holds besides (separators).

    The window has one row for each distinct character (1,114,112 at most), never for each character.
    """
    chars = df.select(F.explode(T.characters(F.col(text))).alias("ch")).where("ch <> ''").distinct()
    if more:
        chars = chars.unionByName(df.sparkSession.createDataFrame([(c,) for c in more], "ch string")).distinct()
    return chars.select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).alias("id"))


def total_chars(df: DataFrame, text: str = "text", separator: int = 2) -> DataFrame:
    """total: characters of the corpus with its separators; 0 for an empty one."""
    n = F.count(F.col(text))
    return df.agg((F.coalesce(F.sum(F.length(text)), F.lit(0)) + F.greatest(n - 1, F.lit(0)) * separator).cast("long").alias("total"))


def _ids_by_point(vocab: DataFrame) -> np.ndarray:
    """Identifier of each code point, -1 outside the vocabulary (which has 1,114,112 entries at most)."""
    ids = np.full(_POINTS, -1, np.int32)
    for ch, i in vocab.select("ch", "id").collect():
        ids[ord(ch)] = i
    return ids


def encode(df: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text", strict: bool = True) -> DataFrame:
    """key, ids of each non-null text. strict: a character outside the vocabulary is an error; otherwise it is left out."""
    table = _ids_by_point(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, lengths = code_points(b.column("text").to_pylist())
            ids = table[points]
            if strict and len(ids) and ids.min() < 0:
                raise ValueError(f"Character not found in vocabulary: {chr(points[ids < 0][0])!r}")
            row = np.repeat(np.arange(len(lengths)), lengths)[ids >= 0]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lengths)))])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[ids >= 0], pa.int32()))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, vocab: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text of each list of identifiers; an unknown identifier is an error."""
    points = np.zeros(0, np.uint32)
    pairs = sorted((i, ord(ch)) for ch, i in vocab.select("ch", "id").collect())  # bounded by the code space
    if pairs:
        points = np.zeros(pairs[-1][0] + 1, np.uint32)
        points[[i for i, _ in pairs]] = [p for _, p in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else points[np.asarray(x, np.int64)].tobytes().decode("utf-32-le") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")


def vocab_artefact(vocab: DataFrame, input_file: str) -> DataFrame:
    """One row: input_file, vocab_size, stoi (map), itos (map with the identifiers as strings)."""
    pairs = F.array_sort(F.collect_list(F.struct("id", "ch")))
    row = vocab.agg(F.count("*").alias("vocab_size"), pairs.alias("p"))
    stoi = F.map_from_entries(F.transform("p", lambda x: F.struct(x["ch"], x["id"])))
    itos = F.map_from_entries(F.transform("p", lambda x: F.struct(x["id"].cast("string"), x["ch"])))
    return row.select(F.lit(input_file).alias("input_file"), "vocab_size", stoi.alias("stoi"), itos.alias("itos"))


def bigram_counts(df: DataFrame, text: str = "text", key: str = "doc_id", separator: str = "\n\n") -> DataFrame:
    """x, y, n: how often character y follows character x in the corpus, the documents in key order joined by the separator.

    A document brings the separator behind it (but for the last) and the separator's last character
    before it (but for the first), so every pair of the corpus lies in one document's piece.
    """
    has = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    ends = has.agg(F.min("k").alias("first"), F.max("k").alias("last")).first()
    piece = F.concat(F.when(F.col("k") == F.lit(ends.first), "").otherwise(separator[-1:]), "t", F.when(F.col("k") == F.lit(ends.last), "").otherwise(separator)) if ends.first is not None else F.col("t")
    c = has.select(T.characters(piece).alias("c"))
    pairs = c.select(F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))).alias("x"), F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))).alias("y"))).alias("p"))
    return pairs.select("p.x", "p.y").groupBy("x", "y").agg(F.count("*").alias("n"))


def unknown_characters(df: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """ch, n: the characters that a strict encoding would stop at, and how often they occur."""
    chars = df.select(F.explode(T.characters(F.col(text))).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return chars.join(vocab.select("ch"), "ch", "left_anti")


def batch_starts(n: int, length: int, batch: int, batches: int, seed: int = 42, rng: random.Random | None = None) -> list[tuple[int, int, int]]:
    """(batch number, row, start): starts drawn uniformly from 0..n-length-1 with replacement, reproducibly."""
    if n - length - 1 <= 0:
        raise ValueError("the text is too short for the window length")
    rng = rng or random.Random(seed)
    return [(k, b, rng.randint(0, n - length - 1)) for k in range(batches) for b in range(batch)]


def first_start(n: int, length: int) -> int:
    """The start of the first window; a text without a whole window and its successor is an error."""
    if n <= length:
        raise ValueError("the text is too short for the window length")
    return 0


def batch_plan(n_train: int, n_val: int, length: int, batch: int, first_step: int, last_step: int, eval_every: int = 200, eval_batches: int = 5, seed: int = 42) -> list[tuple[int, str, int, int, int]]:
    """(step, split, batch number, row, start) of a training run, in drawing order from one generator.

    Each step draws one training batch, an evaluation step then eval_batches validation batches. A
    run that is resumed begins with a fresh generator, so its draws start over; a first step
    beyond the last is an error.
    """
    if first_step > last_step:
        raise ValueError("the target step has been reached already")
    rng, plan = random.Random(seed), []
    for step in range(first_step, last_step + 1):
        plan += [(step, "train", k, b, s) for k, b, s in batch_starts(n_train, length, batch, 1, rng=rng)]
        if step % eval_every == 0:
            plan += [(step, "val", k, b, s) for k, b, s in batch_starts(n_val, length, batch, eval_batches, rng=rng)]
    return plan


def plan_frame(spark, plan: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(plan), "step int, split string, batch int, row int, start long")


def long_ids(ids: Column) -> Column:
    """Identifiers as 64-bit integers, as tensors take them."""
    return ids.cast("array<bigint>")


def batch_rows(windowed: DataFrame, by: Sequence[str], row: str = "row") -> DataFrame:
    """Rows of a batch stacked in order: by, x and y as arrays of texts (a batch has a fixed number of rows)."""
    pairs = F.array_sort(F.collect_list(F.struct(row, "x", "y")))
    g = windowed.groupBy(*by).agg(pairs.alias("p"))
    return g.select(*by, F.transform("p", lambda v: v["x"]).alias("x"), F.transform("p", lambda v: v["y"]).alias("y"))


def encoded_preview(ids: DataFrame, text: str, split_at: int, first: int = 200, each: int = 100) -> DataFrame:
    """ids has pos, id. One row: the first characters, their identifiers, and the beginnings of both splits."""
    some = ids.where((F.col("pos") < first) | ((F.col("pos") >= split_at) & (F.col("pos") < split_at + each)))
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "id")))), lambda v: v["id"])
    p = F.col("pos")
    return some.agg(
        listed(p < first).alias("first_encoded_ids"), listed(p < min(each, split_at)).alias("train_preview_ids"), listed((p >= split_at) & (p < split_at + each)).alias("val_preview_ids")
    ).select(F.lit(text[:first]).alias("first_chars"), "*")
