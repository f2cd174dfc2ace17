"""Filling fixed-capacity containers: bounded-space online best-fit.

A fixed number of bins is open at a time. A bitset holds a bit for each free space that some open
bin has; the bin with the least sufficient space is found by shifting the bitset, and when too many
bins are open the fullest closes first.

Every task packs its own split. Two parameters, both off in the plain method, leave less room over:
look_ahead lets so many items for each open bin gather, which are then offered the largest first;
join_open packs the bins that are still open at the splits' ends together by the same procedure, as
items as large as their contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Open bins, and items for each of them that are looked at together.
OPEN_BINS, LOOK_AHEAD = 1024, 4
#: Splits whose open bins are packed together.
_TOGETHER = 64


class BestFit:
    def __init__(self, capacity: int, most_open: int = OPEN_BINS):
        self.capacity, self.most_open = capacity, most_open
        self.spaces = 0  # bit f: an open bin has f free
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        held = self.by_space[space].pop()
        if not self.by_space[space]:
            self.spaces &= ~(1 << space)
        return held

    def put(self, size: int) -> tuple[int, int]:
        """Bin and place in it for an item of 0..capacity."""
        fitting = self.spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            into = self._take(space)
        else:
            if self.open >= self.most_open:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
                self.open -= 1
            into, space = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = space - size
        if left:
            self.by_space[left].append(into)
            self.spaces |= 1 << left
        else:
            self.open -= 1
        return into, self.capacity - space

    def still_open(self) -> list[tuple[int, int]]:
        """Bins that are open, and how much they hold."""
        return [(b, self.capacity - f) for f in range(1, self.capacity + 1) for b in self.by_space[f]]


def _pack(capacity: int, most_open: int, look_ahead: int, kind: pa.DataType):
    """Rows (key, piece, begin, size) to placements with bin and place; bins still open follow with bin and size only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        fit, block = BestFit(capacity, most_open), max(look_ahead, 1) * most_open
        held: list[tuple] = []

        def placed(rows: list[tuple]) -> pa.RecordBatch:
            if look_ahead:
                rows = sorted(rows, key=lambda r: -r[3])
            at = [fit.put(r[3]) for r in rows]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array([first + b for b, _ in at], pa.int64()), pa.array([p for _, p in at], pa.int64()), pa.array([False] * len(rows))],
                names=["key", "piece", "begin", "size", "bin", "place", "left"],
            )

        for b in batches:
            held += zip(*(b.column(c).to_pylist() for c in ("key", "piece", "begin", "size")), strict=True)
            while len(held) >= block:
                yield placed(held[:block])
                held = held[block:]
        yield placed(held)
        left = fit.still_open()
        n = len(left)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, kind), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array([s for _, s in left], pa.int64()), pa.array([first + b for b, _ in left], pa.int64()), pa.nulls(n, pa.int64()), pa.array([True] * n)],
            names=["key", "piece", "begin", "size", "bin", "place", "left"],
        )

    return run


def pack_sequences(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, most_open: int = OPEN_BINS, look_ahead: int = LOOK_AHEAD, join_open: bool = True) -> DataFrame:
    """key, piece, piece_start, n_tokens, seq_id, seq_offset: where each item goes.

    key is a bigint. An item of more than the capacity is cut into pieces of exactly the capacity and a
    rest (piece numbers from 0, piece_start is the place in the item); no other item is cut. Items of
    size 0 or null have one piece of size 0 in some sequence. seq_id is unique but not dense. Keys
    may be null or repeat: every row is an item of its own. look_ahead 0 offers the items one by one
    as they come, and with join_open off nothing is packed twice: the plain online method.
    """
    n = F.coalesce(F.col(size), F.lit(0))
    last = F.greatest(F.ceil(n / F.lit(capacity)) - 1, F.lit(0)).cast("int")
    pieces = sizes.select(F.col(key).cast("long").alias("key"), n.cast("long").alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    begin = F.col("piece").cast("long") * capacity
    pieces = pieces.select("key", "piece", begin.alias("begin"), F.least(F.col("n") - begin, F.lit(capacity)).alias("size"))
    schema = "key long, piece int, begin long, size long, bin long, place long, left boolean"
    mixed = F.xxhash64("key", "piece")
    pack = _pack(capacity, most_open, look_ahead, pa.int64())
    offered = pieces.repartition(mixed).sortWithinPartitions(mixed, "key", "piece", "size").mapInArrow(pack, schema)
    if not join_open:
        return offered.where("not left").select(F.col("key").alias(key), "piece", F.col("begin").alias("piece_start"), F.col("size").alias("n_tokens"), F.col("bin").alias("seq_id"), F.col("place").alias("seq_offset"))
    placed = cut(offered)
    left = placed.where("left").select(F.col("bin").alias("key"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("begin"), "size")
    parts = max(1, placed.rdd.getNumPartitions() // _TOGETHER)
    joined = cut(left.repartition(parts, "key").sortWithinPartitions(F.xxhash64("key"), "key").mapInArrow(pack, schema).where("not left"))
    moved = joined.select(F.col("key").alias("bin"), F.col("bin").alias("seq"), F.col("place").alias("base"))
    out = placed.where("not left").join(moved, "bin", "left")
    # Sequences of the second round are numbered below zero, those that closed in the first from zero on.
    seq = F.coalesce(-1 - F.col("seq"), F.col("bin"))
    return out.select(F.col("key").alias(key), "piece", F.col("begin").alias("piece_start"), F.col("size").alias("n_tokens"), seq.alias("seq_id"), (F.col("place") + F.coalesce("base", F.lit(0))).alias("seq_offset"))


def packing_faults(packed: DataFrame, sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 2048) -> DataFrame:
    """One row: items, and how many of them miss tokens or have too many (wrong_size) or are cut though they fit (needlessly_cut); sequences that overflow, and places that overlap.

    Keys are distinct.
    """
    n = F.coalesce(F.col(size), F.lit(0))
    got = packed.groupBy(key).agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"))
    each = sizes.select(key, n.alias("n")).join(got, key, "left")
    items = each.agg(F.count("*").alias("items"), F.count_if(F.coalesce(F.col("got"), F.lit(-1)) != F.col("n")).alias("wrong_size"), F.count_if((F.col("n") <= capacity) & (F.col("pieces") > 1)).alias("needlessly_cut"))
    w = Window.partitionBy("seq_id").orderBy("seq_offset", "n_tokens")
    end = F.col("seq_offset") + F.col("n_tokens")
    placed = packed.select("seq_id", F.coalesce(F.lag(end).over(w) > F.col("seq_offset"), F.lit(False)).alias("overlap"), end.alias("end"))
    per = placed.groupBy("seq_id").agg(F.count_if("overlap").alias("o"), F.max("end").alias("e"))
    sequences = per.agg(F.count_if(F.col("e") > capacity).alias("overflowing"), F.coalesce(F.sum("o"), F.lit(0)).alias("overlapping"))
    return items.withColumn("j", F.lit(0)).join(F.broadcast(sequences.withColumn("j", F.lit(0))), "j").drop("j")  # a row each


def sequence_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """seq_id, pieces, used, free of each sequence."""
    return packed.groupBy("seq_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("used")).select("seq_id", "pieces", "used", (F.lit(capacity) - F.col("used")).alias("free"))
