"""Near-duplicate records with small edits, by an exact join of their sets of neighbouring characters.

All pairs of neighbouring characters have one order, roughly the rarest first. A set that shares at
least the fraction `least` with another has their first common pair among its own first
n - ceil(least * n) + 1 of n (prefix filter), so records that are similar always meet there. A
meeting is dropped only where it can't reach the similarity: when too few pairs are left behind the
common one, or when the sets' bitmaps differ in too many places. What is left is verified on the
full sets.

Records with equal sets form one class beforehand, so copies meet once however many there are. A
pair that many classes hold among their first ones is split into pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut
from .blocks import batch_of, code_points, group_starts, mix, starts_of
from .expand import expand_pairs
from .lookalike import Look, prototypes

#: Pairs are counted in so many buckets, passed on in blocks; the counts only order the pairs and split frequent ones, so sharing a bucket costs no result.
BUCKETS, COUNT_BLOCKS = 1 << 20, 16
#: Shards of the key space for each shuffle partition; a task holds one shard at a time.
SHARDS_A_TASK = 32
#: Classes that meet under one key; more are split into chunks that meet two by two.
GROUP = 4096
#: Pairs that a task holds before it passes them on.
_MOST_HELD = 1 << 20
#: Rows of a block of sets, at most 16,384.
_ROWS = 1 << 13
#: Words of 64 bits of a set's bitmap.
_WORDS = 4
#: A set under one of its first pairs: half of the pair's hash, size, pairs from this one to the last, class, bitmap; which of two chunks (2: there is one).
_ENTRY = np.dtype([("key", "u4"), ("size", "i4"), ("left", "i4"), ("class", "i8"), ("side", "u1"), ("map", "u8", _WORDS)])
#: Slack of the bounds, so that rounding drops nothing.
_SLACK = 1e-6


class _Kept(dict):
    """Translation table that leaves letters, ideographs and digits."""

    def __missing__(self, p: int) -> int | None:
        self[p] = p if chr(p).isalnum() else None
        return self[p]


_KEPT = _Kept()


def bare(look: Look, title: str | None, paragraphs: list[str | None]) -> str:
    """Letters, ideographs and digits of title and elements in the consistent spelling."""
    return look.readable("\n".join([title or "", *(e or "" for e in paragraphs)])).translate(_KEPT)


def pair_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of neighbouring characters of all texts in a row, sorted within each, and how many each text has."""
    points, lengths = code_points(texts)
    codes, counts = [], []
    ends = np.cumsum(lengths)
    for k in range(0, len(texts), _ROWS):
        own = lengths[k : k + _ROWS]
        p = points[ends[k] - lengths[k] : ends[min(k + _ROWS, len(texts)) - 1]].astype(np.int64)
        row = np.repeat(np.arange(len(own)), own)
        inside = row[:-1] == row[1:]
        code = np.sort((row[:-1] << 42 | p[:-1] << 21 | p[1:])[inside])
        code = code[np.diff(code, prepend=-1) != 0]
        codes.append(code & (1 << 42) - 1)
        counts.append(np.bincount(code >> 42, minlength=len(own)))
    return (np.concatenate(codes), np.concatenate(counts)) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _texts(look: Look):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """rec_id, bare, and a digest of the set (class_a, class_b)."""
        for b in batches:
            texts = [bare(look, t, p) for t, p in zip(b.column("title").to_pylist(), b.column("paragraphs").to_pylist(), strict=True)]
            codes, count = pair_sets(texts)
            has = np.flatnonzero(count)
            first = starts_of(count)[has]
            marks = [np.add.reduceat(mix(codes.view(np.uint64) ^ np.uint64(s)), first).view(np.int64) for s in (5, 11)] if len(has) else [np.zeros(0, np.int64)] * 2
            own = pa.array(has)
            yield pa.RecordBatch.from_arrays([b.column("rec_id").take(own), pa.array(texts, pa.string()).take(own), pa.array(marks[0]), pa.array(marks[1])], names=["rec_id", "bare", "class_a", "class_b"])

    return run


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, counts: how many of the partition's sets hold pairs of each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        total += np.bincount(_bucket(mix(pair_sets(b.column("bare").to_pylist())[0].view(np.uint64))), minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_BLOCKS), pa.int32()), pa.array([x.tobytes() for x in np.split(total, COUNT_BLOCKS)], pa.binary())], names=["block", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def _frequencies(classes: DataFrame) -> np.ndarray:
    """Occurrences of the pairs of each bucket; its size is fixed, so it may pass through the driver."""
    kind = "block int, counts binary"
    total = np.zeros((COUNT_BLOCKS, BUCKETS // COUNT_BLOCKS), np.int64)
    for block, counts in classes.select("bare").mapInArrow(_counted, kind).repartition("block").mapInArrow(_added, kind).collect():
        total[block] = np.frombuffer(counts, np.int64)
    return np.minimum(total.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


def _chunked(h: np.ndarray, entries: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and entries; those of a frequent pair once for each pair of chunks that their own is in."""
    several = chunks > 1
    if not several.any():
        return h, entries
    out_h, out_e = [h[~several]], [entries[~several]]
    for c in np.unique(chunks[several]):
        own = np.flatnonzero(chunks == c)
        chunk = (mix(entries["class"][own].view(np.uint64)) % np.uint64(c)).astype(np.int64)
        for other in range(c):
            e = entries[own].copy()
            e["side"] = np.where(chunk == other, 2, chunk > other)
            low, high = np.minimum(chunk, other), np.maximum(chunk, other)
            moved = mix(h[own] + (low * c + high + 1).astype(np.uint64))
            e["key"] = moved >> np.uint64(32)
            out_h.append(moved)
            out_e.append(e)
    return np.concatenate(out_h), np.concatenate(out_e)


def _keys(shards: int, frequency, least: float, group: int):
    """The first pairs of every set, as (shard, entries): a row holds a block's entries of one shard."""

    def block(who: np.ndarray, texts: list[str], often: np.ndarray, ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes, count = pair_sets(texts)
        if not len(codes):
            return
        h = mix(codes.view(np.uint64))
        first, row = starts_of(count), np.repeat(np.arange(len(who)), count)
        bit = np.uint64(1) << (h & np.uint64(63))
        word = h >> np.uint64(6) & np.uint64(_WORDS - 1)
        maps = np.stack([np.bitwise_or.reduceat(np.where(word == w, bit, np.uint64(0)), first) for w in range(_WORDS)], 1)
        # One order of all pairs, the rarer ones first: a rank of the frequency, then the pair itself; the record stands before both.
        ordered = np.sort(row.astype(np.uint64) << np.uint64(50) | ranks[_bucket(h)] << np.uint64(42) | codes.view(np.uint64))
        h = mix(ordered & np.uint64((1 << 42) - 1))
        left = (first + count)[row] - np.arange(len(h))
        kept = left >= np.ceil(least * count - _SLACK)[row]
        h, row, left = h[kept], row[kept], left[kept]
        entries = np.zeros(len(h), _ENTRY)
        entries["key"] = h >> np.uint64(32)  # a chance meeting of equal halves fails the exact check
        entries["size"], entries["left"], entries["class"], entries["map"], entries["side"] = count[row], left, who[row], maps[row], 2
        h, entries = _chunked(h, entries, -(-often[_bucket(h)].astype(np.int64) // group))
        shard = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard.astype(np.uint64) << np.uint64(32) | entries["key"])
        shard, entries = shard[order], entries[order]
        begin = group_starts(shard)
        end = np.append(begin[1:], len(shard))
        columns = [np.ascontiguousarray(entries[n]) for n in _ENTRY.names]  # field by field, so that like bytes lie together
        packed = [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(begin, end, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(shard[begin]), pa.array(packed, pa.binary())], names=["shard", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequency.value
        ranks = np.minimum(16 * np.log2(1 + often.astype(np.float64)), 255).astype(np.uint64)
        for b in batches:
            who, texts = b.column("class").to_numpy(), b.column("bare").to_pylist()
            for k in range(0, len(who), _ROWS):
                yield from block(who[k : k + _ROWS], texts[k : k + _ROWS], often, ranks)

    return run


def _unpacked(block: bytes) -> np.ndarray:
    n, at = len(block) // _ENTRY.itemsize, 0
    out = np.empty(n, _ENTRY)
    for name in _ENTRY.names:
        kind = _ENTRY[name]
        out[name] = np.frombuffer(block, kind.base, n * int(np.prod(kind.shape)), at).reshape(n, *kind.shape)
        at += n * kind.itemsize
    return out


def _distinct_pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y = map(np.concatenate, zip(*held, strict=True))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = group_starts(x, y)
    return batch_of({"x": (x[first], pa.int64()), "y": (y[first], pa.int64())})


def _candidates(least: float):
    """x < y: classes that meet in a pair of the partition's shards and may be similar."""

    def meet(e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        e = e[np.lexsort((e["class"], e["key"]))]
        key, cls, size, left, maps, side = (np.ascontiguousarray(e[n]) for n in ("key", "class", "size", "left", "map", "side"))
        at, apart = np.arange(len(key)), 1
        while len(at):  # neighbours in a group, then those two apart, and so on
            at = at[at + apart < len(key)]
            at = at[key[at] == key[at + apart]]
            x, y = at, at + apart
            both = size[x].astype(np.int64) + size[y]
            # At the first common pair of two sets no more than these are common.
            fits = (np.minimum(left[x], left[y]) * (1 + least) >= least * both - _SLACK) & ((side[x] != side[y]) | (side[x] == 2))
            x, y, both = x[fits], y[fits], both[fits]
            # Each place in which the bitmaps differ is due to another pair that only one set has.
            fits = np.bitwise_count(maps[x] ^ maps[y]).sum(1, dtype=np.int64) * (1 + least) <= (1 - least) * both + _SLACK
            x, y = cls[x[fits]], cls[y[fits]]
            if len(x):
                yield np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
            apart += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards arrive one after the other."""
        now, parts, held, n = None, [], [], 0
        for b in batches:
            for shard, block in zip(b.column("shard").to_pylist(), b.column("entries").to_pylist(), strict=True):
                if shard != now and parts:
                    for pair in meet(np.concatenate(parts)):
                        held.append(pair)
                        n += len(pair[0])
                        if n > _MOST_HELD:
                            yield _distinct_pairs(held)
                            held, n = [], 0
                    parts = []
                now = shard
                parts.append(_unpacked(block))
        for pair in meet(np.concatenate(parts)) if parts else ():
            held.append(pair)
            n += len(pair[0])
            if n > _MOST_HELD:
                yield _distinct_pairs(held)
                held, n = [], 0
        if held:
            yield _distinct_pairs(held)

    return run


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """class_a, class_b of the rows whose sets are similar enough."""
        for b in batches:
            n = b.num_rows
            codes, count = pair_sets(b.column("bare_x").to_pylist() + b.column("bare_y").to_pylist())
            row = np.repeat(np.arange(2 * n) % n, count)
            order = np.lexsort((codes, row))
            same = (codes[order][1:] == codes[order][:-1]) & (row[order][1:] == row[order][:-1])
            common = np.bincount(row[order][1:][same], minlength=n)
            good = pa.array(np.flatnonzero(common >= least * (count[:n] + count[n:] - common)))
            yield pa.RecordBatch.from_arrays([b.column("x").take(good), b.column("y").take(good)], names=["class_a", "class_b"])

    return run


def text_sets(df: DataFrame) -> DataFrame:
    """rec_id, bare, class_a, class_b of each row with text in its paragraphs; records with equal sets have the same class_a and class_b."""
    rows = df.where("rec_id is not null").where(F.exists("paragraphs", lambda e: F.regexp_replace(e, r"(?U)[\s\p{Cf}]+", "") != ""))
    return rows.select("rec_id", "title", "paragraphs").mapInArrow(_texts(Look(prototypes(df.sparkSession))), "rec_id long, bare string, class_a long, class_b long")


def similar_classes(sets: DataFrame, least: float = 0.5, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(members: rec_id, class), (links: class_a < class_b of different sets with at least the given similarity).

    class is the least rec_id with the same set. sets should be kept (see cut), for it is read several times.
    """
    spark = sets.sparkSession
    classes = cut(sets.groupBy("class_a", "class_b").agg(F.min("rec_id").alias("class"), F.first("bare").alias("bare")))
    members = sets.select("rec_id", "class_a", "class_b").distinct().join(classes.drop("bare"), ["class_a", "class_b"]).select("rec_id", "class")
    shards = SHARDS_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    often = spark.sparkContext.broadcast(_frequencies(classes))  # 4 MB whatever the data
    keys = classes.select("class", "bare").mapInArrow(_keys(shards, often, least, group), "shard int, entries binary")
    met = keys.repartition("shard").sortWithinPartitions("shard").mapInArrow(_candidates(least), "x long, y long").distinct()
    one = classes.select(F.col("class").alias("x"), F.col("bare").alias("bare_x"))
    two = classes.select(F.col("class").alias("y"), F.col("bare").alias("bare_y"))
    links = met.join(one, "x").join(two, "y").select("x", "y", "bare_x", "bare_y").mapInArrow(_verified(least), "class_a long, class_b long")
    return members, links


def version_pairs(df: DataFrame, least: float = 0.5) -> DataFrame:
    """rec_a < rec_b: records whose similarity (see text_sets) is at least `least`; copies count as well.

    df has rec_id, title, paragraphs. Records without visible text in paragraphs, and texts of fewer
    than two letters, ideographs or digits (which have no pairs of neighbours), are similar to none.
    Null titles count as empty. Rows that repeat a record count once; other columns are ignored.
    """
    members, links = similar_classes(cut(text_sets(df)), least)
    copies = members.groupBy("class").count().where("count > 1").select(F.col("class").alias("a"), F.col("class").alias("b"))
    pairs = links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).unionByName(copies)
    return expand_pairs(pairs, members.withColumnRenamed("class", "group"))


def version_groups(df: DataFrame, least: float = 0.5) -> DataFrame:
    """rec_id, class_id (least rec_id with the same text set), group_id (least rec_id reached through similar texts), links (similar classes)."""
    members, links = similar_classes(cut(text_sets(df)), least)
    links = cut(links)
    groups = connected_components(links, "class_a", "class_b")
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    out = members.join(groups.withColumnRenamed("id", "class"), "class", "left").join(degree, "class", "left")
    return out.select("rec_id", F.col("class").alias("class_id"), F.coalesce("component", "class").alias("group_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
