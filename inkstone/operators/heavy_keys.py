"""Per-key results where a few keys hold most records: dense accumulator arrays.

Rows are spread over splits by a row key, never by the grouping key, so a split is as large as any
other whatever its keys. A split encodes its keys by a dictionary and adds its rows up in dense
arrays, one place for each key; the dictionary is cut into blocks by the keys' hash, and a block's
keys travel with its piece of every array. The pieces of a block meet in one task, which numbers the
block's keys anew over all splits and adds the pieces place by place. A split sends one array
element for a key however many of its rows hold the key, and no dictionary is ever collected or
broadcast, so the number of keys has no bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Blocks of the dictionary for each shuffle partition; a task holds one block at a time.
BLOCKS_A_TASK = 8
#: Array elements that are held before they are added up or passed on.
_HELD = 1 << 20


def _reduced(keys: pa.Array, sums: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct keys, their sums (measures in rows, exact in 64 bits) and the first place of each."""
    encoded = keys.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.diff(codes[order], prepend=-1))
    return encoded.dictionary, np.add.reduceat(sums[:, order], first, axis=1) if len(first) else sums[:, :0], order[first]


class _Accumulator:
    """Keys with a dense array for each measure, grown as keys appear."""

    def __init__(self, measures: int):
        self.measures, self.n = measures, 0
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def add(self, keys: pa.Array, sums: np.ndarray, blocks: np.ndarray) -> None:
        found, added, at = _reduced(keys, sums)
        self.parts.append((found, added, blocks[at]))
        self.n += len(found)

    def shrink(self) -> None:
        if len(self.parts) > 1:
            keys, sums, blocks = (list(p) for p in zip(*self.parts, strict=True))
            self.parts, self.n = [], 0
            self.add(pa.concat_arrays(keys), np.concatenate(sums, 1), np.concatenate(blocks))


def _split(fields: Sequence[str], measures: Sequence[str]):
    names = ["block", "key_field", "keys", "records", *measures]

    def sent(field: str, a: _Accumulator) -> Iterator[pa.RecordBatch]:
        a.shrink()
        for keys, sums, blocks in a.parts:
            order = np.argsort(blocks, kind="stable")
            first = np.flatnonzero(np.diff(blocks[order], prepend=-1))
            bounds = pa.array(np.append(first, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, keys.take(pa.array(order)))] + [pa.ListArray.from_arrays(bounds, pa.array(s[order], pa.int64())) for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array(blocks[order][first], pa.int32()), pa.array([field] * len(first), pa.string()), *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {f: _Accumulator(1 + len(measures)) for f in fields}
        for b in batches:
            values = np.stack([np.ones(b.num_rows, np.int64), *(pc.fill_null(b.column(f"m{k}"), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(measures)))])
            for k, f in enumerate(fields):
                has = np.flatnonzero(b.column(f"k{k}").is_valid().to_numpy(zero_copy_only=False))
                held[f].add(b.column(f"k{k}").take(pa.array(has)), values[:, has], b.column(f"b{k}").to_numpy(zero_copy_only=False)[has])
                if held[f].n > _HELD:
                    held[f].shrink()
                    if held[f].n > _HELD // 2:  # as many distinct keys: what is sent now is added to the rest by its block
                        yield from sent(f, held[f])
                        held[f] = _Accumulator(1 + len(measures))
        for f in fields:
            yield from sent(f, held[f])

    return run


def _summed(measures: Sequence[str]):
    names = ["key_field", "key_value", "records", *measures]

    def done(field: str, a: _Accumulator) -> Iterator[pa.RecordBatch]:
        a.shrink()
        for keys, sums, _ in a.parts:
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(keys), pa.string()), keys, *(pa.array(s, pa.int64()) for s in sums)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks arrive in order; the arrays of a block are added up as they come."""
        now, held = None, None
        for b in batches:
            for i, at in enumerate(zip(b.column("block").to_pylist(), b.column("key_field").to_pylist(), strict=True)):
                if at != now:
                    if now is not None:
                        yield from done(now[1], held)
                    now, held = at, _Accumulator(1 + len(measures))
                keys = b.column("keys").slice(i, 1).flatten()
                held.add(keys, np.stack([b.column(m).slice(i, 1).flatten().to_numpy() for m in names[2:]]), np.zeros(len(keys), np.int32))
                if held.n > _HELD and len(held.parts) > 8:
                    held.shrink()
        if now is not None:
            yield from done(now[1], held)

    return run


def _records(df: DataFrame, fields: Sequence[str], measures: Sequence[str], row_key: str) -> DataFrame:
    """k0.. (keys), m0.. (measures) of each record once."""
    cols = [F.col(f).alias(f"k{i}") for i, f in enumerate(fields)] + [F.col(m).cast("long").alias(f"m{i}") for i, m in enumerate(measures)]
    return df.where(F.col(row_key).isNotNull()).select(F.col(row_key).alias("r"), *cols).dropDuplicates(["r"])


def _totals(rows: DataFrame, fields: Sequence[str], measures: Sequence[str], blocks: int | None) -> DataFrame:
    spark = rows.sparkSession
    blocks = blocks or BLOCKS_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.drop("r").withColumns({f"b{i}": F.coalesce(F.pmod(F.xxhash64(f"k{i}"), F.lit(blocks)), F.lit(0)).cast("int") for i in range(len(fields))})
    kind = ", ".join(f"`{m}` array<long>" for m in ("records", *measures))
    arrays = numbered.mapInArrow(_split(fields, measures), f"block int, key_field string, keys array<string>, {kind}")
    met = arrays.repartition("block").sortWithinPartitions("block", "key_field")
    return met.mapInArrow(_summed(measures), "key_field string, key_value string, " + ", ".join(f"`{m}` long" for m in ("records", *measures)))


def key_totals(df: DataFrame, fields: Sequence[str], measures: Sequence[str] = (), row_key: str = "rec_id", blocks: int | None = None) -> DataFrame:
    """key_field, key_value, records and the sum of each measure, for each non-null value of each string field.

    Rows with the same row_key count once (they repeat the same content); rows with a null one are
    left out. Measures are integers added in 64 bits, null counts as 0. The empty string is a value
    as any other. An empty table gives an empty result.
    """
    return _totals(_records(df, fields, measures, row_key), fields, measures, blocks)


def heavy_keys(df: DataFrame, fields: Sequence[str], row_key: str = "rec_id", percent: int = 2, blocks: int | None = None) -> DataFrame:
    """key_field, key_value of the values that hold at least `percent` % of all records (null values count in the total).

    The number of records is added up in the same arrays, as the one key of a field of its own, so the table is read once.
    """
    rows = _records(df, fields, (), row_key).withColumn(f"k{len(fields)}", F.lit(""))
    totals = cut(_totals(rows, [*(f"+{f}" for f in fields), "all"], (), blocks))
    whole = totals.where("key_field = 'all'").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    named = F.substring("key_field", 2, 1 << 20)
    return totals.where((F.col("key_field") != "all") & (F.col("records") * 100 >= F.lit(whole * percent))).select(named.alias("key_field"), "key_value")
