"""Frequency of every distinct term over the whole collection, by dense count arrays.

A global integer dictionary numbers the terms in code-point order. Copies of a record meet in one task. Each task encodes its records
through the dictionary into identifiers, counts occurrences and record presence in dense arrays,
and sends the arrays cut into identifier ranges; the arrays are summed by range. A task sends one
array element for a term however often the term occurs, so frequent terms cost no more than rare
ones.

Terms are single characters, of which there are at most 1,114,112: the dictionary's size on the
driver and in each task has that proven bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import code_points

#: Identifiers in one range of the count arrays.
RANGE = 4096
_POINTS = 0x110000
#: Rows of code points are counted at once up to this many characters.
_BLOCK = 1 << 21


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(_POINTS, bool)
    for b in batches:
        points, _ = code_points(b.column("body").to_pylist())
        seen[points] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32())], names=["point"])


def dictionary(texts: DataFrame) -> np.ndarray:
    """Code points that occur in column body, in order; a term's identifier is its place."""
    found = texts.select("body").mapInArrow(_distinct, "point int").distinct()
    return np.array(sorted(r.point for r in found.collect()), dtype=np.int64)  # at most 1,114,112


def _counts(points: np.ndarray):
    identifier = np.zeros(_POINTS, np.int32)
    identifier[points] = np.arange(len(points))
    n = len(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences, presence, records = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        before = None
        for b in batches:
            rec = b.column("rec_id").to_pylist()
            new = [i for i, r in enumerate(rec) if r != (rec[i - 1] if i else before)]  # copies of a record follow one another
            before = rec[-1] if rec else before
            texts = b.column("body").take(pa.array(new, pa.int64())).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < _BLOCK):
                    size += len(texts[stop])
                    stop += 1
                found, lengths = code_points(texts[start:stop])
                ids = identifier[found]
                occurrences += np.bincount(ids, minlength=n)
                row = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
                pairs = np.sort(row * n + ids)
                pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
                presence += np.bincount(pairs % n, minlength=n)
                records += stop - start
                start = stop
        for k in range(0, n, RANGE):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k // RANGE], pa.int32()), pa.array([records if k == 0 else 0], pa.int64())] + [pa.array([x[k : k + RANGE]], pa.list_(pa.int64())) for x in (occurrences, presence)],
                names=["range", "records", "occurrences", "presence"],
            )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The arrays of each range added up; a task holds one range at a time."""
    now, held, records = None, None, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([records], pa.int64())] + [pa.array([x], pa.list_(pa.int64())) for x in held], names=["range", "records", "occurrences", "presence"])

    for b in batches:
        for i, (at, more) in enumerate(zip(b.column("range").to_pylist(), b.column("records").to_pylist(), strict=True)):
            arrays = np.stack([b.column(c).slice(i, 1).flatten().to_numpy() for c in ("occurrences", "presence")])
            if at != now:
                if now is not None:
                    yield done()
                now, held, records = at, np.zeros_like(arrays), 0
            held += arrays
            records += more
    if now is not None:
        yield done()


def term_counts(df: DataFrame, rare_most: int = 2, common_share: float = 0.2) -> DataFrame:
    """term, term_id, occurrences, records, collection_records, mark of every character of the paragraphs.

    Each record (rec_id) counts once however often it was sent. Records are those with at least one
    character in their elements. mark is 'rare' (in at most rare_most records), 'common' (in more
    than the given share of the records) or 'useful'. A term both rare and common, possible in a
    tiny collection only, is rare. Nulls and empty elements hold no terms; an empty table gives an
    empty result.
    """
    spark = df.sparkSession
    rows = df.where("rec_id is not null").select("rec_id", F.concat_ws("", "paragraphs").alias("body")).where("body <> ''")
    points = dictionary(rows)
    schema = "term string, term_id int, occurrences long, records long, collection_records long, mark string"
    if not len(points):
        return spark.createDataFrame([], schema)
    kind = "range int, records long, occurrences array<long>, presence array<long>"
    arrays = rows.repartition("rec_id").sortWithinPartitions("rec_id").mapInArrow(_counts(points), kind)
    summed = cut(arrays.repartition("range").sortWithinPartitions("range").mapInArrow(_added, kind))  # a row for each range of the code space
    whole = summed.agg(F.sum("records")).first()[0]
    each = summed.select("range", F.posexplode(F.arrays_zip("occurrences", "presence")).alias("place", "v"))
    terms = spark.createDataFrame(pa.table({"term_id": pa.array(range(len(points)), pa.int32()), "term": [chr(p) for p in points.tolist()]}))
    counted = each.select((F.col("range") * RANGE + F.col("place")).alias("term_id"), F.col("v.occurrences").alias("occurrences"), F.col("v.presence").alias("records"), F.lit(whole).alias("collection_records"))
    mark = F.when(F.col("records") <= rare_most, "rare").when(F.col("records") / F.col("collection_records") > F.lit(common_share), "common").otherwise("useful")
    return terms.join(counted, "term_id").select("term", "term_id", "occurrences", "records", "collection_records", mark.alias("mark"))


def marked_terms(df: DataFrame, rare_most: int = 2, common_share: float = 0.2) -> DataFrame:
    """term, mark of the terms that are too rare or too common to be useful."""
    return term_counts(df, rare_most, common_share).where("mark <> 'useful'").select("term", "mark")
