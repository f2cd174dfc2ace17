"""Resumable enrichment: new files are read one by one, what a memo already holds isn't computed again.

The stream's checkpoint takes the place of saved cursors; each engine has a stream of its own, so
engines advance independently and `finish` waits for all of them. Memo and state are kept as
versions (see there): a batch adds what it brings and reads only its own keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rank import memo_misses
from .versions import Versions

Compute = Callable[[DataFrame], DataFrame]


def record_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """Records (JSON lines) of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def _most(df: DataFrame) -> DataFrame:
    return df.groupBy("kd").agg(F.max("n").alias("n"))


def memo(spark: SparkSession, path: str, every: int = 16) -> Versions:
    """The computed counts by key."""
    return Versions(spark, path, "kd string, n bigint", _most, every, "kd")


def enrich(records: DataFrame, compute: Compute, memo_path: str, out_path: str, checkpoint: str, keep: Sequence[str], every: int = 16) -> StreamingQuery:
    """Append records with their n to out_path; records has kd, compute turns a table of keys into (kd, n).

    A batch computes only keys that the memo lacks and adds them to it. Output goes into a folder
    for each batch that is overwritten, so that a batch which is run again after a failure neither
    repeats nor loses rows.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        held = memo(df.sparkSession, memo_path, every)
        held.compact(number)
        known = _most(held.read(number, df)).persist()
        fresh = compute(memo_misses(df, known)).select("kd", "n").persist()
        held.write(number, fresh)
        df.select(*keep, "kd").join(known.unionByName(_most(fresh)), "kd", "left").write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        for d in (fresh, known, df):
            d.unpersist()

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, path: str, columns: Sequence[str], key: Sequence[str], types: str, every: int = 16) -> Versions:
    """The largest counts by key; types are the columns of key and counts with their types."""
    return Versions(spark, path, types, lambda df: df.groupBy(*key).agg(*[F.max(c).alias(c) for c in columns]), every)


def repair(updates: DataFrame, state_path: str, checkpoint: str, columns: Sequence[str], key: Sequence[str], every: int = 16) -> StreamingQuery:
    """Keep a table of the largest counts seen: every batch adds the largest ones of its own rows; `largest` reads the table."""
    kinds = dict(updates.dtypes)
    types = ", ".join(f"`{c}` {kinds[c]}" for c in (*key, *columns))

    def batch(df: DataFrame, number: int) -> None:
        held = state(df.sparkSession, state_path, columns, key, types, every)
        held.compact(number)
        held.write(number, held.combine(df.select(*key, *columns)))

    return updates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def largest(spark: SparkSession, state_path: str, columns: Sequence[str], key: Sequence[str], types: str) -> DataFrame:
    """The table that repair keeps."""
    held = state(spark, state_path, columns, key, types)
    return held.combine(held.read())


def finish(streams: Sequence[StreamingQuery]) -> None:
    """Wait until all streams have read what there is."""
    for s in streams:
        s.awaitTermination()
