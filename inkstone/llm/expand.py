"""Pairs of records out of pairs of groups, spread evenly however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records of a group that stand under one key, on average.
CHUNK = 1024


def expand_pairs(pairs: DataFrame, members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rec_a < rec_b: the records of each pair of groups.

    pairs has a and b (each pair once, a and b may be the same group), members rec_id and group. A
    group's records are split into chunks by a hash of rec_id, and each pair of chunks has a key of
    its own, so a group that holds a third of all records is spread over as many keys as its pairs need.
    """
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
    for t in "ab":
        pairs = pairs.join(sizes.select(F.col("group").alias(t), F.col("chunks").alias(f"chunks_{t}")), t)
    for t in "ab":
        pairs = pairs.withColumn(f"chunk_{t}", F.explode(F.sequence(F.lit(0), F.col(f"chunks_{t}") - 1)))
    own = F.col("a") == F.col("b")
    pairs = pairs.where(~own | (F.col("chunk_a") <= F.col("chunk_b"))).select("a", "chunk_a", "b", "chunk_b")
    placed = members.join(sizes, "group").select("group", F.pmod(F.xxhash64("rec_id"), F.col("chunks")).cast("int").alias("chunk"), "rec_id")
    for t, r in (("a", "x"), ("b", "y")):
        pairs = pairs.join(placed.select(F.col("group").alias(t), F.col("chunk").alias(f"chunk_{t}"), F.col("rec_id").alias(r)), [t, f"chunk_{t}"])
    once = (F.col("a") != F.col("b")) | (F.col("chunk_a") < F.col("chunk_b")) | (F.col("x") < F.col("y"))
    return pairs.where(once).select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))
