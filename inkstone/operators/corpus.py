"""One corpus out of many documents: offsets by prefix sums, subsets by byte budget, blocks and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut


def offsets(df: DataFrame, key: str, size: Column, gap: int = 0) -> DataFrame:
    """key, size, start: sum of the sizes (and gaps) of all rows with lesser keys. Keys are distinct.

    The rows are range-partitioned by key and summed within each range; only one number for each
    range passes through the driver.
    """
    slim = df.select(key, size.cast("long").alias("size")).repartitionByRange(F.col(key))
    slim = cut(slim.withColumn("part", F.spark_partition_id()))
    totals = sorted(tuple(r) for r in slim.groupBy("part").agg(F.sum(F.col("size") + gap)).collect())
    bases, base = [], 0
    for part, total in totals:
        bases.append((part, base))
        base += total
    w = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slim.withColumn("within", F.sum(F.col("size") + gap).over(w) - F.col("size") - gap)
    known = df.sparkSession.createDataFrame(bases, "part int, base long")
    return placed.join(F.broadcast(known), "part").select(key, "size", (F.col("base") + F.col("within")).alias("start"))  # one row for each partition


def subset_by_bytes(df: DataFrame, targets: Sequence[tuple[str, int]], key: str = "doc_id", text: str = "text", separator: int = 2) -> DataFrame:
    """subset, key: the longest run of documents from the front that fits each byte target.

    Documents are taken whole while their UTF-8 size, separators included, stays within the target;
    the first that goes beyond is taken too if that comes strictly closer to the target.
    """
    sized = offsets(df.where(F.col(text).isNotNull()), key, T.utf8_size(F.col(text)), separator)
    end = F.col("start") + F.col("size")
    before = F.greatest(F.col("start") - separator, F.lit(0))
    wanted = F.array(*[F.struct(F.lit(n).alias("subset"), F.lit(b).cast("long").alias("target")) for n, b in targets])
    t = F.col("w.target")
    keep = (end <= t) | ((before <= t) & (F.abs(t - end) < F.abs(t - before)))
    return sized.withColumn("w", F.explode(wanted)).where(keep).select("w.subset", key)


def corpus_blocks(df: DataFrame, length: int, key: str = "doc_id", text: str = "text", separator: str = "\n\n") -> DataFrame:
    """block, text: the corpus (documents in key order, joined by the separator) cut into pieces of the given length; the last is shorter."""
    has = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t"))
    last = has.agg(F.max(key)).first()[0]
    placed = offsets(has, key, F.length("t"), len(separator)).join(has, key)
    body = placed.select("start", F.concat("t", F.when(F.col(key) == F.lit(last), "").otherwise(separator)).alias("t"))
    n = F.length("t")
    body = body.where(n > 0)
    parts = body.select("start", "t", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + n - 1) / length))).alias("block"))
    begin = F.greatest(F.col("block") * length - F.col("start"), F.lit(0)).cast("int")
    end = F.least((F.col("block") + 1) * length - F.col("start"), n).cast("int")
    parts = parts.select("block", (F.col("start") + begin).alias("at"), F.substring("t", begin + 1, end - begin).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    return parts.groupBy("block").agg(joined.alias("text"))  # at most `length` characters a group


def windows(df: DataFrame, starts: DataFrame, length: int, key: str = "doc_id", text: str = "text", separator: str = "\n\n", stretch: int = 1 << 16) -> DataFrame:
    """starts with x = corpus[start : start + length] and y shifted by one; starts whose window isn't whole are dropped.

    The corpus is the documents in key order joined by the separator; starts has a distinct column
    start. Places and windows meet on the number of the stretch of the corpus they lie in, with sizes
    only; then only documents that hold a piece of some window give their texts, and only the pieces
    are shuffled.
    """
    has = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    last = has.agg(F.max("_key")).first()[0]
    size = F.length("_text") + F.when(F.col("_key") == F.lit(last), 0).otherwise(len(separator))
    placed = offsets(has, "_key", size).where("size > 0").select("_key", F.col("start").alias("_from"), "size")
    spread = lambda a, n: F.explode(F.sequence(F.floor(a / stretch), F.floor((a + n - 1) / stretch)))
    places = placed.withColumn("_stretch", spread(F.col("_from"), F.col("size")))
    wanted = starts.where("start >= 0").withColumn("_stretch", spread(F.col("start"), F.lit(length + 1)))
    met = wanted.join(places, "_stretch").where((F.col("start") < F.col("_from") + F.col("size")) & (F.col("start") + length + 1 > F.col("_from"))).drop("_stretch").distinct()
    begin = F.greatest(F.col("start") - F.col("_from"), F.lit(0))
    end = F.least(F.col("start") + length + 1 - F.col("_from"), F.col("size"))
    whole = F.concat("_text", F.when(F.col("_key") == F.lit(last), "").otherwise(separator))
    pieces = met.join(has, "_key").select(*starts.columns, (F.col("_from") + begin).alias("_at"), F.substring(whole, (begin + 1).cast("int"), (end - begin).cast("int")).alias("_piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_piece"))), lambda p: p["_piece"]), "")
    both = pieces.groupBy(*starts.columns).agg(joined.alias("_t"))  # length + 1 characters a group
    out = both.withColumns({"x": F.substring("_t", 1, length), "y": F.substring("_t", 2, length)})
    return out.where(F.length("_t") == length + 1).drop("_t")


def split_sizes(placed: DataFrame, total: int, val_share: float = 0.1) -> DataFrame:
    """placed (see offsets) with the characters of each document before and behind the place that parts training from validation, total * (1 - share) truncated."""
    at = F.lit(int(total * (1 - val_share)))
    train = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), at - F.col("start")))
    return placed.withColumn("train_chars", train).withColumn("val_chars", F.col("size") - F.col("train_chars"))
