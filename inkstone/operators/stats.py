"""Structural statistics of a corpus: sizes, line counts, line lengths, sublines, export summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut


def corpus_basics(df: DataFrame, text: str = "text", raw: str | None = None) -> DataFrame:
    """One row: bytes, poems, lines (non-blank), chars (of the lines), lines_per_poem, chars_per_line; averages are 0 without poems or lines.

    Each row of df is a piece of the corpus; null texts count as empty. bytes are those of column
    raw, the text as it lies on disk, where line ends may be of another kind. Averages are unrounded.
    """
    ps = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(raw or text), F.lit("")).alias("r")).select("r", T.poems(F.col("t")).alias("p"))
    ls = F.flatten(F.transform("p", T.lines))
    n = ps.select(T.utf8_size(F.col("r")).alias("b"), F.size("p").alias("n"), ls.alias("l"))
    n = n.select("b", "n", F.size("l").alias("m"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("c"))
    out = n.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for c, name in (("b", "bytes"), ("n", "poems"), ("m", "lines"), ("c", "chars"))])
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return out.withColumns({"lines_per_poem": ratio("lines", "poems"), "chars_per_line": ratio("chars", "lines")})


def poem_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, poem_pos, line_pos, line of each non-blank line."""
    p = df.select(key, F.posexplode(T.poems(F.col(text))).alias("poem_pos", "poem"))
    return p.select(key, "poem_pos", F.posexplode(T.lines(F.col("poem"))).alias("line_pos", "line"))


def distribution(df: DataFrame, value: Column, order: Column, name: str = "value") -> DataFrame:
    """value, freq, first (least place at which the value occurs); the place decides ties."""
    return df.select(value.alias(name), order.alias("place")).groupBy(name).agg(F.count("*").alias("freq"), F.min("place").alias("first"))


def top_n(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent values, ties by first occurrence."""
    return counts.orderBy(F.desc("freq"), F.asc("first")).limit(n)


def lines_per_poem(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    p = df.select(key, F.posexplode(T.poems(F.col(text))).alias("poem_pos", "poem"))
    return distribution(p, F.size(T.lines(F.col("poem"))), F.struct(key, "poem_pos"), "n_lines")


def line_lengths(df: DataFrame, key: str = "doc_id", text: str = "text", bare: bool = False) -> DataFrame:
    """Lengths of the non-blank lines; with bare, without punctuation."""
    line = F.col("line")
    return distribution(poem_lines(df, key, text), F.length(T.without_punctuation(line) if bare else line), F.struct(key, "poem_pos", "line_pos"), "length")


def sublines_per_record(df: DataFrame, key: str = "rec_id", paragraphs: str = "paragraphs") -> DataFrame:
    """Records by number of sublines; records without any count under 0."""
    return distribution(df, F.coalesce(F.size(T.poem_sublines(F.col(paragraphs))), F.lit(0)), F.col(key), "n_sublines")


def subline_lengths(df: DataFrame, key: str = "rec_id", paragraphs: str = "paragraphs") -> DataFrame:
    """Sublines by length without punctuation."""
    s = df.select(key, F.posexplode(T.poem_sublines(F.col(paragraphs))).alias("sub_pos", "subline"))
    return distribution(s, F.length(T.without_punctuation(F.col("subline"))), F.struct(key, "sub_pos"), "length")


def export_summary(df: DataFrame, source: str = "source_file", paragraphs: str = "paragraphs") -> DataFrame:
    """source, scanned, exported, skipped of each source and (source null, is_total 1) of all."""
    has = df.select(F.coalesce(F.col(source), F.lit("")).alias("s"), T.has_lines(F.col(paragraphs)).alias("ok"))
    g = has.rollup("s").agg(F.grouping("s").cast("int").alias("is_total"), F.count("*").alias("scanned"), F.count_if("ok").alias("exported"))
    return g.select(F.col("s").alias(source), "is_total", "scanned", "exported", (F.col("scanned") - F.col("exported")).alias("skipped"))


def numbered(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """df with its place (from 0) in the given order, which is to be one of distinct values.

    The rows are sorted by ranges; one number for each range passes through the driver.
    """
    ranged = cut(df.orderBy(*order)).withColumn("_part", F.spark_partition_id())
    totals = sorted(tuple(r) for r in ranged.groupBy("_part").count().collect())
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n
    known = df.sparkSession.createDataFrame(bases, "_part int, _base long")
    w = Window.partitionBy("_part").orderBy(*order)
    return ranged.withColumn("_within", F.row_number().over(w) - 1).join(F.broadcast(known), "_part").select(*df.columns, (F.col("_base") + F.col("_within")).alias(name))  # a row for each range


def first_n(df: DataFrame, position: str, n: int) -> DataFrame:
    """Rows at the first n positions."""
    return df.where(F.col(position) < n)
