"""A rule classifier that gives the first rule a record breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PASSED = "passed"


def classify(df: DataFrame, paragraphs: str = "paragraphs", counts: Sequence[int] = (4, 8), lengths: Sequence[int] | None = (5, 7)) -> DataFrame:
    """df with reason, num_sublines, subline_length, sublines (the last three null unless passed).

    A record passes with a given number of sublines of one given length (without punctuation);
    lengths None allows any positive one. The rules are tried in the order empty_paragraphs,
    not_<counts>_sublines, no_lengths, mixed_subline_lengths, uniform_but_not_<lengths>.
    """
    subs = T.poem_sublines(F.col(paragraphs))
    d = df.withColumn("_s", F.when(T.has_lines(F.col(paragraphs)), subs)).withColumn("_l", F.array_distinct(F.transform("_s", lambda x: F.length(T.without_punctuation(x)))))
    named = lambda v: "_or_".join(map(str, v))
    allowed = F.element_at("_l", 1).isin(*lengths) if lengths is not None else F.element_at("_l", 1) > 0
    reason = (
        F.when(~T.has_lines(F.col(paragraphs)), "empty_paragraphs")
        .when(~F.size("_s").isin(*counts), f"not_{named(counts)}_sublines")
        .when(F.size("_l") == 0, "no_lengths")
        .when(F.size("_l") > 1, "mixed_subline_lengths")
        .when(~allowed, f"uniform_but_not_{named(lengths)}" if lengths is not None else "zero_length")
        .otherwise(PASSED)
    )
    ok = F.col("reason") == PASSED
    d = d.withColumn("reason", reason)
    d = d.withColumns({"num_sublines": F.when(ok, F.size("_s")), "subline_length": F.when(ok, F.element_at("_l", 1)), "sublines": F.when(ok, F.col("_s"))})
    return d.drop("_s", "_l")


def is_candidate(df: DataFrame, **rules) -> DataFrame:
    return classify(df, **rules).withColumn("is_candidate", F.col("reason") == PASSED)


def candidates(df: DataFrame, keep: Sequence[str], **rules) -> DataFrame:
    """Records that pass, with the named columns and what the rules found."""
    return classify(df, **rules).where(F.col("reason") == PASSED).select(*keep, "num_sublines", "subline_length", "sublines")


def rejection_counts(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reason") != PASSED).groupBy("reason").agg(F.count("*").alias("records"))


def source_summary(classified: DataFrame, source: str = "source_file") -> DataFrame:
    """source, total, passed, rejections (map of reason to records)."""
    each = classified.groupBy(source, "reason").agg(F.count("*").alias("n"))
    rejected = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason") != PASSED, F.struct("reason", "n")))))
    passed = F.coalesce(F.sum(F.when(F.col("reason") == PASSED, F.col("n"))), F.lit(0))
    return each.groupBy(source).agg(F.sum("n").alias("total"), passed.alias("passed"), rejected.alias("rejections"))


def passed_by(classified: DataFrame, column: str) -> DataFrame:
    """Passed records by num_sublines or subline_length."""
    return classified.where(F.col("reason") == PASSED).groupBy(column).agg(F.count("*").alias("records"))
