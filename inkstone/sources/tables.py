"""Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def paragraph_rows(spark: SparkSession, directory: str, *names: str) -> DataFrame:
    """rec_id and paragraphs of the named record tables, one row per delivered row (re-sent records repeat)."""
    out = None
    for name in names:
        part = table(spark, directory, name).select("rec_id", "paragraphs")
        out = part if out is None else out.unionByName(part)
    return out


def once(df: DataFrame, key: str = "rec_id") -> DataFrame:
    """One row per key: records that were sent again repeat with the same content. Rows without a key are no records."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])
