"""Sinks: corpus text, JSON records, vocabulary, metric CSV; outputs that exist may be skipped."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import METRICS


def write_corpus(df: DataFrame, path: str, order: list[str], text: str = "text", mode: str = "error") -> None:
    """Texts in order with a blank line behind each, in files that hold consecutive ranges; no task holds the whole corpus."""
    df.where(F.col(text).isNotNull()).orderBy(*order).select(text).write.mode(mode).option("lineSep", "\n\n").text(path)


def write_records(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a line; null fields are left out."""
    df.write.mode(mode).json(path)


def json_array_lines(df: DataFrame, order: list[str], of: list[str] | None = None) -> DataFrame:
    """of, order, line: lines that, one below the other in order, are a JSON array of the records of each group (of all without `of`).

    Each line is made by itself; of a group only the first and the last place are known to all.
    """
    of, place = of or [], F.struct(*order)
    group = of or ["_g"]
    rows = df if of else df.withColumn("_g", F.lit(0))
    ends = rows.groupBy(*group).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    marked = rows.join(ends if of else F.broadcast(ends), group)  # one row without groups
    record = F.to_json(F.struct(*[c for c in df.columns if c not in of and c not in order]))
    line = F.concat(F.when(place == F.col("_first"), "[").otherwise(","), record, F.when(place == F.col("_last"), "]").otherwise(""))
    return marked.select(*of, *order, line.alias("line"))


def write_json_array(df: DataFrame, path: str, order: list[str], mode: str = "error") -> None:
    """The records as one JSON array in files of consecutive ranges: one behind the other they are the array. Nothing is written for an empty table but the folder."""
    json_array_lines(df, order).orderBy(*order).select("line").write.mode(mode).text(path)


def write_array_files(df: DataFrame, folder: str, source: str = "source_file", order: str = "rec_pos") -> None:
    """A JSON array file for each source, of that name; the records of a source are written in order, one after the other."""
    spark = df.sparkSession
    w = Window.partitionBy(source).orderBy(order)
    record = F.to_json(F.struct(*[c for c in df.columns if c not in (source, order)]))
    line = F.concat(F.when(F.row_number().over(w) == 1, "[").otherwise(","), record, F.when(F.lead(F.lit(1)).over(w).isNull(), "]").otherwise(""))
    # the window keeps a source in one task; a join or a repartition here may be read in pieces by adaptive execution, and a source then gets several files
    lines = df.select(source, order, line.alias("line")).sortWithinPartitions(source, order)
    lines.select(F.col(source).alias("_name"), "line").write.partitionBy("_name").text(folder)
    name_files(spark, folder, "_name")


def name_files(spark: SparkSession, folder: str, column: str) -> None:
    """Turn the folders column=NAME, each with one file, into files NAME."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.globStatus(path(f"{folder}/{column}=*/part-*")):
        at = part.getPath()
        name = unquote(at.getParent().getName().split("=", 1)[1])
        if not fs.rename(at, path(f"{folder}/{name}")):
            raise OSError(f"{name} can't be written")
        fs.delete(at.getParent(), True)


def write_vocab(artefact: DataFrame, path: str, mode: str = "error") -> None:
    artefact.write.mode(mode).json(path)


def write_metric_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """step and the four metrics in this order, with a header; missing values are empty cells."""
    df.select("step", *METRICS).orderBy("step").write.mode(mode).option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def not_yet_written(inputs: DataFrame, existing: DataFrame, column: str = "source_file") -> DataFrame:
    """Inputs without an output of the same name: a repeated run does only what is missing."""
    return inputs.join(existing.select(column).distinct(), column, "left_anti")
