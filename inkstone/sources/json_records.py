"""Scans of JSON array files with the position of each record, and of plain corpus text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T

# Names of the poem files, as globs and as patterns on the path.
CI_FILES, POET_FILES = "ci.song.*.json", "poet.song.*.json"
CI_PATTERN, POET_PATTERN = r"ci\.song\.\d+y?\.json$", r"poet\.(song|tang)\.(\d+)\.json$"


def _paths(spark: SparkSession, folder: str, glob: str | None) -> bool:
    """Whether the folder (or file) holds anything to read."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{glob}" if glob else folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return bool(found)


def json_array(spark: SparkSession, folder: str, element: str = schemas.POEM, glob: str | None = None, path_pattern: str | None = None, excludes: list[str] | None = None) -> DataFrame:
    """source_file, rec_pos and the fields of `element` of every record of the JSON array files of a folder (or one file).

    Files may be chosen by a glob on the name, a pattern on the whole path, and names to leave out;
    subfolders aren't entered. No match gives an empty table, not an error. A file whose text is no
    array of objects has no records. Keys that a record lacks are null. A file is read as one
    string, so none may have more than 2 GB.
    """
    kind = f"array<struct<{', '.join(_fields(element))}>>"
    empty = spark.createDataFrame([], f"source_file string, rec_pos int, {element}")
    if not _paths(spark, folder, glob):
        return empty
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("path"))
    if path_pattern:
        files = files.where(F.col("path").rlike(path_pattern))
    if excludes:
        files = files.where(~F.col("source_file").isin(*excludes))
    records = files.select("source_file", F.posexplode(F.from_json("value", kind)).alias("rec_pos", "r"))
    return records.select("source_file", "rec_pos", "r.*")


def _fields(element: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(element)]


def json_lists(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """source_file, rec_pos, strains of files that hold an array of string lists."""
    if not _paths(spark, folder, glob):
        return spark.createDataFrame([], "source_file string, rec_pos int, strains array<string>")
    reader = spark.read
    files = (reader.option("pathGlobFilter", glob) if glob else reader).text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("source_file"))
    return files.select("source_file", F.posexplode(F.from_json("value", "array<array<string>>")).alias("rec_pos", "strains"))


def corpus_text(spark: SparkSession, path: str) -> DataFrame:
    """source_file, poem_pos, text of each piece between blank lines; line ends of any kind."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("source_file"))
    return files.select("source_file", F.posexplode(T.poems(F.col("value"))).alias("poem_pos", "text"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """source_file, bytes of each file as it lies on disk."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"[^/]+$", 0).alias("source_file"), F.col("length").alias("bytes"))


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """source_file, top (array or object), records, keys and first (a map of them to their values as text) of the first record of each JSON file."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("source_file"))
    top = F.when(F.btrim("value", F.lit(" \t\r\n")).startswith("["), "array").otherwise("object")
    first = F.when(top == "array", F.get_json_object("value", "$[0]")).otherwise(F.col("value"))
    n = F.when(top == "array", F.json_array_length("value")).otherwise(F.lit(1))
    values = F.from_json(first, "map<string,string>")
    kinds = F.try_parse_json(first).try_cast("map<string,variant>")
    told = files.select("source_file", top.alias("top"), n.alias("records"), F.json_object_keys(first).alias("keys"), values.alias("first"), kinds.alias("kinds"))
    shown = F.transform_values("first", lambda k, v: F.when(F.schema_of_variant(F.col("kinds")[k]) == "STRING", v).otherwise(_whole_characters(v)))
    return told.select("source_file", "top", "records", "keys", shown.alias("first"))


def _whole_characters(json: Column) -> Column:
    """JSON text with the character itself for each escaped pair of surrogates, as which Spark writes characters beyond the basic plane."""
    pair = r"\\uD[89AB][0-9A-F]{2}\\uD[C-F][0-9A-F]{2}"
    tokens = F.regexp_extract_all(json, F.lit(rf"(?s){pair}|[^\\]+|\\."), F.lit(0))
    char = lambda t: F.decode(F.unhex(F.concat(F.substring(t, 3, 4), F.substring(t, 9, 4))), "UTF-16BE")
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(f"^{pair}$"), char(t)).otherwise(t)), "")


def metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """A metric log with a header; empty cells and those that are no numbers are null."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("step").try_cast("int").alias("step"), *[F.col(m).try_cast("double").alias(m) for m in schemas.METRICS])
