"""A table that grows batch by batch: a folder for each batch, now and then put together into one.

The folder holds batch=N for what batch N brought and upto=N for all that came before batch N. A
batch that runs again overwrites its own folder and never reads it, so nothing is counted twice.
Once upto=N is complete, the older folders are deleted; until then they are what is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    def __init__(self, spark: SparkSession, path: str, schema: str, combine: Callable[[DataFrame], DataFrame], every: int = 16, bucket: str | None = None, buckets: int = 64):
        """combine makes one row of all rows of a key; every so many batches are put together; with bucket rows lie in folders by that column's hash."""
        self.spark, self.path, self.schema, self.combine, self.every, self.bucket, self.buckets = spark, path, schema, combine, every, bucket, buckets

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind."""
        path, fs = self._fs()
        found = fs.globStatus(path(f"{self.path}/{kind}=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """What the batches before the given one have brought, uncombined; with keys (a small table of the bucket column) only theirs."""
        base = [n for n in self._numbers("upto") if before is None or n <= before][-1:]
        batches = [n for n in self._numbers("batch") if n >= (base[0] if base else 0) and (before is None or n < before)]
        folders = [f"{self.path}/upto={n}" for n in base] + [f"{self.path}/batch={n}" for n in batches]
        out = None
        for f in folders:
            part = self.spark.read.schema(self.schema + (", _bucket int" if self.bucket else "")).parquet(f)
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], self.schema)
        if self.bucket and keys is not None:
            out = out.join(self._placed(keys.select(self.bucket).distinct()), ["_bucket", self.bucket], "left_semi")
        return out.drop("_bucket") if self.bucket else out

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(self.bucket), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, folder: str) -> None:
        if self.bucket:
            self._placed(df).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        else:
            df.write.mode("overwrite").parquet(folder)

    def compact(self, number: int) -> None:
        """At the beginning of every `every`-th batch, before anything is read: put together what came before it."""
        if not number or number % self.every or number in self._numbers("upto"):
            return
        self._write(self.combine(self.read(number)), f"{self.path}/upto={number}")
        path, fs = self._fs()
        for kind in ("batch", "upto"):
            for n in self._numbers(kind):
                if n < number:
                    fs.delete(path(f"{self.path}/{kind}={n}"), True)

    def write(self, number: int, df: DataFrame) -> None:
        """What a batch brings."""
        self._write(df, f"{self.path}/batch={number}")
