"""A catalog of datasets: name -> path, body field and files to leave out."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .json_records import json_array


@dataclass(frozen=True)
class Dataset:
    name: str
    id: int
    path: str
    tag: str
    excludes: tuple[str, ...] = field(default=())


class Catalog:
    """Datasets by name and by number. An unknown one is an error; missing excludes count as none."""

    def __init__(self, datasets: Iterable[Dataset], root: str = ""):
        self.by_name = {d.name: d for d in datasets}
        self.by_id = {d.id: d for d in self.by_name.values()}
        self.root = root

    @classmethod
    def load(cls, path: str) -> Catalog:
        """From a JSON file with cp_path (the root folder) and datasets."""
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        items = raw["datasets"].values()
        return cls((Dataset(v["name"], v["id"], v["path"], v["tag"], tuple(v.get("excludes") or ())) for v in items), raw.get("cp_path", ""))

    @classmethod
    def from_table(cls, df: DataFrame, root: str = "", most: int = 10_000) -> Catalog:
        """From a catalog table of at most `most` datasets."""
        rows = df.select("name", "id", "path", "tag", "excludes").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a catalog has {most} datasets at most")
        return cls((Dataset(r.name, r.id, r.path, r.tag, tuple(r.excludes or ())) for r in rows), root)

    def get(self, name: str) -> Dataset:
        if name not in self.by_name:
            raise ValueError(f"unknown dataset {name!r}")
        return self.by_name[name]

    def named(self, ids: Sequence[int]) -> list[str]:
        unknown = [i for i in ids if i not in self.by_id]
        if unknown:
            raise ValueError(f"unknown dataset numbers {unknown}")
        return [self.by_id[i].name for i in ids]


def body_lines(records: DataFrame, tag: str, spread: bool = False) -> DataFrame:
    """source_file, rec_pos, line_pos, line out of the body field: a list's elements, or with spread a string's characters."""
    kind = records.schema[tag].dataType.simpleString()
    if kind == "string" and not spread:
        raise ValueError(f"{tag} holds a string, not a list of lines")
    body = T.characters(F.col(tag)) if kind == "string" else F.col(tag)
    return records.select("source_file", "rec_pos", F.posexplode(body).alias("line_pos", "line"))


def dataset_lines(spark: SparkSession, catalog: Catalog, name: str, spread: bool = False) -> DataFrame:
    """Lines of one dataset: a single file, or all files of a folder but the excluded ones."""
    d = catalog.get(name)
    kind = "string" if spread else "array<string>"
    path = f"{catalog.root}/{d.path}" if catalog.root else d.path
    return body_lines(json_array(spark, path.rstrip("/"), f"`{d.tag}` {kind}", excludes=list(d.excludes)), d.tag, spread)


def several(spark: SparkSession, catalog: Catalog, names: Sequence[str]) -> DataFrame:
    """target_pos, dataset and lines of datasets in the order given; a dataset named twice comes twice."""
    out = None
    for k, n in enumerate(names):
        part = dataset_lines(spark, catalog, n).withColumns({"target_pos": F.lit(k), "dataset": F.lit(n)})
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "source_file string, rec_pos int, line_pos int, line string, target_pos int, dataset string")
    return out


def by_ids(spark: SparkSession, catalog: Catalog, ids: Sequence[int]) -> DataFrame:
    return several(spark, catalog, catalog.named(ids))


def without(df: DataFrame, column: str, excludes: Sequence[str]) -> DataFrame:
    """Rows whose column is none of the excluded values; rows with a null stay."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*excludes)) if excludes else df
