"""Queries over files against their SQL, with sources that lie in many partitions: one source must become one file."""

import duckdb
import pytest
from oracle import by_spark, by_sql

from inkstone.plans import files

NAMES = ["base_names", "inspect_files", "dataset_lines", "scan_counts", "dataset_by_ids", "json_scan", "spread_body"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    for name, more, file, first in (("tang_poem", "title", "poet.tang", 0), ("ci", "rhythmic", "ci.song", 1_000_000)):
        extra = "'i' || k AS id," if name == "tang_poem" else ""
        duckdb.sql(f"""COPY (SELECT {first} + k AS rec_id, '{file}.' || (k % 3 * 1000) || '.json' AS source_file, (k // 3)::INT AS rec_pos, 'a' || k AS author, 't' || k % 7 AS {more}, {extra}
            [repeat(sha256(k::VARCHAR), 5), repeat(md5(k::VARCHAR), 10)] AS paragraphs FROM range(20000) t(k)) TO '{d}/{name}.parquet' (ROW_GROUP_SIZE 2048)""")
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, tables, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("1m", "256k", "12")):
            spark.conf.set(k, v)
        got = by_spark(files.queries()[name](spark, tables))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == by_sql(files.oracle_sql()[name], tables)
