"""Compare queries with their SQL on the test tables."""

import math
from pathlib import Path

import duckdb


def _text(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(_text, x)) + "]"
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_text(r[i]) for i in order) for r in rows)


def by_sql(sql, folder):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    c = con.execute(sql)
    return rows_of([d[0] for d in c.description], c.fetchall())


def by_spark(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
