"""Comparison of a query's rows with those of its SQL in DuckDB."""

import math
from pathlib import Path

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, list):
        return tuple(map(plain, v))
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if hasattr(v, "__float__"):
        return float(f"{float(v):.9g}") if math.isfinite(float(v)) else str(v)
    return v


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def assert_same(spark, query, sql, sf_dir=SMALL):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, sf_dir)
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(names, cursor.fetchall())
