"""Comparison of a query with its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def normal(rows, columns):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        return repr(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def duck(sf_dir, **views):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def same(df, con, sql):
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), columns)
