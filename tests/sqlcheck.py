"""Rows of a query and of its SQL, made comparable."""

import math
from pathlib import Path

import duckdb

SF = Path("/root/testdata/sf0.001")


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def database():
    con = duckdb.connect()
    for p in sorted(SF.glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*' if p.is_dir() else ''}'")
    return con


def same_rows(spark, query, sql):
    df = query(spark, str(SF))
    columns = sorted(df.columns)
    result = database().execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want
