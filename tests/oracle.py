"""Compares a query with its DuckDB SQL on the given tables."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else float(f"{x:.9g}")
        if isinstance(x, (list, tuple)):
            return tuple(map(plain, x))
        if isinstance(x, dict):
            return tuple(sorted((k, plain(v)) for k, v in x.items()))
        return x if x is None or isinstance(x, (str, bool)) else (int(x) if hasattr(x, "__int__") and x == int(x) else float(x))

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(f"{sf_dir}/{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def assert_same(df, sql, con):
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w, (g, w)
