"""Comparison of a Spark query with DuckDB on the same Parquet tables."""

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")
SMALL = str(DATA / "sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def assert_same(df, sf_dir: str, sql: str):
    result = connection(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, result.fetchall())
