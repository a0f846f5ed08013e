"""Compare a DataFrame with DuckDB SQL over the same parquet tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _clean(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    return x


def _sorted(rows):
    return sorted((tuple(map(_clean, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def oracle(sql, sf_dir, **views):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if t not in views and os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    for t, frame in views.items():
        con.register(t, frame)
    got = con.sql(sql)
    return got.columns, got.fetchall()


def assert_same(df, sql, sf_dir, **views):
    columns, want = oracle(sql, sf_dir, **views)
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    have = _sorted([tuple(r[c] for c in names) for r in df.collect()])
    want = _sorted([tuple(r[columns.index(c)] for c in names) for r in want])
    assert len(have) == len(want)
    assert have == want
