"""Order-free comparison of a Spark result with a DuckDB one."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, con, sql):
    rel = con.sql(sql)
    want, got = rows(rel.columns, rel.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(rel.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""
