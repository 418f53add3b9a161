"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares all values."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    if isinstance(value, bool):
        return int(value)
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(plain(r[k]) for k in order) for r in rows]
    return [columns[k] for k in order], sorted(out, key=repr)


def close(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(close, a, b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)
    return a == b


def differences(spark, name, query, sql, sf_dir, con=None):
    con = con or database(sf_dir)
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"{name}: columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{name}: {len(got[1])} and {len(want[1])} rows"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if not all(map(close, a, b))]
    return f"{name}: {len(bad)} of {len(got[1])} rows differ, as {bad[0]}" if bad else ""
