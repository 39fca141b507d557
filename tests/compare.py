"""Spark rows against DuckDB rows, regardless of order."""

import datetime
import glob
import math

import duckdb


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(timespec="microseconds")
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(map(norm, value))
    return value


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def same(df, sql, sf_dir):
    """Asserts that both have the same columns and rows."""
    names, rows = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    left = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    right = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in rows), key=repr)
    assert len(left) == len(right), (len(left), len(right), left[:2], right[:2])
    assert left == right, next((a, b) for a, b in zip(left, right) if a != b)
    return len(left)
