"""Compares a query with its SQL: columns by name, rows in any order."""

import glob
import os

import duckdb


def duck(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{source}'")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 12) if isinstance(v, float) else v
    return sorted(columns), sorted(repr([fix(r[i]) for i in order]) for r in rows)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = duck(sf_dir).execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
