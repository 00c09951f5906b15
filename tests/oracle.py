"""Runs a query's SQL in DuckDB over a folder of parquet tables."""

import glob
import math
import os

import duckdb


def connect(folder: str):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark_df, sql: str, con) -> tuple[list, list]:
    got = canon(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    return got, canon([d[0] for d in rel.description], rel.fetchall())
