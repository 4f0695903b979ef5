"""Runs a registered query and its DuckDB SQL and compares them as bags of rows."""

import os

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def value(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "NULL"
    if isinstance(v, float):  # whole numbers beside missing ones come as floats
        return str(int(v)) if v.is_integer() and abs(v) < 2**53 else f"{v:.6f}"
    return str(v)


def bag(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(value(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def same(spark, sf_dir, query, sql):
    ours, theirs = bag(query(spark, sf_dir).toPandas()), bag(connect(sf_dir).execute(sql).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
