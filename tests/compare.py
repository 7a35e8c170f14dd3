"""Compare a query with its SQL on the same tables."""

import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(([None if v is None or v is pd.NA or v != v else v for v in r] for r in frame[names].astype(object).values.tolist()), key=repr)


def same(spark_frame, sql, folder):
    assert rows(spark_frame.toPandas()) == rows(connect(folder).execute(sql).fetchdf())
