"""Compares a query with its SQL in DuckDB: columns, number of rows, values without order."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (bool, int, str)) else str(v)


def rows(pdf):
    columns = sorted(pdf.columns)
    pdf = pdf[columns].astype(object).where(pdf[columns].notna(), None)
    return columns, sorted((tuple(map(value, r)) for r in pdf.itertuples(index=False)), key=repr)


def connect(sf=SF):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def same(spark, query, sql, sf=SF):
    assert rows(query(spark, sf).toPandas()) == rows(connect(sf).sql(sql).df())
