"""Results of a query against its SQL in DuckDB, without order."""

import os

import duckdb


def normal(v):
    return round(v, 6) if isinstance(v, float) else v


def against_sql(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    rows = sorted((tuple(normal(r[n]) for n in names) for r in got.collect()), key=str)
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    out = con.sql(sql)
    assert sorted(out.columns) == names, (sorted(out.columns), names)
    at = [out.columns.index(n) for n in names]
    want = sorted((tuple(normal(r[i]) for i in at) for r in out.fetchall()), key=str)
    return rows, want
