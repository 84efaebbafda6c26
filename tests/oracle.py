"""Runs a query and its SQL side by side."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def rows(names, values):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(v[i]) for i in at) for v in values)


def check(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    said = con.execute(sql)
    names, kinds = [d[0] for d in said.description], {d[0]: str(d[1]) for d in said.description}
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, said.fetchall())
    assert {n: KINDS.get(k, k) for n, k in df.dtypes} == kinds
    return got
