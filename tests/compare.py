"""Rows of a Spark result and of DuckDB SQL over the same Parquet tables, in a form that can be compared."""

import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float) and x == int(x) if isinstance(x, float) and x == x and abs(x) < 1e15 else False:
        return int(x)
    if isinstance(x, decimal.Decimal):
        return int(x) if x == int(x) else float(x)
    return x


def rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(t[i]) for i in order) for t in tuples), key=repr)


def oracle(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    return rows([d[0] for d in cur.description], cur.fetchall())


def result(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
