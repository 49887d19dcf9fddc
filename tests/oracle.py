"""Runs a query and its SQL over the same tables and compares the rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.01"


def database(d: str = DATA):
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return str(x) if not isinstance(x, (int, str, bool, type(None))) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_value(r[i]) for i in order) for r in data)


def differences(spark, con, name, f, sql, d: str = DATA):
    df = f(spark, d)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), name
    a, b = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    return [*(a - b).items()][:3], [*(b - a).items()][:3]
