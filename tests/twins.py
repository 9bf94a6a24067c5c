"""Runs a query and its SQL twin and compares the rows."""

import glob
import math
import os
from decimal import Decimal

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(folder=DATA):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if isinstance(v, Decimal) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def assert_twin(spark, query, sql, folder=DATA):
    df = query(spark, folder)
    got = ordered([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()])
    cur = connection(folder).execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = ordered([tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()])
    assert got == want
