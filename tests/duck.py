"""Compare a Spark result with a DuckDB statement, order aside."""

import datetime
import decimal
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v) if v != int(v) else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def connection(path=DATA):
    con = duckdb.connect()
    for name in os.listdir(path):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{path}/{name}')")
    return con


def assert_same(df, con, sql):
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(tuple(map(plain, row)) for row in result.fetchall())
    ours = sorted(tuple(plain(row[n]) for n in names) for row in df.collect())
    assert ours == theirs
