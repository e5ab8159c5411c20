"""Every query with SQL gives the SQL's rows; every query runs."""

import math
import os

import duckdb
import pytest

from decklake.plans.catalog import ORACLES, QUERIES


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(f"{x:.9g}") if isinstance(x, float) else x


def ordered(names, rows):
    k = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in k], sorted((tuple(plain(r[i]) for i in k) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    got = ordered(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        cur = db.execute(ORACLES[name])
        assert got == ordered([d[0] for d in cur.description], cur.fetchall())
    spark.catalog.clearCache()
