"""Every registered query over code graphs against its SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tracelode.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else str(v)
    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = plain(df.columns, [tuple(r) for r in df.collect()])
    r = con.sql(entry.oracle_sql()[name])
    assert got == plain(r.columns, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_others_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
