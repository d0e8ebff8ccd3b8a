"""Every registered query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from inkwell.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    from conftest import DATA

    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return c


def plain(rows):
    clean = [tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r) for r in rows]
    return sorted(clean, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert plain(got.select(*columns).collect()) == plain([[r[i] for i in order] for r in want.fetchall()])


def test_the_rest_runs(spark, sf):
    for name in catalogue.queries().keys() - SQL.keys():
        assert catalogue.queries()[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= entry.oracle_sql().keys() and entry.entry(spark).count() == 10
