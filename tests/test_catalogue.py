"""Every query against its SQL twin."""

import os

import duckdb
import pytest

from quern.plans import catalogue, more  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_equals_its_twin(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(catalogue.ORACLE_SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    assert got == sorted(repr([plain(r[order.index(c)]) for c in columns]) for r in result.fetchall())


def test_the_flagship_is_registered():
    assert catalogue.FLAGSHIP in catalogue.QUERIES
