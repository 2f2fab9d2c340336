"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest
from watchlake.plans import all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    text = df[cols].astype(object).where(df[cols].notna(), None).map(lambda x: None if x is None else f"{x:.9g}" if isinstance(x, float) else str(x))
    return cols, sorted(map(tuple, text.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query(spark, duck, name):
    got = all_queries.QUERIES[name](spark, SF).toPandas()
    if name in all_queries.ORACLES:
        assert rows(got) == rows(duck.execute(all_queries.ORACLES[name]).df())
    else:
        assert len(got)


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
