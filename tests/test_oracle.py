"""Every core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from pixelsieve.plans import queries

DATA = os.environ.get("PIXELSIEVE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return connection


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return tuple(map(plain, value))
    return None if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value) else value


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    if sql := queries.oracle_sql().get(name):
        want = duck.execute(sql).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
