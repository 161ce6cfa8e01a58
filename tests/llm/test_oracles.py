"""Corpus queries against their SQL on the smallest tables."""

import os

import pytest
from test_oracle import DATA, duck, rows  # noqa: F401  the fixture and helpers of the core queries

from pixelsieve.llm import queries


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):  # noqa: F811
    got, want = queries.queries()[name](spark, DATA).toPandas(), duck.execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
