from __future__ import annotations

import compare
import pytest

from manyfold import queries

DIR = "/root/testdata/sf0.001"
SLOW = {"knn_ivf"}


@pytest.fixture(scope="module")
def duck():
    return compare.duck(DIR)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    assert compare.differences(queries.queries()[name](spark, DIR), duck, queries.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - SLOW))
def test_query_without_sql_runs(spark, name):
    df = queries.queries()[name](spark, DIR)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_sql_belongs_to_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries())
