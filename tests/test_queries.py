"""Every registered query agrees with its SQL on DuckDB."""

import pytest
from compare import compare, duckdb_connection
from conftest import SF_DIR

import __spark_entry__ as entry
from dataquay.plans import QUERIES


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_agrees_with_sql(tables, con, name):
    query = QUERIES[name]
    assert compare(query.run(tables), con, query.sql) is None


def test_quick_profile_is_near_the_exact_one(tables):
    quick = {r["name"]: r for r in QUERIES["profile_columns_quick"].run(tables).collect()}
    for exact in QUERIES["profile_columns"].run(tables).collect():
        near = quick[exact["name"]]
        assert near["distinct_values"] == pytest.approx(exact["distinct_values"], rel=0.1)
        assert float(near["median_value"]) == pytest.approx(exact["median_value"], rel=0.05, abs=1)
        assert near["missing_total"] == exact["missing_total"]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
