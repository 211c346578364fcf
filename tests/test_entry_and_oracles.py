"""Driver contract and every registered query against its DuckDB oracle at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import compare
from wrenchflow.plans.catalog import spark_queries
from wrenchflow.sources.binding import DRIVER_TABLES


def test_entry_runs(spark):
    df = E.entry(spark)
    assert "id" in df.columns and "service_name" in df.columns
    assert df.count() > 0


def test_every_query_has_docstring_and_most_have_oracles():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert all(q.__doc__ for q in qs.values())
    own = spark_queries()
    assert len(own) >= 100 and set(own) <= set(sql)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    line = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert ": OK" in line, line
