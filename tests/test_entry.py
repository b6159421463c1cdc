"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from workloads.check import TABLES, sorted_rows
from workloads.oracles import ORACLES
from workloads.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry_module.queries().items()
    assert ORACLES.items() <= entry_module.oracle_sql().items()


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["key_name", "key", "value_a", "value_b", "status", "group", "difference"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted_rows(got.columns, got.collect()) == sorted_rows(want.columns, want.fetchall())
