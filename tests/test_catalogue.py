"""Every query against its DuckDB twin on the small driver tables."""

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from catalogue.oracles import ORACLES
from catalogue.queries import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# Sketches are approximate.
ROWS_ONLY = {"column_profile_sketched"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def cell(value):
    if value is None or value != value:
        return ""
    return repr(float(value)) if isinstance(value, int | float) else str(value)


def table(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in records)


def test_every_query_has_a_twin_or_a_reason():
    assert set(REGISTRY) == set(ORACLES) | ROWS_ONLY
    assert not set(ORACLES) & ROWS_ONLY
    assert set(REGISTRY) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    found = entry.queries()[name](spark, SMALL)
    wanted = duck.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    expected = table(wanted.columns, wanted.fetchall())
    assert table(found.columns, [tuple(r) for r in found.collect()]) == expected


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 150
