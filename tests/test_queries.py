"""Every registered query against its SQL, row by row, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as registry

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not present")


@pytest.fixture(scope="module")
def duck():
    connection = pytest.importorskip("duckdb").connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def in_order(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query_equals_sql(spark, duck, name):
    result = registry.queries()[name](spark, str(DATA))
    columns = sorted(result.columns)
    got = [tuple(row[column] for column in columns) for row in result.collect()]
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [column[0] for column in cursor.description]
    expected = [tuple(row[names.index(column)] for column in columns) for row in cursor.fetchall()]
    assert columns == sorted(names)
    assert in_order(got) == in_order(expected)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert registry.entry(spark).count() == 10
