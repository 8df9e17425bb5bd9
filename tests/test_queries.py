from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from clicklake.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
TABLES = sorted(Path(SF_DIR).glob("*.parquet"))

pytestmark = pytest.mark.skipif(not TABLES, reason="the test tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    yield connection
    connection.close()


def in_order(names, rows):
    """Rows as sorted tuples, with the columns in order of their names."""
    places = sorted(range(len(names)), key=lambda place: names[place])
    return sorted(tuple(repr(row[place]) for place in places) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, database, name):
    found = entry_points.queries()[name](spark, SF_DIR)
    cursor = database.execute(entry_points.oracle_sql()[name])
    names = [column[0] for column in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert in_order(found.columns, found.collect()) == in_order(names, cursor.fetchall())


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() > 0
