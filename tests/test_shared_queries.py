"""Queries that write, in a checkpoint folder that has another user's ``clicklake``."""

from unittest import mock

import pytest

import __spark_entry__ as entry_points

from .test_queries import SF_DIR, TABLES, database, in_order  # noqa: F401  (a fixture)

pytestmark = pytest.mark.skipif(not TABLES, reason="the test tables are not here")

WRITING = [
    "client_partitions",
    "dead_letters_json",
    "delivered_rows",
    "flagship",
    "keyed_messages",
    "keyed_order",
    "letter_times",
    "letters_read_once",
    "messages_from_latest",
    "one_day",
    "produced_letters",
    "run_events",
    "produced_messages",
    "run_log",
    "run_times",
    "stream_accounts",
    "running_total_of_each_event",
    "stream_append",
    "stream_bounded_by_bytes",
    "stream_dead_letters",
    "stream_dropped_rows",
    "stream_evolution",
]


def checkpoint_folder(spark, folder):
    """While it is entered, this is the session's setting."""
    kind, told = type(spark.conf), type(spark.conf).get
    setting = lambda self, name, *more: str(folder) if name == "spark.checkpoint.dir" else told(self, name, *more)
    return mock.patch.object(kind, "get", setting)


@pytest.mark.parametrize("name", WRITING)
def test_query_beside_the_folder_of_another_user(spark, database, tmp_path, name):  # noqa: F811
    (tmp_path / "clicklake").write_text("not mine")
    with checkpoint_folder(spark, tmp_path):
        found = entry_points.queries()[name](spark, SF_DIR)
        rows = found.collect()
    cursor = database.execute(entry_points.oracle_sql()[name])
    names = [column[0] for column in cursor.description]
    assert in_order(found.columns, rows) == in_order(names, cursor.fetchall())
    assert any(tmp_path.glob("*/clicklake/*"))
