import uuid

import pytest
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import functions as F

from clicklake.streaming.sinks import await_end, stream_to_table, write_catalog_table


@pytest.fixture
def table(spark):
    name = f"t_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def days(spark, first, count=4):
    return spark.range(first, first + count).select("id", F.expr("DATE'2024-01-01' + CAST(id % 2 AS INT)").alias("dt"))


def test_batches_are_appended(spark, table, tmp_path, plan_of):
    for first in (0, 4):
        write_catalog_table(days(spark, first), table, fmt="parquet", path=str(tmp_path / "t"), partition_by=["dt"])
    assert sorted(r.id for r in spark.table(table).collect()) == list(range(8))
    one = spark.table(table).filter("dt = DATE'2024-01-02'")
    assert one.count() == 4 and "PartitionFilters: [isnotnull(dt" in plan_of(one, "simple")


def test_a_stream_is_appended_once(spark, table, tmp_path):
    for first in (0, 4, 4):
        if first or not (tmp_path / "in").exists():
            days(spark, first).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id long, dt date").parquet(str(tmp_path / "in"))
        options = {"fmt": "parquet", "path": str(tmp_path / "t"), "partition_by": ["dt"], "trigger": {"availableNow": True}}
        stream = stream_to_table(source, table, str(tmp_path / "checkpoint"), name=f"s{first}", **options)
        await_end(stream, 120)
    assert spark.table(table).count() == 12
    assert spark.table(table).groupBy("dt").count().count() == 2


def test_days_need_a_catalog_that_has_them(spark, table):
    with pytest.raises(UnsupportedOperationException, match="days"):
        write_catalog_table(days(spark, 0), table, fmt="parquet", days="dt")
    assert not spark.catalog.tableExists(table)
