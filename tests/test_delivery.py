import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

from clicklake.sources.events import read_events
from clicklake.sources.lake import as_stream
from clicklake.streaming import delivery as delivery_module
from clicklake.streaming.delivery import Delivery, read_delivery
from clicklake.streaming.sinks import await_end, write_kafka

ONCE = {"availableNow": True}


def messages(spark, count, name="k"):
    rows = [(f"{name}{n}".encode(), f"value {n}".encode()) for n in range(count)]
    return spark.createDataFrame(rows, "key binary, value binary")


def of_partitions(keys, n=12):
    out = {}
    for key in keys:
        part = zlib.crc32(key) % n
        out[part] = out.get(part, 0) + 1
    return out


def test_rows_of_each_partition_are_reported(spark, tmp_path):
    delivery = Delivery("clicks", f"{tmp_path}/report", folder=f"{tmp_path}/topic")
    with as_stream(spark, "own"):
        assert delivery.process(messages(spark, 100), 0) == of_partitions(f"k{n}".encode() for n in range(100))
        delivery.process(messages(spark, 7, "other"), 1)
        delivery.process(messages(spark, 100), 0)  # a retry
        assert delivery.process(messages(spark, 0), 2) == {}
    report = read_delivery(spark, f"{tmp_path}/report")
    sums = {r.batch_id: r.n for r in report.groupBy("batch_id").agg(F.sum("rows").alias("n")).collect()}
    assert sums == {0: 100, 1: 7} and report.filter("error IS NOT NULL").count() == 0
    written = read_events(spark, f"{tmp_path}/topic", streaming=False)
    assert written.count() == 107
    told = {(r.partition, r.n) for r in report.groupBy("partition").agg(F.sum("rows").alias("n")).collect()}
    assert told == {(r.partition, r["count"]) for r in written.groupBy("partition").count().collect()}
    assert {(r.query_id, r.topic) for r in report.collect()} == {("own", "clicks")}


def test_partitions_that_the_topic_does_not_have_are_reported_together(spark, tmp_path):
    delivery = Delivery("clicks", f"{tmp_path}/report", partitions=2, folder=f"{tmp_path}/topic")
    placed = messages(spark, 6).withColumn("partition", F.expr("CAST(substr(CAST(key AS STRING), 2) AS INT) % 4"))
    placed = placed.withColumn("partition", F.expr("nullif(partition, 3)"))
    with as_stream(spark, "own"):
        assert delivery.process(placed, 0) == {0: 2, 1: 2, None: 2}


def test_a_failed_try_leaves_its_error(spark, tmp_path, monkeypatch):
    write_kafka(messages(spark, 20), "clicks", folder=f"{tmp_path}/topic")
    delivery = Delivery("copies", f"{tmp_path}/report", folder=f"{tmp_path}/copies")
    write, calls = delivery_module.write_batch, []

    def fails_once(df, path, *arguments, **options):
        if path.endswith("copies") and not calls:
            calls.append(1)
            raise OSError("no broker answers")
        write(df, path, *arguments, **options)

    monkeypatch.setattr(delivery_module, "write_batch", fails_once)
    source = read_events(spark, f"{tmp_path}/topic").select("key", "value")
    with pytest.raises(StreamingQueryException, match="no broker answers"):
        await_end(delivery.start(source, f"{tmp_path}/checkpoint", ONCE), 120)
    report = read_delivery(spark, f"{tmp_path}/report")
    assert [(r.batch_id, r.rows, r.error) for r in report.collect()] == [(0, None, "OSError: no broker answers")]
    stream = delivery.start(source, f"{tmp_path}/checkpoint", ONCE)
    await_end(stream, 120)
    report = read_delivery(spark, f"{tmp_path}/report")
    assert report.filter("error IS NULL").agg(F.sum("rows")).first()[0] == 20
    assert report.filter("error IS NOT NULL").count() == 1
    assert {r.query_id for r in report.collect()} == {str(stream.id)}


def test_a_report_that_is_not_there_is_empty(spark, tmp_path):
    assert read_delivery(spark, f"{tmp_path}/none").collect() == []
