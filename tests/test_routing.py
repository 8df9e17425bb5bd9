import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from clicklake.functions.records import CLICK_STREAM_V1, DLQ_V1
from clicklake.operators.codec import decode_avro, flatten
from clicklake.operators.deadletter import dlq_messages, dlq_payload, to_json_value
from clicklake.operators.routing import require_record, split_decoded, split_encodable
from clicklake.operators.late import with_watermark
from clicklake.plans.bronze import bronze
from clicklake.sources.events import KAFKA_SCHEMA, read_events

from . import samples

SENT = "2024-01-01 00:00:07.179"


def kafka_rows(spark, *rows):
    """Messages given as (key, value, timestampType)."""
    data = [(key, value, "t", 3, 40 + i, SENT, kind) for i, (key, value, kind) in enumerate(rows)]
    ddl = "key binary, value binary, topic string, partition int, offset long, timestamp string, timestampType int"
    return spark.createDataFrame(data, ddl).withColumn("timestamp", F.to_timestamp("timestamp")).to(KAFKA_SCHEMA)


def test_every_message_is_in_one_part(spark):
    body = samples.framed(samples.CLICK_BODY)
    rows = kafka_rows(spark, *[(b"k", body[: n % len(body)] if n % 3 else body, 0) for n in range(200)])
    good, bad = split_decoded(decode_avro(rows, {7: CLICK_STREAM_V1}))
    assert good.count() + bad.count() == 200
    assert good.count() == 67
    records, failed = bronze(rows, {7: CLICK_STREAM_V1})
    assert records.columns == [*samples.CLICK, "event_time", "dt"]
    assert records.count() == 67 and failed.count() == 133


def test_json_letter(spark):
    bad = kafka_rows(
        spark, (b"k", b"\x00\xff", 0), (b"", None, 1), (None, b"", -1), (b"\xff", b"x", 0)
    ).withColumn("error", F.lit("why"))
    letters = [r.asDict() for r in dlq_payload(bad).collect()]
    assert letters[0] == {
        "error": "why",
        "source": "consumer",
        "raw_value": "00ff",
        "topic": "t",
        "partition": 3,
        "offset": 40,
        "key": "k",
        "timestamp": [1, 1704067207179],
    }
    assert [x["key"] for x in letters] == ["k", None, None, None]
    assert [x["raw_value"] for x in letters] == ["00ff", None, "", "78"]
    assert [x["timestamp"][0] for x in letters] == [1, 2, 0, 1]
    message = dlq_messages(bad, topic="dead").collect()[1]
    assert message.key is None and message.topic == "dead"
    written = json.loads(bytes(message.value))
    assert list(written) == list(letters[0]) and written["key"] is None


def test_avro_letter(spark):
    bad = kafka_rows(spark, (b"k", b"\x00\xff", 0), (None, None, 0)).withColumn("error", F.lit("why"))
    message = dlq_messages(bad, "avro", writer_id=5)
    letters = flatten(decode_avro(message, {5: DLQ_V1})).drop("timestamp").collect()
    assert [tuple(x) for x in letters] == [("why", "00ff", "t", 3, 40), ("why", "", "t", 3, 41)]
    age = dlq_payload(bad, "avro").select((F.unix_millis(F.current_timestamp()) - F.col("timestamp")))
    assert 0 <= age.first()[0] < 60_000
    as_python = flatten(decode_avro(dlq_messages(bad, "avro", raw_as="python"), {1: DLQ_V1}))
    assert [r.raw_payload for r in as_python.collect()] == [str(b"\x00\xff"), "None"]
    with pytest.raises(ValueError, match="raw_as"):
        dlq_payload(bad, "avro", raw_as="x")
    with pytest.raises(ValueError, match="form"):
        dlq_payload(bad, "xml")


def test_avro_letter_without_coordinates_is_still_written(spark):
    bad = kafka_rows(spark, (b"k", b"x", 0)).withColumns(
        {"error": F.lit("why"), "offset": F.lit(None).cast("long"), "topic": F.lit(None).cast("string")}
    )
    letter = flatten(decode_avro(dlq_messages(bad, "avro"), {1: DLQ_V1})).first()
    assert (letter.topic, letter.offset) == ("", -1)


def test_rows_that_do_not_fit_keep_their_fields(spark):
    ddl = ", ".join(f"{n} {'long' if n == 'timestamp' else 'string'}" for n in samples.CLICK)
    rows = spark.createDataFrame([tuple(samples.CLICK.values()), (None,) * 8], ddl)
    good, bad = split_encodable(rows, CLICK_STREAM_V1, 7)
    assert bytes(good.first().value) == samples.framed(samples.CLICK_BODY)
    assert bad.columns == [*samples.CLICK, "encode_error"]
    assert bad.first().encode_error == "field event_id is null"
    letter = json.loads(bytes(to_json_value(bad.drop("encode_error")).first().value))
    assert letter == dict.fromkeys(samples.CLICK)


def test_an_empty_record_stops_the_job(spark):
    rows = spark.createDataFrame([(1, None), (None, "a")], "a int, b string")
    assert require_record(rows).count() == 2
    empty = rows.union(spark.createDataFrame([(None, None)], "a int, b string"))
    with pytest.raises(PySparkException, match="expected a record"):
        require_record(empty).collect()


def test_ingest_plan_is_a_map_that_reads_the_message_only(spark, tmp_path, plan_of):
    body = samples.framed(samples.CLICK_BODY)
    kafka_rows(spark, (b"k", body, 0)).write.parquet(f"{tmp_path}/topic")
    records, _ = bronze(read_events(spark, f"{tmp_path}/topic", streaming=False), {7: CLICK_STREAM_V1})
    plan = plan_of(records)
    assert "Exchange" not in plan and plan.count("Arguments: [decode(") == 1
    assert "ReadSchema: struct<value:binary>" in plan


def test_watermark_is_declared_on_a_stream(spark, tmp_path):
    stream = read_events(spark, str(tmp_path))
    records, _ = bronze(stream, {7: CLICK_STREAM_V1})
    marked = with_watermark(records, "24 hours")
    assert "EventTimeWatermark" in marked._jdf.queryExecution().analyzed().toString()
