import json

import pytest
from pyspark.errors import PySparkException

from clicklake.functions.records import CLICK_STREAM_V1, DLQ_V1, USER_EVENT_V1, USER_EVENT_V3
from clicklake.operators import codec
from clicklake.operators.codec import decode_avro, encode_avro
from clicklake.sources.events import read_events
from clicklake.operators.late import with_watermark
from clicklake.sources.lake import as_stream, read_table
from clicklake.sources.schemas import SCHEMA_TABLE
from clicklake.streaming import ingest as ingest_module
from clicklake.streaming import job
from clicklake.streaming.job import start
from clicklake.streaming.produce import produce
from clicklake.streaming.sinks import await_end, run_batches, write_kafka

from . import samples

DDL = ", ".join(f"{n} {'long' if n == 'timestamp' else 'string'}" for n in samples.CLICK)
CLICK = tuple(samples.CLICK.values())


def test_job_reads_all_versions_of_its_subject(spark, tmp_path):
    schemas = [
        ("users-value", 1, 101, USER_EVENT_V1),
        ("users-value", 3, 103, USER_EVENT_V3),
        ("other-value", 9, 7, CLICK_STREAM_V1),
    ]
    spark.createDataFrame(schemas, SCHEMA_TABLE).write.parquet(f"{tmp_path}/schemas")
    values = [
        samples.framed(samples.USER_EVENT_BODY, 101),
        samples.framed(samples.USER_EVENT_V3_BODY, 103),
        samples.framed(samples.CLICK_BODY, 7),
    ]
    write_kafka(spark.createDataFrame([(v,) for v in values], "value binary"), "users", folder=f"{tmp_path}/topic")
    env = {
        "SOURCE": f"{tmp_path}/topic",
        "TOPIC_NAME": "users",
        "SCHEMA_TABLE": f"{tmp_path}/schemas",
        "SINK_PATH": f"{tmp_path}/table/",
        "DLQ_PATH": f"{tmp_path}/dead",
        "TRIGGER_SEC": "0",
    }
    await_end(start(spark, env), 120)
    await_end(start(spark, env), 120)
    rows = read_table(spark, f"{tmp_path}/table").orderBy("route").collect()
    assert [(r.user_process, r.route) for r in rows] == [("bypass-process", None), ("null", "null")]
    letters = read_events(spark, f"{tmp_path}/dead", streaming=False).collect()
    assert [json.loads(bytes(r.value))["error"] for r in letters] == ["unknown schema id 7"]
    assert letters[0].topic == "base-topic.dlq"
    with pytest.raises(ValueError, match="no version"):
        start(spark, env | {"TOPIC_NAME": "absent"})


def test_produce_writes_messages_and_plain_letters(spark, tmp_path):
    rows = spark.createDataFrame([CLICK, (*CLICK[:3], None, *CLICK[4:]), CLICK], DDL)
    places = {"folder": f"{tmp_path}/topic", "dlq_folder": f"{tmp_path}/dead"}
    names = {"topic": "clicks", "dlq_topic": "clicks.dlq"}
    counts = produce(rows, CLICK_STREAM_V1, 7, **names, **places)
    assert counts == {"written": 2, "dead_letters": 1}
    sent = read_events(spark, f"{tmp_path}/topic", streaming=False)
    assert [(bytes(r.key), r.topic) for r in sent.collect()] == [(b"s1", "clicks")] * 2
    assert decode_avro(sent, {7: CLICK_STREAM_V1}).first().data.asDict() == samples.CLICK
    letter = read_events(spark, f"{tmp_path}/dead", streaming=False).first()
    assert letter.key is None and letter.topic == "clicks.dlq"
    assert json.loads(bytes(letter.value)) == samples.CLICK | {"url": None}
    empty = spark.createDataFrame([(None,) * 8], DDL)
    with pytest.raises(PySparkException, match="expected a record"):
        produce(empty, CLICK_STREAM_V1, 7, **names, **places)


def test_produce_on_a_stream_can_be_repeated(spark, tmp_path):
    spark.createDataFrame([CLICK] * 3, DDL).write.parquet(f"{tmp_path}/records")

    def send(batch, batch_id):
        for _ in range(2):
            produce(
                batch, CLICK_STREAM_V1, 7, topic="clicks", dlq_topic="dead",
                folder=f"{tmp_path}/topic", dlq_folder=f"{tmp_path}/dead", batch_id=batch_id,
            )

    stream = spark.readStream.schema(DDL).parquet(f"{tmp_path}/records")
    await_end(run_batches(stream, send, f"{tmp_path}/c", {"availableNow": True}), 120)
    assert read_events(spark, f"{tmp_path}/topic", streaming=False).count() == 3


def test_message_kafka_sink_needs_its_connector(spark):
    rows = encode_avro(spark.createDataFrame([CLICK], DDL), CLICK_STREAM_V1, 7)
    with pytest.raises(Exception, match="(?i)kafka"):
        write_kafka(rows.select("value"), "clicks")


def test_job_options_reach_the_sinks(spark, tmp_path, monkeypatch):
    schemas = [
        ("users-value", 1, 101, USER_EVENT_V1),
        ("letters-value", 1, 40, DLQ_V1),
        ("letters-value", 2, 41, DLQ_V1),
    ]
    spark.createDataFrame(schemas, SCHEMA_TABLE).write.parquet(f"{tmp_path}/schemas")
    values = [(samples.framed(samples.USER_EVENT_BODY, 101),), (b"broken",)]
    write_kafka(spark.createDataFrame(values, "value binary"), "users", folder=f"{tmp_path}/topic")
    env = {
        "SOURCE": f"{tmp_path}/topic",
        "TOPIC_NAME": "users",
        "TOPIC_NAME_DLQ": "letters",
        "DLQ_FORM": "avro",
        "SCHEMA_TABLE": f"{tmp_path}/schemas",
        "SINK_PATH": f"{tmp_path}/table",
        "DLQ_PATH": f"{tmp_path}/dead",
        "REBALANCE": "true",
        "BOOTSTRAP_SERVERS": "broker:1",
        "TRIGGER_SEC": "0",
    }
    sent = []
    monkeypatch.setattr(ingest_module, "write_dlq", lambda rows, form, **options: sent.append((form, options)))
    await_end(start(spark, env), 120)
    ((form, options),) = sent
    assert form == "avro" and options["writer_id"] == 41 and options["env"] is env
    assert job.letter_schema_id(spark, env | {"DLQ_SCHEMA_ID": "5"}) == 5
    with pytest.raises(ValueError, match="no id for x"):
        job.letter_schema_id(spark, env | {"DLQ_SUBJECT": "x"})
    appended = env | {"SINK_MODE": "append", "SINK_PATH": f"{tmp_path}/appended", "WATERMARK_DELAY": "7 minutes"}
    delays = []
    monkeypatch.setattr(job, "with_watermark", lambda rows, delay: delays.append(delay) or with_watermark(rows, delay))
    await_end(start(spark, appended), 120)
    assert delays == ["7 minutes"]
    assert read_table(spark, f"{tmp_path}/appended").count() == 1


def test_choice_of_the_codec(spark, monkeypatch):
    assert not codec.has_spark_avro(spark) and codec.chosen_codec(spark, "auto") == "arrow"
    monkeypatch.setattr(codec, "has_spark_avro", lambda session: True)
    assert codec.chosen_codec(spark, "auto") == "spark-avro"
    assert codec.chosen_codec(spark, "arrow") == "arrow"
    with pytest.raises(ValueError, match="unknown codec"):
        codec.chosen_codec(spark, "other")


def test_second_try_of_produce_replaces_old_letters(spark, tmp_path):
    places = {"folder": f"{tmp_path}/topic", "dlq_folder": f"{tmp_path}/dead", "batch_id": 0}
    names = {"topic": "clicks", "dlq_topic": "dead"}
    with as_stream(spark, "own"):
        for url, letters in ((None, 1), ("/a", 0)):
            rows = spark.createDataFrame([(*CLICK[:3], url, *CLICK[4:])], DDL)
            assert produce(rows, CLICK_STREAM_V1, 7, **names, **places)["dead_letters"] == letters
            assert read_events(spark, f"{tmp_path}/dead", streaming=False).count() == letters
