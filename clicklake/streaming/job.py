"""The ingest job, set up from the environment: ``python -m clicklake.streaming.job``.

Kafka and security variables are those of ``kafka_options``. Besides them:

========================  ==============================================================
``SOURCE``                ``kafka`` (default) or the path of a topic folder
``SCHEMA_TABLE``          path of the schema table: subject, version, schema_id, schema_json
``SR_SUBJECT_STRATEGY``   how the subject is named (default ``TopicNameStrategy``)
``RECORD_FULLNAME``       record name, for the other strategies
``SINK_PATH``             lake table
``CHK_PATH``              checkpoint (default: inside the table folder)
``PROGRESS_PATH``         progress table (default: next to the lake table)
``TOPIC_NAME_DLQ``        dead-letter topic
``DLQ_PATH``              dead-letter topic folder (default: the Kafka topic)
``LATE_PATH``             table for late rows (default: they stay in the lake table)
``WATERMARK_DELAY``       when a row counts as late (default ``24 hours``)
``DLQ_FORM``              ``json`` (default) or ``avro``
``DLQ_SUBJECT``           subject of the Avro letters' schema in the schema table (default:
                          ``<dead-letter topic>-value``); ``DLQ_SCHEMA_ID`` overrides its id
``CODEC``                 ``auto`` (default), ``arrow`` or ``spark-avro``
``REBALANCE``             ``true`` to bring the rows of a date together before a write
``SINK_MODE``             ``batches`` (default), or ``append``: a plain append stream with a
                          watermark of ``WATERMARK_DELAY``, without letters and progress
``TRIGGER_SEC``           seconds between batches (default 5); 0 reads what is there and ends
========================  ==============================================================
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.records import DLQ_TOPIC
from ..operators.late import DEFAULT_DELAY, with_watermark
from ..plans.bronze import bronze
from ..sources.events import read_events
from ..sources.schemas import latest_schema, latest_schemas, subject_name
from ..sources.settings import DEFAULT_TOPIC, kafka_options, session_conf
from .ingest import Ingest
from .sinks import CHECKPOINT_IN_TABLE, write_stream


def subject_schemas(spark: SparkSession, env: Mapping[str, str]) -> DataFrame:
    """All versions of the topic's subject."""
    record = env.get("RECORD_FULLNAME")
    subject = subject_name(
        F.lit(env.get("TOPIC_NAME", DEFAULT_TOPIC)),
        F.lit(record) if record else None,
        env.get("SR_SUBJECT_STRATEGY", "TopicNameStrategy"),
    )
    return spark.read.parquet(env["SCHEMA_TABLE"]).filter(F.col("subject") == subject)


def letter_schema_id(spark: SparkSession, env: Mapping[str, str]) -> int:
    """The id under which Avro letters are written: the newest of their subject."""
    if env.get("DLQ_SCHEMA_ID"):
        return int(env["DLQ_SCHEMA_ID"])
    subject = env.get("DLQ_SUBJECT", f"{env.get('TOPIC_NAME_DLQ', DLQ_TOPIC)}-value")
    newest = latest_schema(spark.read.parquet(env["SCHEMA_TABLE"]), subject).first()
    if newest is None or newest["schema_id"] is None:
        raise ValueError(f"the schema table has no id for {subject}; set DLQ_SUBJECT or DLQ_SCHEMA_ID")
    return newest["schema_id"]


def start(spark: SparkSession, env: Mapping[str, str] | None = None) -> StreamingQuery:
    """Start the stream: every version is read, the newest one is what is written."""
    env = os.environ if env is None else env
    newest = latest_schemas(subject_schemas(spark, env)).first()
    if newest is None:
        raise ValueError(f"the schema table has no version for topic {env.get('TOPIC_NAME', DEFAULT_TOPIC)}")
    table = env["SINK_PATH"].rstrip("/")
    form, codec = env.get("DLQ_FORM", "json"), env.get("CODEC", "auto")
    delay = env.get("WATERMARK_DELAY", DEFAULT_DELAY)
    ingest = Ingest(
        lambda: subject_schemas(spark, env),
        table,
        env.get("DLQ_PATH"),
        env.get("PROGRESS_PATH", f"{table}-progress"),
        reader=newest["schema_json"],
        late=env.get("LATE_PATH"),
        delay=delay,
        dlq_topic=env.get("TOPIC_NAME_DLQ", DLQ_TOPIC),
        dlq_form=form,
        dlq_schema_id=letter_schema_id(spark, env) if form == "avro" else 1,
        codec=codec,
        rebalance=env.get("REBALANCE", "false") == "true",
        env=env,
    )
    source = env.get("SOURCE", "kafka")
    options = kafka_options(env) if source == "kafka" else None
    seconds = int(env.get("TRIGGER_SEC", "5"))
    trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
    checkpoint = env.get("CHK_PATH", f"{table}/{CHECKPOINT_IN_TABLE}")
    messages = read_events(spark, source, options)
    if env.get("SINK_MODE", "batches") == "append":
        rows, _ = bronze(messages, subject_schemas(spark, env), newest["schema_json"], codec=codec)
        timed = "event_time" in rows.columns
        return write_stream(
            with_watermark(rows, delay) if timed else rows,
            table,
            checkpoint,
            partition_by=["dt"] if timed else [],
            trigger=trigger,
        )
    return ingest.start(messages, checkpoint, trigger)


def main() -> None:
    builder = SparkSession.builder.appName("clicklake-ingest")
    for name, value in session_conf().items():
        builder = builder.config(name, value)
    start(builder.getOrCreate()).awaitTermination()


if __name__ == "__main__":
    main()
