"""Records to a topic: framed Avro where they fit, dead letters where they do not."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators.codec import encode_avro
from ..operators.deadletter import json_bytes
from ..operators.keys import to_kafka_rows
from ..operators.routing import require_record
from .ingest import RowsLost
from .sinks import has_batch, topic_rows, write_batch, write_kafka


def produce(
    records: DataFrame,
    schema_json: str,
    writer_id: int,
    *,
    topic: str,
    dlq_topic: str,
    key: str = "session_id",
    folder: str | None = None,
    dlq_folder: str | None = None,
    batch_id: int | None = None,
    partitions: int | None = None,
    env: Mapping[str, str] | None = None,
) -> dict[str, int]:
    """Write a batch of records to ``topic``, and give back how many were written.

    A record that does not fit the schema goes to ``dlq_topic`` as plain JSON, without a
    key; a row without any value stops the job. Records are read and encoded once and kept
    on the executors; if a lost executor makes Spark read them again and others are found,
    the call fails. With ``partitions``, the number of the topic's partitions, records go
    where a client would send them. ``env`` has the connection. On a stream, call it from
    :func:`run_batches` with the ``batch_id``, which makes folder writes repeatable.
    """
    encoded = encode_avro(require_record(records), schema_json, writer_id)
    fits = F.col("encode_error").isNull()
    encoded.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = _counts(encoded)
        _send(to_kafka_rows(encoded.filter(fits), key, partitions=partitions), topic, folder, batch_id, env)
        again = dlq_folder is not None and batch_id is not None and has_batch(records.sparkSession, dlq_folder, batch_id)
        if counts["misfits"] or again:  # letters of an earlier try are replaced, if only by none
            value = json_bytes(encoded, records.columns).alias("value")
            letters = encoded.filter(~fits).select(F.lit(None).cast("binary").alias("key"), value)
            _send(letters, dlq_topic, dlq_folder, batch_id, env)
        now = _counts(encoded)
    finally:
        encoded.unpersist()
    if now != counts:
        raise RowsLost(f"there were {counts} before they were written and {now} after")
    return {"written": counts["records"] - counts["misfits"], "dead_letters": counts["misfits"]}


def _counts(encoded: DataFrame) -> dict[str, int]:
    return encoded.agg(F.count(F.lit(1)).alias("records"), F.count("encode_error").alias("misfits")).first().asDict()


def _send(
    messages: DataFrame, topic: str, folder: str | None, batch_id: int | None, env: Mapping[str, str] | None
) -> None:
    if folder is not None and batch_id is not None:
        write_batch(topic_rows(messages, topic), folder, batch_id, fmt="parquet")
    else:
        write_kafka(messages, topic, folder=folder, env=env)
