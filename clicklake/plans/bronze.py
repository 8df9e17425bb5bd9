"""The bronze plan: messages to flat records with event time and date."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.derive import with_dt, with_event_time
from ..operators.codec import decode_avro, flatten
from ..operators.routing import split_decoded


def bronze(
    messages: DataFrame,
    schemas: DataFrame | dict[int, str],
    reader: str | None = None,
    *,
    precision: str = "s",
    keep_kafka: bool = False,
    null_string_default: bool = False,
    codec: str = "auto",
) -> tuple[DataFrame, DataFrame]:
    """Flat good rows and failed messages of a topic; a map without any shuffle.

    Good rows get ``event_time`` and ``dt`` when the record has a timestamp field.
    """
    decoded = decode_avro(messages, schemas, reader, null_string_default=null_string_default, codec=codec)
    good, bad = split_decoded(decoded)
    records = with_event_time(flatten(good, keep_kafka=keep_kafka), precision=precision)
    if "event_time" in records.columns:
        records = with_dt(records)
    return records, bad.drop("data")
