"""Dead letters: what is kept of a message that could not be decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derive import now_millis
from ..functions.records import DLQ_SOURCE, DLQ_TOPIC, DLQ_V1
from ..functions.wire import bytes_text
from .codec import encode_avro
from .letters import letter_headers


def json_bytes(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The row as UTF-8 JSON bytes; NULL fields are written out as null."""
    names = [f"`{name}`" for name in (columns or df.columns)]
    return F.encode(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), "UTF-8")


def to_json_value(df: DataFrame) -> DataFrame:
    """One ``value`` column with the whole row as JSON bytes."""
    return df.select(json_bytes(df).alias("value"))


def dlq_payload(df: DataFrame, form: str = "json", *, raw_as: str = "hex") -> DataFrame:
    """The dead-letter record of each message in ``df`` (Kafka columns and ``error``).

    ``form="json"`` keeps the message in lowercase hex, its key as text (NULL when empty
    or not UTF-8) and its timestamp as ``[type, epoch ms]``, with types counted from 0 for
    "not available". ``form="avro"`` has the fields of the Avro dead letter: the message
    in hex and the time of failure; ``raw_as="python"`` writes the message as Python does.
    """
    raw = F.lower(F.hex("value"))
    if form == "json":
        key = F.nullif(F.try_validate_utf8(F.col("key").cast("string")), F.lit(""))
        kind = (F.col("timestampType") + 1).cast("long")
        return df.select(
            "error",
            F.lit(DLQ_SOURCE).alias("source"),
            raw.alias("raw_value"),
            "topic",
            "partition",
            "offset",
            key.alias("key"),
            F.array(kind, F.unix_millis("timestamp")).alias("timestamp"),
        )
    if form == "avro":
        if raw_as not in ("hex", "python"):
            raise ValueError(f"raw_as is 'hex' or 'python', not {raw_as!r}")
        text = bytes_text(F.col("value")) if raw_as == "python" else F.coalesce(raw, F.lit(""))
        return df.select(
            "error",
            text.alias("raw_payload"),
            "topic",
            "partition",
            "offset",
            now_millis().alias("timestamp"),
        )
    raise ValueError(f"form is 'json' or 'avro', not {form!r}")


def dlq_messages(
    df: DataFrame,
    form: str = "json",
    *,
    topic: str = DLQ_TOPIC,
    writer_id: int = 1,
    raw_as: str = "hex",
) -> DataFrame:
    """Keyless messages for the dead-letter topic: JSON text, or framed Avro.

    The ``headers`` name the message that a letter is about, so that a letter sent again can
    be told from another one (see ``letters_once``). An Avro letter needs all of its fields, so a message without an offset (one read from
    a topic folder that never had one) is given -1 for it.
    """
    payload = dlq_payload(df, form, raw_as=raw_as)
    if form == "json":
        message = payload.select(json_bytes(payload).alias("value"), letter_headers(payload).alias("headers"))
    else:
        payload = payload.withColumn("headers", letter_headers(payload))
        payload = payload.withColumns(
            {
                "topic": F.coalesce("topic", F.lit("")),
                "partition": F.coalesce("partition", F.lit(-1)),
                "offset": F.coalesce("offset", F.lit(-1)),
            }
        )
        message = encode_avro(payload, DLQ_V1, writer_id)
    key = F.lit(None).cast("binary").alias("key")
    return message.select(key, "value", F.lit(topic).alias("topic"), "headers")
