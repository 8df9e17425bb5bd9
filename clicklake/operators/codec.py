"""Decode framed Avro messages into columns, and encode rows into framed messages."""

from __future__ import annotations

import json

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wire
from ..functions.avro_types import AvroType, as_record, avro_type, spark_type
from ..functions.decode import decoder
from ..functions.encode import avro_body, encode_error
from ..functions.nested import encoder
from ..functions.records import Field, drop_logical_types, record_fields, struct_type
from ..sources.schemas import newest_reader, texts_by_id

CODECS = ("auto", "arrow", "spark-avro")
AVRO_CLASS = "org.apache.spark.sql.avro.AvroDataToCatalyst"


def has_spark_avro(spark: SparkSession) -> bool:
    """Whether the session can load Spark's own Avro functions."""
    try:
        spark._jvm.org.apache.spark.util.Utils.classForName(AVRO_CLASS, True, False)
    except Py4JError:
        return False
    return True


def chosen_codec(spark: SparkSession, codec: str) -> str:
    """``auto`` is Spark's own codec where its module can be loaded, and the engine's otherwise."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}")
    if codec == "auto":
        return "spark-avro" if has_spark_avro(spark) else "arrow"
    return codec


def record_shape(schema_json: str) -> list[Field] | AvroType:
    """A record's fields if it is flat (strings, ints, longs, and unions of null with one), else its type.

    One with aliases is not flat: its fields may have been written under other names.
    """
    try:
        fields = record_fields(schema_json)
    except ValueError:
        found = avro_type(schema_json)
        if found.kind != "record":
            raise
        return found
    found = avro_type(schema_json)
    return found if any(member.aliases for member in found.members) else fields


KAFKA_COORDINATES = ("key", "topic", "partition", "offset", "timestamp", "timestampType")


def decode_avro(
    df: DataFrame,
    schemas: DataFrame | dict[int, str],
    reader: str | None = None,
    *,
    fields: list[str] | None = None,
    value: str = "value",
    null_string_default: bool = False,
    codec: str = "auto",
) -> DataFrame:
    """Add ``data`` (the decoded record) and ``error`` (why there is none) to messages.

    Each message is read with the schema its header names and brought into the reader
    record; no row is dropped and no message fails the job.

    ``schemas`` is a schema table or ``{schema_id: schema_json}``. ``reader`` is the
    record to produce; by default the highest version of the table, which must then hold
    one subject only, or the highest id of the mapping. ``fields`` limits the reader to
    the named fields, so that unneeded ones are skipped and never leave the decoder.
    ``null_string_default`` reads a default of the text ``null`` as NULL.

    The texts of a schema table are joined to the messages by id and parsed once per batch;
    none is collected but the reader's.

    ``codec="arrow"`` decodes Arrow batches. ``codec="spark-avro"`` uses Spark's own
    ``from_avro`` and needs the spark-avro module; it stays in the JVM but cannot say
    why a body was refused, and its expressions name every schema of the table, which is
    therefore collected. ``codec="auto"`` takes it where the module can be loaded.
    """
    codec = chosen_codec(df.sparkSession, codec)
    by_id = schemas if isinstance(schemas, dict) else None
    if by_id is None:
        newest = newest_reader(schemas, check_subject=reader is None)
        if codec == "spark-avro":
            by_id = {row["schema_id"]: row["schema_json"] for row in texts_by_id(schemas).collect()}
    else:
        newest = by_id[max(by_id)] if by_id else None
    if newest is None:
        raise ValueError("no writer schema to decode with")
    reader_json = newest if reader is None else reader
    shape = record_shape(reader_json)
    wanted = list(shape if isinstance(shape, list) else shape.members)
    if fields is not None:
        unknown = set(fields) - {f.name for f in wanted}
        if unknown:
            raise ValueError(f"the reader record has no field {sorted(unknown)}")
        wanted = [f for f in wanted if f.name in fields]
    if null_string_default:
        optional = {m.name for m in as_record(shape).members if m.type.kind == "optional"}
        wanted = [f._replace(default=None) if f.name in optional and f.default == "null" else f for f in wanted]
    shape = wanted if isinstance(shape, list) else shape._replace(members=tuple(wanted))
    message = F.col(f"`{value}`")
    body, writer_id = wire.strip_header(message), wire.schema_id(message)
    header = wire.header_error(message)
    if codec == "spark-avro":
        result = _from_avro(body, writer_id, by_id, reader_json, as_record(shape))
    else:
        usable = [F.when(header.isNull(), body), F.when(header.isNull(), writer_id)]
        if by_id is None:
            texts = texts_by_id(schemas).select(
                F.col("schema_id").alias("_writer_id"), F.col("schema_json").alias("_writer")
            )
            df = df.join(texts, usable[1] == F.col("_writer_id"), "left").drop("_writer_id")
            usable.append(F.col("_writer"))
        result = decoder(by_id, shape)(*usable)
    columns = {
        "data": F.when(header.isNull(), F.col("_decoded.data")),
        "error": F.coalesce(header, F.col("_decoded.error")),
    }
    return df.withColumn("_decoded", result).withColumns(columns).drop("_decoded", "_writer")


def _from_avro(body, writer_id, by_id, reader_json, wanted: AvroType) -> Column:
    from pyspark.sql.avro.functions import from_avro

    document = drop_logical_types(json.loads(reader_json))
    names = {m.name: m for m in wanted.members}
    document["fields"] = [
        {**spec, "default": names[spec["name"]].default} if names[spec["name"]].has_default else spec
        for spec in document["fields"]
        if spec["name"] in names
    ]
    options = {"mode": "PERMISSIVE", "avroSchema": json.dumps(document)}
    data = F.lit(None).cast(spark_type(wanted))
    known = F.lit(False)
    for key, text in by_id.items():
        writer = json.dumps(drop_logical_types(json.loads(text)))
        data = F.when(writer_id == key, from_avro(body, writer, options)).otherwise(data)
        known = known | (writer_id == key)
    required = [m.name for m in wanted.members if m.type.kind != "optional"]
    refused = data.isNull()
    for name in required:
        refused = refused | data[name].isNull()
    unknown = F.concat(F.lit("unknown schema id "), writer_id.cast("string"))
    error = F.when(~known, unknown).when(refused, F.lit("body does not fit the schema"))
    return F.struct(F.when(~refused, data).alias("data"), error.alias("error"))


def flatten(df: DataFrame, *, keep_kafka: bool = False) -> DataFrame:
    """Put the record's fields at the top level; a NULL record gives an all-NULL row.

    ``keep_kafka`` keeps the message coordinates as well, prefixed with ``kafka_``.
    """
    kept = [
        F.col(name).alias(f"kafka_{name}")
        for name in KAFKA_COORDINATES
        if keep_kafka and name in df.columns
    ]
    return df.select("data.*", *kept)


def encode_avro(
    df: DataFrame, schema_json: str, writer_id: int, *, output: str = "value", codec: str = "auto"
) -> DataFrame:
    """Add the framed Avro message of each row, and ``encode_error`` where none fits.

    ``codec`` is as in :func:`decode_avro`; both ways make the same bytes in the JVM.

    The record's fields are taken from the columns of the same name. A missing column
    takes the field's default; a NULL in a required field is an error on that row. A flat
    record is written by SQL expressions, one of another shape by an Arrow UDF.
    """
    fields = record_shape(schema_json)
    if isinstance(fields, AvroType):
        return _encoded_record(df, fields, schema_json, writer_id, output, codec)
    error = encode_error(fields, df.schema)
    if chosen_codec(df.sparkSession, codec) == "spark-avro":
        from pyspark.sql.avro.functions import to_avro

        kinds = {f.name: f.dataType for f in struct_type(fields).fields}
        held = {f.name: F.col(f"`{f.name}`") if f.name in df.columns else F.lit(f.default) for f in fields}
        record = F.struct(*[held[f.name].cast(kinds[f.name]).alias(f.name) for f in fields])
        body = to_avro(record, json.dumps(drop_logical_types(json.loads(schema_json))))
    else:
        body = avro_body(fields, df.schema)
    message = wire.frame(body, writer_id)
    return df.withColumns({output: F.when(error.isNull(), message), "encode_error": error})


def _encoded_record(df: DataFrame, record: AvroType, schema_json: str, writer_id: int, output: str, codec: str) -> DataFrame:
    """:func:`encode_avro` of a record that is not flat: an Arrow UDF, as SQL has no bytes of a float."""
    there = {m.name: F.col(f"`{m.name}`").try_cast(spark_type(m.type)) for m in record.members if m.name in df.columns}
    missing = [m.name for m in record.members if m.name not in there and not m.has_default and m.type.kind != "optional"]
    held = F.struct(*([column.alias(name) for name, column in there.items()] or [F.lit(None).cast("int").alias("_none")]))
    if missing:
        columns = {output: F.lit(None).cast("binary"), "encode_error": F.lit(f"field {missing[0]} is missing")}
        return df.withColumns(columns)
    if chosen_codec(df.sparkSession, codec) == "spark-avro":
        from pyspark.sql.avro.functions import to_avro

        body = to_avro(held, json.dumps(drop_logical_types(json.loads(schema_json))))
        return df.withColumns({output: wire.frame(body, writer_id), "encode_error": F.lit(None).cast("string")})
    made = df.withColumn("_encoded", encoder(record)(held))
    error = F.col("_encoded.error")
    message = F.when(error.isNull(), wire.frame(F.col("_encoded.body"), writer_id))
    return made.withColumns({output: message, "encode_error": error}).drop("_encoded")
