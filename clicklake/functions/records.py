"""Avro record documents: parsing, cleaning, and the record shapes of this engine.

A record here is flat: strings, ints, longs, and unions of null with one of them.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import types as T

SPARK_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}

NO_DEFAULT = "__no_default__"

# --- Fixed values: record shapes and topic defaults that results depend on ------------
CLICK_STREAM_V1 = """
{"type": "record", "name": "ClickStream", "namespace": "clicklake", "fields": [
  {"name": "event_id", "type": "string"},
  {"name": "user_id", "type": "string"},
  {"name": "session_id", "type": "string"},
  {"name": "url", "type": "string"},
  {"name": "event_type", "type": "string"},
  {"name": "device", "type": "string"},
  {"name": "referrer", "type": "string"},
  {"name": "timestamp", "type": "long", "logicalType": "timestamp"}]}
"""
USER_EVENT_V1 = """
{"type": "record", "name": "UserEvent", "namespace": "clicklake", "fields": [
  {"name": "timestamp", "type": {"type": "long", "logicalType": "timestamp"}},
  {"name": "user_id", "type": "long"},
  {"name": "session_id", "type": "string"},
  {"name": "event_type", "type": "string"},
  {"name": "page", "type": "string"},
  {"name": "referrer", "type": "string"},
  {"name": "user_agent", "type": "string"}]}
"""
USER_EVENT_V2 = """
{"type": "record", "name": "UserEvent", "namespace": "clicklake", "fields": [
  {"name": "timestamp", "type": {"type": "long", "logicalType": "timestamp"}},
  {"name": "user_id", "type": "long"},
  {"name": "session_id", "type": "string"},
  {"name": "event_type", "type": "string"},
  {"name": "page", "type": "string"},
  {"name": "referrer", "type": "string"},
  {"name": "user_agent", "type": "string"},
  {"name": "user_process", "type": ["null", "string"], "default": "null"}]}
"""
USER_EVENT_V3 = """
{"type": "record", "name": "UserEvent", "namespace": "clicklake", "fields": [
  {"name": "timestamp", "type": {"type": "long", "logicalType": "timestamp"}},
  {"name": "user_id", "type": "long"},
  {"name": "session_id", "type": "string"},
  {"name": "event_type", "type": "string"},
  {"name": "page", "type": "string"},
  {"name": "referrer", "type": "string"},
  {"name": "user_agent", "type": "string"},
  {"name": "user_process", "type": ["null", "string"], "default": "null"},
  {"name": "route", "type": ["null", "string"], "default": "null"}]}
"""
DLQ_V1 = """
{"type": "record", "name": "userEventsDLQ", "namespace": "clicklake", "fields": [
  {"name": "error", "type": "string"},
  {"name": "raw_payload", "type": "string"},
  {"name": "topic", "type": "string"},
  {"name": "partition", "type": "int"},
  {"name": "offset", "type": "long"},
  {"name": "timestamp", "type": "long"}]}
"""
DLQ_SOURCE = "consumer"
DLQ_TOPIC = "base-topic.dlq"
# --------------------------------------------------------------------------------------


class Field(NamedTuple):
    """One field of a flat Avro record.

    ``null_branch`` is the position of null in the field's union, or None when the field
    is required.
    """

    name: str
    kind: str
    null_branch: int | None = None
    default: object = NO_DEFAULT

    @property
    def has_default(self) -> bool:
        return self.default != NO_DEFAULT


def drop_logical_types(document):
    """A copy of a schema document without ``logicalType``, at every depth."""
    if isinstance(document, dict):
        return {
            name: drop_logical_types(part)
            for name, part in document.items()
            if name != "logicalType"
        }
    if isinstance(document, list):
        return [drop_logical_types(part) for part in document]
    return document


def record_fields(schema_json: str) -> list[Field]:
    """The fields of a flat record, in wire order."""
    document = drop_logical_types(json.loads(schema_json))
    if not isinstance(document, dict) or document.get("type") != "record":
        raise ValueError("the schema document is not an Avro record")
    return [_field(spec) for spec in document["fields"]]


def _field(spec: dict) -> Field:
    declared, null_branch = spec["type"], None
    if isinstance(declared, list):
        others = [branch for branch in declared if branch != "null"]
        if len(declared) != 2 or len(others) != 1:
            raise ValueError(f"field {spec['name']}: only a union of null and one type is read")
        null_branch = declared.index("null")
        declared = others[0]
    kind = declared["type"] if isinstance(declared, dict) else declared
    if kind not in SPARK_TYPES:
        raise ValueError(f"field {spec['name']}: Avro type {kind!r} is not supported")
    return Field(spec["name"], kind, null_branch, spec.get("default", NO_DEFAULT))


def struct_type(fields: list[Field]) -> T.StructType:
    """The Spark struct a decoded record has; every field can be null on a failed row."""
    return T.StructType([T.StructField(f.name, SPARK_TYPES[f.kind]) for f in fields])
