"""Registered queries of records that are not flat, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.codec import decode_avro, encode_avro, flatten
from ..operators.routing import split_decoded
from .catalogue import MILLIS, query
from .fixtures import events

SHAPES_ID, NEWER_ID = 201, 202
VISIT = """
{"type": "record", "name": "Visit", "namespace": "clicklake", "fields": [
  {"name": "event_id", "type": "long"},
  {"name": "even", "type": "boolean"},
  {"name": "eighth", "type": "float"},
  {"name": "quarter", "type": "double"},
  {"name": "raw", "type": "bytes"},
  {"name": "device", "type": {"type": "enum", "name": "Device", "symbols": ["mobile", "desktop", "tablet"]}},
  {"name": "code", "type": {"type": "fixed", "name": "Code", "size": 4}},
  {"name": "place", "type": {"type": "record", "name": "Place", "fields": [
    {"name": "x", "type": "double"}, {"name": "y", "type": ["null", "int"]}]}},
  {"name": "before", "type": ["null", "Place"]},
  {"name": "steps", "type": {"type": "array", "items": "Place"}},
  {"name": "tags", "type": {"type": "array", "items": ["null", "string"]}},
  {"name": "counts", "type": {"type": "map", "values": "long"}}]}
"""
# A later reader: wider numbers, text for bytes, another name, an enum that lost a symbol, new fields.
NEWER_VISIT = """
{"type": "record", "name": "Visit", "namespace": "clicklake", "fields": [
  {"name": "number", "type": "double", "aliases": ["event_id"]},
  {"name": "eighth", "type": ["null", "double"]},
  {"name": "raw", "type": "string"},
  {"name": "device", "type": {"type": "enum", "name": "Device", "symbols": ["other", "mobile", "tablet"], "default": "other"}},
  {"name": "place", "type": {"type": "record", "name": "Place", "fields": [
    {"name": "height", "type": ["null", "float"], "aliases": ["y"]}, {"name": "z", "type": "int", "default": 9}]}},
  {"name": "counts", "type": {"type": "map", "values": "double"}},
  {"name": "notes", "type": {"type": "array", "items": "string"}, "default": ["none", "so far"]}]}
"""

_PLACE = "named_struct('x', {0} / 2.0D, 'y', CASE WHEN {0} % 3 <> 0 THEN cast({0} % 1000 AS int) END)"
_VISITS = (
    "event_id",
    "event_id % 2 = 0 AS even",
    "cast(event_id / 8.0D AS float) AS eighth",
    "user_id / 4.0D AS quarter",
    "cast(event_type AS binary) AS raw",
    "element_at(array('mobile', 'desktop', 'tablet'), cast(user_id % 3 AS int) + 1) AS device",
    "cast(lpad(cast(event_id % 10000 AS string), 4, '0') AS binary) AS code",
    f"{_PLACE.format('event_id')} AS place",
    f"CASE WHEN event_id % 5 = 0 THEN {_PLACE.format('user_id')} END AS before",
    f"transform(slice(array(1, 2, 3), 1, cast(event_id % 4 AS int)), i -> {_PLACE.format('(event_id + i)')}) AS steps",
    "transform(slice(array(0, 1, 2, 3), 1, cast(event_id % 5 AS int)), i -> CASE WHEN i % 2 = 0 THEN concat(event_type, i) END) AS tags",
    "map_from_arrays(array('user', event_type), array(user_id, unix_millis(cast(ts AS timestamp)))) AS counts",
)


def _messages(spark, sf_dir):
    visits = events(spark, sf_dir).selectExpr(*_VISITS, "event_type")
    return encode_avro(visits, VISIT, SHAPES_ID).select("value", "event_type")


_Y = "CASE WHEN {0} % 3 <> 0 THEN CAST({0} % 1000 AS INTEGER) END"


@query(
    f"""SELECT event_id, event_id % 2 = 0 AS even, CAST(CAST(event_id / 8.0 AS FLOAT) AS DOUBLE) AS eighth,
        CAST(user_id / 4.0 AS DOUBLE) AS quarter, event_type AS raw,
        CASE user_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device,
        printf('%04d', event_id % 10000) AS code, CAST(event_id / 2.0 AS DOUBLE) AS place_x,
        {_Y.format('event_id')} AS place_y,
        CASE WHEN event_id % 5 = 0 THEN CAST(user_id / 2.0 AS DOUBLE) END AS before_x,
        CASE WHEN event_id % 5 = 0 THEN {_Y.format('user_id')} END AS before_y,
        coalesce(array_to_string([CAST(event_id + i AS VARCHAR) || ':' || coalesce(CAST({_Y.format('(event_id + i)')} AS VARCHAR), '-')
          FOR i IN range(1, event_id % 4 + 1)], ' '), '') AS steps,
        coalesce(array_to_string([CASE WHEN i % 2 = 0 THEN event_type || i ELSE '-' END FOR i IN range(0, event_id % 5)], ' '), '') AS tags,
        user_id AS of_user, {MILLIS} AS of_type FROM events"""
)
def avro_roundtrip_shapes(spark, sf_dir):
    """Every type of field there and back: numbers, bytes, enum, fixed, records, arrays, a map."""
    messages = decode_avro(_messages(spark, sf_dir), {SHAPES_ID: VISIT})
    steps = F.transform("data.steps", lambda s: F.concat(
        (s["x"] * 2).cast("long").cast("string"), F.lit(":"), F.coalesce(s["y"].cast("string"), F.lit("-"))
    ))
    return messages.select(
        "data.event_id",
        "data.even",
        F.col("data.eighth").cast("double").alias("eighth"),
        "data.quarter",
        F.col("data.raw").cast("string").alias("raw"),
        "data.device",
        F.col("data.code").cast("string").alias("code"),
        F.col("data.place.x").alias("place_x"),
        F.col("data.place.y").alias("place_y"),
        F.col("data.before.x").alias("before_x"),
        F.col("data.before.y").alias("before_y"),
        F.array_join(steps, " ").alias("steps"),
        F.array_join("data.tags", " ", "-").alias("tags"),
        F.col("data.counts")["user"].alias("of_user"),
        F.col("data.counts")[F.col("event_type")].alias("of_type"),
    )


@query(
    f"""SELECT CAST(event_id AS DOUBLE) AS number, CAST(CAST(event_id / 8.0 AS FLOAT) AS DOUBLE) AS eighth, event_type AS raw,
        CASE user_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'other' ELSE 'tablet' END AS device,
        CAST({_Y.format('event_id')} AS DOUBLE) AS height, 9 AS z, CAST(user_id AS DOUBLE) AS of_user,
        CAST({MILLIS} AS DOUBLE) AS of_type, 'none,so far' AS notes FROM events"""
)
def avro_evolution_of_shapes(spark, sf_dir):
    """The same messages by a later reader: promotions, aliases, a lost symbol, defaults, fields left out."""
    messages = decode_avro(_messages(spark, sf_dir), {SHAPES_ID: VISIT, NEWER_ID: NEWER_VISIT})
    good, _ = split_decoded(messages)
    of_type = F.col("counts")[F.col("raw")].alias("of_type")
    return flatten(good).select(
        "number", "eighth", "raw", "device", F.col("place.height").cast("double").alias("height"),
        "place.z", F.col("counts")["user"].alias("of_user"), of_type, F.array_join("notes", ",").alias("notes"),
    )
