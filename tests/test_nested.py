import json
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clicklake.functions import nested
from clicklake.functions.avro_types import arrow_type, avro_type, spark_type
from clicklake.operators.codec import decode_avro, encode_avro, flatten
from clicklake.operators.routing import split_decoded

from . import samples

POINT = {"type": "record", "name": "Point", "namespace": "shapes", "fields": [{"name": "x", "type": "double"}, {"name": "y", "type": ["null", "int"]}]}
ALL = json.dumps(
    {
        "type": "record",
        "name": "All",
        "fields": [
            {"name": "flag", "type": "boolean"},
            {"name": "small", "type": "int"},
            {"name": "large", "type": "long"},
            {"name": "single", "type": "float"},
            {"name": "twice", "type": "double"},
            {"name": "raw", "type": "bytes"},
            {"name": "text", "type": "string"},
            {"name": "colour", "type": {"type": "enum", "name": "Colour", "symbols": ["RED", "GREEN", "BLUE"]}},
            {"name": "digest", "type": {"type": "fixed", "name": "Four", "size": 4}},
            {"name": "point", "type": POINT},
            {"name": "other", "type": ["null", "shapes.Point"]},
            {"name": "points", "type": {"type": "array", "items": "shapes.Point"}},
            {"name": "grid", "type": {"type": "array", "items": {"type": "array", "items": "int"}}},
            {"name": "counts", "type": {"type": "map", "values": "long"}},
            {"name": "deep", "type": ["null", {"type": "map", "values": {"type": "array", "items": ["string", "null"]}}]},
        ],
    }
)


def record(n):
    return {
        "flag": n % 2 == 0,
        "small": n * 37 - 500,
        "large": (n - 5) * 2**40,
        "single": float(np.float32(n / 7)),
        "twice": math.inf if n == 4 else n / 7 - 3,
        "raw": bytes(range(n * 9 % 256)),
        "text": "é" * n,
        "colour": ["RED", "GREEN", "BLUE"][n % 3],
        "digest": bytes([n, 0, 255, 1]),
        "point": {"x": n + 0.5, "y": None if n % 3 == 0 else -n},
        "other": None if n % 4 else {"x": -1.0, "y": n},
        "points": [{"x": float(i), "y": i if i % 2 else None} for i in range(n % 5)],
        "grid": [[i * j for j in range(i)] for i in range(n % 4)],
        "counts": {f"k{i}": i - 2 for i in range(n % 3)},
        "deep": None if n % 3 == 1 else {f"m{i}": [None if j % 2 else f"{i}/{j}" for j in range(i)] for i in range(n % 4)},
    }


RECORDS = [record(n) for n in range(20)]


def frame(spark, records, schema=ALL):
    return spark.createDataFrame(pa.Table.from_pylist(as_arrow(records), pa.schema(list(arrow_type(avro_type(schema))))))


def as_arrow(value):
    """Maps as lists of pairs, as Arrow wants them."""
    if isinstance(value, list):
        return [as_arrow(v) for v in value]
    if isinstance(value, dict):
        maps = ("counts", "deep")
        return {k: list((a, as_arrow(b)) for a, b in v.items()) if k in maps and v is not None else as_arrow(v) for k, v in value.items()}
    return value


def plain(row):
    if hasattr(row, "asDict"):
        return {k: plain(v) for k, v in row.asDict().items()}
    if isinstance(row, list):
        return [plain(v) for v in row]
    if isinstance(row, dict):
        return {k: plain(v) for k, v in row.items()}
    return bytes(row) if isinstance(row, bytearray) else row


def java_bodies(spark, schema, records):
    """The bodies that the Java Avro library writes of values as its JSON decoder reads them."""
    jvm = spark._jvm
    parsed = getattr(jvm.org.apache.avro, "Schema$Parser")().parse(schema)
    out = []
    for value in records:
        text = json.dumps(as_json(avro_type(schema), value))
        decoder = jvm.org.apache.avro.io.DecoderFactory.get().jsonDecoder(parsed, text)
        datum = jvm.org.apache.avro.generic.GenericDatumReader(parsed).read(None, decoder)
        stream = jvm.java.io.ByteArrayOutputStream()
        encoder = jvm.org.apache.avro.io.EncoderFactory.get().binaryEncoder(stream, None)
        jvm.org.apache.avro.generic.GenericDatumWriter(parsed).write(datum, encoder)
        encoder.flush()
        out.append(bytes(stream.toByteArray()))
    return out


def as_json(kind, value):
    if kind.kind == "optional":
        inner = kind.inner
        return None if value is None else {inner.name or inner.kind: as_json(inner, value)}
    if kind.kind == "record":
        return {m.name: as_json(m.type, value[m.name]) for m in kind.members}
    if kind.kind == "array":
        return [as_json(kind.inner, v) for v in value]
    if kind.kind == "map":
        return {k: as_json(kind.inner, v) for k, v in value.items()}
    return value.decode("latin-1") if isinstance(value, bytes) else value


def test_bodies_equal_those_of_the_java_library(spark):
    records = [r for r in RECORDS if math.isfinite(r["twice"])]
    framed = encode_avro(frame(spark, records).coalesce(1), ALL, 7).select("value", "encode_error").collect()
    assert {r.encode_error for r in framed} == {None}
    assert [bytes(r.value)[5:] for r in framed] == java_bodies(spark, ALL, records)


def test_roundtrip(spark):
    framed = encode_avro(frame(spark, RECORDS), ALL, 7).select("value")
    good, bad = split_decoded(decode_avro(framed, {7: ALL}))
    rows = flatten(good)
    assert rows.schema == spark_type(avro_type(ALL)) and bad.count() == 0
    assert sorted((plain(r) for r in rows.collect()), key=lambda r: r["digest"]) == RECORDS


def test_sized_blocks_and_several_blocks(spark):
    schema = avro_type('{"type": "record", "name": "R", "fields": [{"name": "a", "type": {"type": "array", "items": "int"}}]}')
    # Two items in a sized block of two bytes, one more in a plain block, the end.
    bodies = pa.array([bytes([3, 4, 2, 4, 2, 6, 0]), bytes([0]), bytes([2, 2])])
    columns, errors = nested.read_records(bodies, schema, schema)
    assert columns[0].to_pylist()[:2] == [[1, 2, 3], []] and errors.tolist() == [None, None, "body ends inside field a"]


WRITER = json.dumps(
    {
        "type": "record",
        "name": "Old",
        "fields": [
            {"name": "a", "type": "int"},
            {"name": "b", "type": "long"},
            {"name": "c", "type": "float"},
            {"name": "d", "type": "string"},
            {"name": "e", "type": "bytes"},
            {"name": "f", "type": "int"},
            {"name": "gone", "type": {"type": "map", "values": {"type": "array", "items": "string"}}},
            {"name": "inner", "type": {"type": "record", "name": "I", "fields": [{"name": "was", "type": "int"}, {"name": "drop", "type": "string"}]}},
            {"name": "kind", "type": {"type": "enum", "name": "K", "symbols": ["A", "B", "C"]}},
            {"name": "list", "type": {"type": "array", "items": "int"}},
            {"name": "maybe", "type": ["null", "int"]},
        ],
    }
)
READER = json.dumps(
    {
        "type": "record",
        "name": "New",
        "fields": [
            {"name": "maybe", "type": ["double", "null"]},
            {"name": "list", "type": {"type": "array", "items": ["null", "double"]}},
            {"name": "kind", "type": {"type": "enum", "name": "K", "symbols": ["A", "C", "Z"], "default": "Z"}},
            {"name": "within", "aliases": ["inner"], "type": {"type": "record", "name": "I", "fields": [
                {"name": "now", "aliases": ["was"], "type": "long"}, {"name": "fresh", "type": {"type": "map", "values": "int"}, "default": {"k": 3}}]}},
            {"name": "f", "type": ["null", "float"], "default": None},
            {"name": "e", "type": "string"},
            {"name": "d", "type": "bytes"},
            {"name": "c", "type": "double"},
            {"name": "b", "type": "float"},
            {"name": "a", "type": "double"},
            {"name": "added", "type": {"type": "array", "items": "bytes"}, "default": ["ÿ"]},
            {"name": "point", "type": POINT, "default": {"x": 1.5, "y": None}},
        ],
    }
)
OLD = {
    "a": 3, "b": 2**40, "c": 0.5, "d": "é", "e": "ü".encode(), "f": -7, "gone": {"x": ["y", "z"], "w": []},
    "inner": {"was": 9, "drop": "dropped"}, "kind": "B", "list": [1, 2], "maybe": 5,
}
NEW = {
    "maybe": 5.0, "list": [1.0, 2.0], "kind": "Z", "within": {"now": 9, "fresh": {"k": 3}}, "f": -7.0, "e": "ü", "d": "é".encode(),
    "c": 0.5, "b": float(2**40), "a": 3.0, "added": [b"\xff"], "point": {"x": 1.5, "y": None},
}


def test_promotions_aliases_and_defaults(spark):
    body, nulled = java_bodies(spark, WRITER, [OLD, OLD | {"maybe": None, "list": [], "kind": "C"}])
    messages = spark.createDataFrame([(samples.framed(body, 1),), (samples.framed(nulled, 1),)], "value binary").coalesce(1)
    rows = decode_avro(messages, {1: WRITER, 2: READER}).collect()
    assert [r.error for r in rows] == [None, None]
    assert plain(rows[0].data) == NEW
    assert plain(rows[1].data) == NEW | {"maybe": None, "list": [], "kind": "C"}


@pytest.mark.parametrize(
    ("written", "read", "value", "error"),
    [
        ("string", "int", "x", "field v was written as string, not int"),
        ("long", "int", 3, "field v was written as long, not int"),
        (["null", "double"], "double", None, "field v is null"),
        ({"type": "enum", "name": "E", "symbols": ["A", "B"]}, {"type": "enum", "name": "E", "symbols": ["A"]}, "B", "enum in field v has a symbol that the reader lacks"),
        ({"type": "fixed", "name": "F", "size": 2}, {"type": "fixed", "name": "F", "size": 3}, b"ab", "field v was written with 2 bytes, not 3"),
        ("bytes", "string", b"\xff", "string in field v is not UTF-8"),
        ({"type": "array", "items": "double"}, {"type": "array", "items": "float"}, [1.0], "field v was written as double, not float"),
    ],
)
def test_what_does_not_resolve_is_a_bad_message(spark, written, read, value, error):
    schemas = {n: json.dumps({"type": "record", "name": "R", "fields": [{"name": "v", "type": t}]}) for n, t in ((1, written), (2, read))}
    body = java_bodies(spark, schemas[1], [{"v": value}])[0]
    row = decode_avro(spark.createDataFrame([(samples.framed(body, 1),)], "value binary"), schemas).first()
    assert row.error == error and row.data is None


def test_a_missing_field_without_default_is_named(spark):
    schemas = {n: json.dumps({"type": "record", "name": "R", "fields": f}) for n, f in ((1, []), (2, [{"name": "p", "type": "double"}]))}
    row = decode_avro(spark.createDataFrame([(samples.framed(b"\0", 1),)], "value binary"), schemas).first()
    assert row.error == "field p is missing and has no default"


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_broken_bodies_never_raise_nor_disturb_others(data):
    kind = avro_type(ALL)
    good = nested.write(pa.array(as_arrow(RECORDS), arrow_type(kind)), kind).to_pylist()
    place = data.draw(st.integers(0, len(good) - 1))
    cut = data.draw(st.integers(0, len(good[place])))
    junk = data.draw(st.binary(max_size=12))
    bodies = list(good)
    bodies[place] = good[place][:cut] + junk
    columns, errors = nested.read_records(pa.array(bodies), kind, kind)
    made = pa.StructArray.from_arrays(columns, fields=list(arrow_type(kind))).to_pylist()
    for n, expected in enumerate(as_arrow(RECORDS)):
        if n != place:
            assert errors[n] is None and made[n] == expected


def test_long_arrays_beside_short_ones():
    kind = avro_type('{"type": "record", "name": "R", "fields": [{"name": "a", "type": {"type": "array", "items": "string"}}]}')
    values = [{"a": [f"item {i}" for i in range(n)]} for n in (0, 5000, 1, 3)]
    bodies = nested.write(pa.array(values, arrow_type(kind)), kind)
    columns, errors = nested.read_records(bodies, kind, kind)
    assert columns[0].to_pylist() == [v["a"] for v in values] and not any(errors)


def test_rows_that_do_not_fit_are_told(spark):
    rows = [RECORDS[0], RECORDS[1] | {"colour": "PINK"}, RECORDS[2] | {"digest": b"abc"}, RECORDS[3] | {"flag": None}]
    rows.append(RECORDS[4] | {"points": [{"x": None, "y": 1}]})
    framed = encode_avro(frame(spark, rows).coalesce(1), ALL, 7).collect()
    text = "field {} is null or does not fit its type"
    assert [r.encode_error for r in framed] == [None, *[text.format(n) for n in ("colour", "digest", "flag", "points")]]
    assert [r.value is None for r in framed] == [False] + [True] * 4


def test_missing_columns_take_defaults(spark):
    schema = json.dumps({"type": "record", "name": "R", "fields": [
        {"name": "d", "type": "double"}, {"name": "l", "type": {"type": "array", "items": "int"}, "default": [1, 2]}, {"name": "o", "type": ["null", "float"]}]})
    rows = spark.range(1).select(F.lit(2.5).alias("d"))
    good, _ = split_decoded(decode_avro(encode_avro(rows, schema, 1).select("value"), {1: schema}))
    assert plain(flatten(good).first()) == {"d": 2.5, "l": [1, 2], "o": None}
    refused = encode_avro(spark.range(1), schema, 1).first()
    assert refused.value is None and refused.encode_error == "field d is missing"


@pytest.mark.parametrize(
    ("declared", "reason"),
    [
        (["null", "int", "string"], "only a union of null and one type"),
        ({"type": "array", "items": "Unknown"}, "'Unknown' is not supported"),
        ({"type": "array", "items": "R"}, "type R holds itself"),
    ],
)
def test_types_that_are_not_read(declared, reason):
    with pytest.raises(ValueError, match=reason):
        avro_type(json.dumps({"type": "record", "name": "R", "fields": [{"name": "v", "type": declared}]}))


def test_flat_records_follow_aliases(spark):
    old = '{"type": "record", "name": "R", "fields": [{"name": "was", "type": "int"}, {"name": "v", "type": "string"}]}'
    new = '{"type": "record", "name": "R", "fields": [{"name": "v", "type": "string"}, {"name": "now", "aliases": ["is", "was"], "type": "long"}]}'
    framed = encode_avro(spark.createDataFrame([(7, "x")], "was int, v string"), old, 1).select("value")
    assert plain(decode_avro(framed, {1: old, 2: new}).first().data) == {"v": "x", "now": 7}
    assert plain(decode_avro(framed, {1: old, 2: new}, fields=["now"]).first().data) == {"now": 7}
