from random import Random

import pytest
from pyspark.sql import functions as F

from clicklake.functions import wire

VALUES = [
    (bytes.fromhex("0000000007616263"), b"abc", 7, None),
    (bytes.fromhex("0000000007"), None, None, "message is too short for a header and a body"),
    (b"ab", None, None, "message is too short for a header and a body"),
    (b"", None, None, "message is too short for a header and a body"),
    (None, None, None, "message has no value"),
    (b"\x01\xff\xff\xff\xffx", b"x", 2**32 - 1, "unknown magic byte"),
]


def test_header_of_every_kind_of_message(spark):
    rows = spark.createDataFrame([(v,) for v, *_ in VALUES], "value binary").select(
        wire.strip_header(F.col("value")).alias("body"),
        wire.schema_id(F.col("value")).alias("id"),
        wire.header_error(F.col("value")).alias("error"),
    )
    found = [(r.body if r.body is None else bytes(r.body), r.id, r.error) for r in rows.collect()]
    assert found == [tuple(expected) for _, *expected in VALUES]


def test_frame_puts_the_header_in_front(spark):
    value = spark.range(1).select(wire.frame(F.lit(b"abc"), 258).alias("v")).first().v
    assert bytes(value) == bytes.fromhex("0000000102616263")
    with pytest.raises(ValueError, match="four bytes"):
        wire.frame(F.lit(b""), 2**32)


def test_header_functions_stay_in_generated_code(spark, plan_of):
    rows = spark.range(10).select(F.col("id").cast("string").cast("binary").alias("value"))
    plan = plan_of(rows.select(wire.strip_header(F.col("value")), wire.schema_id(F.col("value"))))
    assert "EvalPython" not in plan
    assert "Project [codegen id : 1]" in plan


def test_message_key_is_utf8_text(spark):
    key = spark.createDataFrame([("é",), (None,)], "s string").select(
        wire.message_key(F.col("s")).alias("k")
    )
    assert [r.k if r.k is None else bytes(r.k) for r in key.collect()] == ["é".encode(), None]


def test_bytes_text_is_what_python_writes(spark):
    random = Random(7)
    values = [bytes([n]) for n in range(256)] + [b"", b"it's", b'"', b"'\"", b"\\'", bytes(range(256))]
    values += [bytes(random.choices(b"ab'\"\\\n\x00\xff", k=random.randrange(9))) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "value binary")
    found = [r.text for r in rows.select(wire.bytes_text(F.col("value")).alias("text")).collect()]
    assert found == [str(v) for v in [*values, None]]
