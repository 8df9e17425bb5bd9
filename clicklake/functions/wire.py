"""The framed message: one zero byte, a 4-byte big-endian schema id, the Avro body.

Every function is a JVM expression, so the header is read inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_BYTES = 5


def has_body(value: Column) -> Column:
    """True when bytes follow the header; NULL for a NULL message."""
    return F.length(value) > HEADER_BYTES


def strip_header(value: Column) -> Column:
    """The body after the header, or NULL for a NULL or too short message."""
    body = F.substring(value, F.lit(HEADER_BYTES + 1), F.length(value) - HEADER_BYTES)
    return F.when(has_body(value), body)


def schema_id(value: Column) -> Column:
    """The writer's schema id as an unsigned BIGINT, or NULL without a body."""
    digits = F.hex(F.substring(value, 2, 4))
    return F.when(has_body(value), F.conv(digits, 16, 10).cast("long"))


def header_error(value: Column) -> Column:
    """Why a message cannot be decoded judging by its header, or NULL."""
    return (
        F.when(value.isNull(), F.lit("message has no value"))
        .when(~has_body(value), F.lit("message is too short for a header and a body"))
        .when(F.substring(value, 1, 1) != F.lit(b"\x00"), F.lit("unknown magic byte"))
    )


def frame(body: Column, writer_id: int) -> Column:
    """Put the header in front of an Avro body; a NULL body stays NULL."""
    if not 0 <= writer_id < 2**32:
        raise ValueError(f"schema id {writer_id} does not fit into four bytes")
    header = b"\x00" + writer_id.to_bytes(4, "big")
    return F.concat(F.lit(header), body)


def message_key(column: Column) -> Column:
    """A message key: the UTF-8 bytes of the column's text."""
    return column.cast("string").cast("binary")


def bytes_text(value: Column) -> Column:
    r"""A message as Python writes bytes: ``b'\x00abc'``, or ``None`` for a NULL message.

    Letters, digits and marks stand for themselves; the rest is looked up by its number.
    Double quotes are used around a text with single quotes only.
    """
    shown = F.array(*[F.lit(str(bytes([octet]))[2:-1]) for octet in range(256)])
    quote, other = F.lit(b"'"), F.lit(b'"')
    has_quote, has_other = F.contains(value, quote), F.contains(value, other)
    pairs = F.regexp_extract_all(F.hex(value), F.lit("(..)"), F.lit(1))
    letters = F.transform(pairs, lambda pair: F.get(shown, F.conv(pair, 16, 10).cast("int")))
    # The table shows a single quote as it is; between single quotes it needs a backslash.
    letters = F.when(
        has_quote & has_other, F.transform(letters, lambda x: F.when(x == "'", "\\'").otherwise(x))
    ).otherwise(letters)
    mark = F.when(has_quote & ~has_other, F.lit('"')).otherwise(F.lit("'"))
    return F.when(value.isNull(), F.lit("None")).otherwise(
        F.concat(F.lit("b"), mark, F.array_join(letters, ""), mark)
    )
