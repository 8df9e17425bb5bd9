"""Avro binary encoding of a row as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import Field

WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _varint_sql(unsigned: str) -> str:
    """Up to ten bytes, low seven bits first; the top bit says that another byte follows.

    The first eight groups of seven bits are moved to the bytes of one number, marked as
    continued, and as many bytes as are needed are cut from it.
    """
    spread = " | ".join(
        f"shiftleft(shiftrightunsigned({unsigned}, {7 * group}) & 127, {56 - 8 * group})"
        for group in range(8)
    )
    marks, sizes = [], []
    for size in range(1, 9):
        fits = f"WHEN shiftrightunsigned({unsigned}, {7 * size}) = 0 THEN"
        mark = int.from_bytes(b"\x80" * (size - 1) + b"\x00" * (9 - size), "big", signed=True)
        marks.append(f"{fits} {mark}L")
        sizes.append(f"{fits} {size}")
    all_marked = int.from_bytes(b"\x80" * 8, "big", signed=True)
    mark = f"CASE {' '.join(marks)} ELSE {all_marked}L END"
    size = f"CASE {' '.join(sizes)} ELSE 8 END"
    ninth, tenth = (f"shiftrightunsigned({unsigned}, {shift})" for shift in (56, 63))
    return f"""concat(
        substring(unhex(lpad(hex({spread} | {mark}), 16, '0')), 1, {size}),
        CASE WHEN {ninth} = 0 THEN X''
             WHEN {tenth} = 0 THEN unhex(lpad(hex({ninth}), 2, '0'))
             ELSE concat(unhex(hex({ninth} & 127 | 128)), X'01') END)"""


def _long_sql(column: str) -> str:
    return _varint_sql(f"(shiftleft({column}, 1) ^ shiftright({column}, 63))")


def _string_sql(column: str) -> str:
    """The length as a varint and the UTF-8 bytes.

    The length of a short string is one byte, cut out of a constant with all of them. For
    longer ones it is computed in a lambda, which keeps it out of the generated code.
    """
    size = f"octet_length({column})"
    doubled = f"array(shiftleft(cast({size} AS bigint), 1))"
    prefix = f"""CASE WHEN {size} < 64 THEN substring(X'{bytes(range(0, 128, 2)).hex()}', {size} + 1, 1)
                 ELSE transform({doubled}, number -> {_varint_sql("number")})[0] END"""
    return f"concat({prefix}, cast({column} AS binary))"


def _literal_sql(value, kind: str) -> str:
    if value is None:
        return "NULL"
    if kind == "string":
        return f"cast(X'{value.encode().hex()}' AS string)"
    return str(int(value))


def _wrong_type(field: Field, schema: T.StructType) -> bool:
    if field.name not in schema.fieldNames():
        return False
    fitting = (T.StringType,) if field.kind == "string" else WHOLE_TYPES
    return not isinstance(schema[field.name].dataType, fitting)


def _misfit(field: Field, schema: T.StructType) -> Column | None:
    """An error text for rows whose field does not fit, or None when every row fits."""
    if field.name not in schema.fieldNames():
        if field.has_default or field.null_branch is not None:
            return None
        return F.lit(f"field {field.name} is missing")
    given = schema[field.name].dataType
    column = F.col(f"`{field.name}`")
    if _wrong_type(field, schema):
        reason = F.lit(f"field {field.name} is {given.simpleString()}, not {field.kind}")
        return reason if field.null_branch is None else F.when(column.isNotNull(), reason)
    error = None
    if field.null_branch is None and schema[field.name].nullable:
        error = F.when(column.isNull(), F.lit(f"field {field.name} is null"))
    if field.kind == "int" and isinstance(given, T.LongType):
        outside = ~column.between(-(2**31), 2**31 - 1)
        text = F.lit(f"field {field.name} is out of the int range")
        error = F.when(outside, text) if error is None else error.when(outside, text)
    return error


def encode_error(fields: list[Field], schema: T.StructType) -> Column:
    """The first reason why a row does not fit the record, or NULL."""
    errors = [error for error in (_misfit(f, schema) for f in fields) if error is not None]
    return F.coalesce(*errors) if errors else F.lit(None).cast("string")


def _column_sql(field: Field, schema: T.StructType) -> str:
    """The column a field is written from; its default stands in for a missing column."""
    column = "NULL"
    if field.name not in schema.fieldNames():
        if field.has_default:
            column = _literal_sql(field.default, field.kind)
    elif not _wrong_type(field, schema):
        column = "`" + field.name.replace("`", "``") + "`"
    return f"cast({column} AS {'string' if field.kind == 'string' else 'bigint'})"


def avro_body(fields: list[Field], schema: T.StructType) -> Column:
    """The Avro body of a row that fits the record (see :func:`encode_error`).

    The body starts with nothing, from a lambda. Spark generates code for a projection
    with a lambda in many small methods, and otherwise one method for all of it, which
    the JIT compiler refuses from about five numbers on (twelve numbers: five times slower).
    """
    pieces = ["transform(array(X''), nothing -> nothing)[0]"]
    for field in fields:
        column = _column_sql(field, schema)
        piece = _string_sql(column) if field.kind == "string" else _long_sql(column)
        if field.null_branch is not None:
            null, value = (f"X'{2 * b:02x}'" for b in (field.null_branch, 1 - field.null_branch))
            piece = f"CASE WHEN {column} IS NULL THEN {null} ELSE concat({value}, {piece}) END"
        pieces.append(piece)
    return F.expr(f"concat({', '.join(pieces)})")
