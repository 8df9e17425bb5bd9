"""Avro schemas of any shape as a tree of types, and the Spark and Arrow types they have.

Records, arrays, maps, enums, fixed, all primitive types, and unions of null with one other
type. Types that hold themselves, and unions of several types, are refused.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import types as T

from .records import NO_DEFAULT, Field, drop_logical_types

PRIMITIVES = {
    "null": (T.StringType(), pa.string()),
    "boolean": (T.BooleanType(), pa.bool_()),
    "int": (T.IntegerType(), pa.int32()),
    "long": (T.LongType(), pa.int64()),
    "float": (T.FloatType(), pa.float32()),
    "double": (T.DoubleType(), pa.float64()),
    "bytes": (T.BinaryType(), pa.binary()),
    "string": (T.StringType(), pa.string()),
}
# What a reader may take a written type for, besides the type itself.
PROMOTIONS = {
    "int": ("long", "float", "double"),
    "long": ("float", "double"),
    "float": ("double",),
    "string": ("bytes",),
    "bytes": ("string",),
}


class AvroType(NamedTuple):
    """One type: ``inner`` is of an array its items, of a map its values, of an optional type the other branch."""

    kind: str
    name: str = ""
    members: tuple = ()
    inner: AvroType | None = None
    symbols: tuple = ()
    default: object = NO_DEFAULT
    size: int = 0
    null_branch: int | None = None
    aliases: tuple = ()


class Member(NamedTuple):
    """A field of a record."""

    name: str
    type: AvroType
    default: object = NO_DEFAULT
    aliases: tuple = ()

    @property
    def has_default(self) -> bool:
        return not (isinstance(self.default, str) and self.default == NO_DEFAULT)


def avro_type(schema_json: str) -> AvroType:
    """The type tree of a schema document; a ``ValueError`` says what of it cannot be read."""
    return _parsed(drop_logical_types(json.loads(schema_json)), {}, "", ())


def as_record(fields: list[Field] | AvroType) -> AvroType:
    """A flat record, given by its fields, as a type; a record of any shape as it is."""
    if isinstance(fields, AvroType):
        return fields
    members = []
    for field in fields:
        kind = AvroType(field.kind)
        if field.null_branch is not None:
            kind = AvroType("optional", inner=kind, null_branch=field.null_branch)
        members.append(Member(field.name, kind, field.default))
    return AvroType("record", members=tuple(members))


def _full(name: str, space: str) -> str:
    return name if "." in name or not space else f"{space}.{name}"


def _parsed(document, names: dict, space: str, open_: tuple) -> AvroType:
    if isinstance(document, list):
        others = [branch for branch in document if branch != "null"]
        if len(document) != 2 or len(others) != 1:
            raise ValueError("only a union of null and one type is read")
        return AvroType("optional", inner=_parsed(others[0], names, space, open_), null_branch=document.index("null"))
    if isinstance(document, str):
        if document in PRIMITIVES:
            return AvroType(document)
        full = _full(document, space)
        if full in open_:
            raise ValueError(f"type {full} holds itself")
        if full not in names:
            raise ValueError(f"Avro type {document!r} is not supported")
        return names[full]
    kind = document["type"]
    if kind in ("record", "enum", "fixed"):
        full = _full(document["name"], document.get("namespace", space))
        inside, aliases = full.rpartition(".")[0], tuple(document.get("aliases", ()))
        if kind == "record":
            members = tuple(
                Member(
                    spec["name"],
                    _parsed(spec["type"], names, inside, (*open_, full)),
                    spec.get("default", NO_DEFAULT),
                    tuple(spec.get("aliases", ())),
                )
                for spec in document["fields"]
            )
            made = AvroType(kind, full, members, aliases=aliases)
        elif kind == "enum":
            made = AvroType(kind, full, symbols=tuple(document["symbols"]), default=document.get("default", NO_DEFAULT), aliases=aliases)
        else:
            made = AvroType(kind, full, size=int(document["size"]), aliases=aliases)
        names[full] = made
        return made
    if kind in ("array", "map"):
        return AvroType(kind, inner=_parsed(document["items" if kind == "array" else "values"], names, space, open_))
    return _parsed(kind, names, space, open_)


def spark_type(kind: AvroType) -> T.DataType:
    """The Spark type that values have; everything may be null."""
    if kind.kind in PRIMITIVES:
        return PRIMITIVES[kind.kind][0]
    if kind.kind == "optional":
        return spark_type(kind.inner)
    if kind.kind == "record":
        return T.StructType([T.StructField(m.name, spark_type(m.type)) for m in kind.members])
    if kind.kind == "array":
        return T.ArrayType(spark_type(kind.inner))
    if kind.kind == "map":
        return T.MapType(T.StringType(), spark_type(kind.inner))
    return T.StringType() if kind.kind == "enum" else T.BinaryType()


def arrow_type(kind: AvroType) -> pa.DataType:
    """The Arrow type that values have."""
    if kind.kind in PRIMITIVES:
        return PRIMITIVES[kind.kind][1]
    if kind.kind == "optional":
        return arrow_type(kind.inner)
    if kind.kind == "record":
        return pa.struct([pa.field(m.name, arrow_type(m.type)) for m in kind.members])
    if kind.kind == "array":
        return pa.list_(arrow_type(kind.inner))
    if kind.kind == "map":
        return pa.map_(pa.string(), arrow_type(kind.inner))
    return pa.string() if kind.kind == "enum" else pa.binary()


def default_value(kind: AvroType, given):
    """A default of a schema document as a Python value of the Arrow type.

    Bytes are written there as text, a character a byte. The default of a union belongs to
    its first branch; as elsewhere here, the text of another branch is taken as well.
    """
    if kind.kind == "optional":
        return None if given is None else default_value(kind.inner, given)
    if kind.kind in ("bytes", "fixed"):
        return given.encode("latin-1")
    if kind.kind == "array":
        return [default_value(kind.inner, item) for item in given]
    if kind.kind == "map":
        return [(key, default_value(kind.inner, value)) for key, value in given.items()]
    if kind.kind == "record":
        return {
            m.name: default_value(m.type, given[m.name] if m.name in given else m.default) for m in kind.members
        }
    return given
