"""Avro binary decoding of whole Arrow batches.

Spark without its Avro module has no decoder, and the length-prefixed layout cannot be
read by SQL functions, so this is the one Arrow UDF of the engine. It works on columns:
each step reads one field of *every* message in the batch with numpy, keeping a read
position per message, and string fields are cut out of the batch's own buffer by Arrow.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import nested, records
from .avro_types import AvroType, arrow_type, as_record, avro_type, spark_type
from .records import Field

# The UDF carries its code with it, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
register_pickle_by_value(records)

ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
VARINT_BYTES = {"int": 5, "long": 10}


class _Cursor:
    """Read positions into a batch of messages, and the first failure of each."""

    def __init__(self, bodies: pa.LargeBinaryArray):
        count = len(bodies)
        _, offsets, data = bodies.buffers()
        bounds = np.frombuffer(offsets, np.int64, count + 1, bodies.offset * 8)
        self.data = data if data is not None else pa.py_buffer(b"")
        self.octets = np.frombuffer(self.data, np.uint8)
        self.at, self.end = bounds[:-1].copy(), bounds[1:]
        self.failed = np.zeros(count, bool)
        self.error = np.full(count, None, object)

    def fail(self, rows, reason: str) -> None:
        """Record a reason for rows (a mask or positions) that have not failed yet."""
        picked = np.zeros(len(self.at), bool)
        picked[rows] = True
        picked &= ~self.failed
        self.error[picked] = reason
        self.failed |= picked

    def whole(self, rows: np.ndarray, name: str, kind: str) -> np.ndarray:
        """Zig-zag varints at the positions of ``rows``; other rows give 0."""
        unsigned = np.zeros(len(self.at), np.uint64)
        width = VARINT_BYTES[kind]
        for step in range(width):
            inside = self.at[rows] < self.end[rows]
            if not inside.all():
                self.fail(rows[~inside], f"body ends inside field {name}")
                rows = rows[inside]
            octet = self.octets[self.at[rows]]
            unsigned[rows] |= (octet & 0x7F).astype(np.uint64) << np.uint64(7 * step)
            self.at[rows] += 1
            rows = rows[octet > 0x7F]
            if not len(rows):
                break
        else:
            self.fail(rows, f"number in field {name} is longer than {width} bytes")
        signed = (unsigned >> np.uint64(1)).view(np.int64) ^ -(unsigned & np.uint64(1)).view(np.int64)
        if kind == "int":
            self.fail(signed != signed.astype(np.int32), f"number in field {name} is not an int")
        signed[self.failed] = 0
        return signed

    def text(self, rows: np.ndarray, name: str) -> pa.Array:
        """Length-prefixed strings; rows outside ``rows`` or failed give ''."""
        size = self.whole(rows, name, "long")
        self.fail(size < 0, f"string in field {name} has a negative length")
        self.fail(size > self.end - self.at, f"body ends inside field {name}")
        size[self.failed] = 0
        # Offsets at the start and the end of each string make an array that alternates
        # between strings and the gaps between them, over the buffer as it is.
        edges = np.empty(2 * len(size), np.int64)
        edges[0::2] = self.at
        edges[1::2] = self.at + size
        self.at += size
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), max(len(edges) - 1, 0), [None, pa.py_buffer(edges), self.data]
        )
        cut = pieces.take(pa.array(np.arange(0, len(edges), 2)))
        try:
            return cut.cast(pa.string())
        except pa.ArrowInvalid:
            broken = np.array([not _is_text(piece) for piece in cut.to_pylist()], bool)
            self.fail(broken, f"string in field {name} is not UTF-8")
            return pc.if_else(pa.array(broken), b"", cut).cast(pa.string())

    def skip(self, field: Field) -> None:
        """Move past the next field of every message; of a string only the length is read."""
        rows = np.flatnonzero(~self.failed)
        if field.null_branch is not None:
            branch = self.whole(rows, field.name, "long")
            self.fail((branch < 0) | (branch > 1), f"union in field {field.name} has no such branch")
            rows = np.flatnonzero(~self.failed & (branch != field.null_branch))
        size = self.whole(rows, field.name, "long" if field.kind == "string" else field.kind)
        if field.kind == "string":
            self.fail(size < 0, f"string in field {field.name} has a negative length")
            self.fail(size > self.end - self.at, f"body ends inside field {field.name}")
            size[self.failed] = 0
            self.at += size

    def field(self, field: Field) -> tuple[pa.Array, np.ndarray]:
        """The next field of every message, with a mask of nulls."""
        rows = np.flatnonzero(~self.failed)
        nulls = np.zeros(len(self.at), bool)
        if field.null_branch is not None:
            branch = self.whole(rows, field.name, "long")
            self.fail((branch < 0) | (branch > 1), f"union in field {field.name} has no such branch")
            nulls = (branch == field.null_branch) & ~self.failed
            rows = np.flatnonzero(~self.failed & ~nulls)
        if field.kind == "string":
            return self._masked_text(rows, field.name, nulls), nulls
        return pa.array(self.whole(rows, field.name, field.kind), mask=nulls), nulls

    def _masked_text(self, rows, name, nulls) -> pa.Array:
        if not nulls.any():
            return self.text(rows, name)
        return pc.if_else(pa.array(nulls), pa.scalar(None, pa.string()), self.text(rows, name))


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def decode_bodies(bodies: pa.Array, writer: list[Field], reader: list[Field]) -> tuple[list, np.ndarray]:
    """Read messages of one writer record into the reader's columns.

    Returns the columns in reader order and an array of reasons (None on a good row).
    Fields the reader lacks are skipped over; fields the writer lacks take the reader's
    default. Bytes after the last field are ignored.
    """
    cursor = _Cursor(bodies.cast(pa.large_binary()))
    found, wanted = {}, {field.name: field for field in reader}
    for field in writer:
        target = wanted.get(field.name)
        if target is None:
            cursor.skip(field)
            continue
        column, nulls = cursor.field(field)
        if target.kind != field.kind and (field.kind, target.kind) != ("int", "long"):
            reason = f"field {field.name} was written as {field.kind}, not {target.kind}"
            cursor.fail(slice(None), reason)
            column = pa.nulls(len(bodies))
        elif target.null_branch is None and nulls.any():
            cursor.fail(nulls, f"field {field.name} is null")
        found[field.name] = column.cast(ARROW_TYPES[target.kind])
    for target in reader:
        if target.name not in found:
            if not target.has_default:
                cursor.fail(slice(None), f"field {target.name} is missing and has no default")
            default = target.default if target.has_default else None
            found[target.name] = pa.repeat(pa.scalar(default, ARROW_TYPES[target.kind]), len(bodies))
    return [found[target.name] for target in reader], cursor.error


def _decode_batch(bodies, ids, writers, reader) -> pa.StructArray:
    """Decode a batch that may mix writer versions; one pass per version present.

    ``reader`` is flat, a list of fields, or a record of any shape. Flat messages that are read
    as flat take the short way.
    """
    whole = as_record(reader)
    kinds = [arrow_type(member.type) for member in whole.members]
    names = [member.name for member in whole.members]
    id_values = ids.fill_null(-1).to_numpy(zero_copy_only=False)
    pieces, places, errors = [], [], []
    for writer_id in np.unique(id_values):
        rows = np.flatnonzero(id_values == writer_id)
        part = bodies if len(rows) == len(bodies) else bodies.take(pa.array(rows))
        writer = writers(int(writer_id), rows)
        if isinstance(writer, list) and isinstance(reader, list):
            columns, reason = decode_bodies(part, writer, reader)
        elif isinstance(writer, list | AvroType):
            columns, reason = nested.read_records(part, as_record(writer), whole)
        else:
            why = f"unknown schema id {writer_id}"
            if writer is not None:
                why = f"schema id {writer_id} is not supported: {writer}"
            columns = [pa.nulls(len(rows), kind) for kind in kinds]
            reason = np.full(len(rows), why, object)
        pieces.append(columns)
        places.append(rows)
        errors.append(reason)
    if not pieces:
        columns = [pa.nulls(0, kind) for kind in kinds]
        error = pa.nulls(0, pa.string())
    elif len(pieces) == 1:
        columns, error = pieces[0], pa.array(errors[0], pa.string())
    else:
        order = pa.array(np.argsort(np.concatenate(places), kind="stable"))
        columns = [pa.concat_arrays(same).take(order) for same in zip(*pieces, strict=True)]
        error = pa.array(np.concatenate(errors), pa.string()).take(order)
    data = pa.StructArray.from_arrays(columns, names, mask=error.is_valid())
    return pa.StructArray.from_arrays([data, error], ["data", "error"])


def _writer(schema_json: str) -> list[Field] | AvroType | str:
    """A writer schema, flat or of any shape, or why its messages cannot be read."""
    try:
        return records.record_fields(schema_json)
    except (KeyError, TypeError, ValueError):
        pass
    try:
        found = avro_type(schema_json)
    except (KeyError, TypeError, ValueError) as unreadable:
        return str(unreadable)
    return found if found.kind == "record" else "the schema document is not an Avro record"


def decoder(by_id: dict[int, str] | None, reader: list[Field] | AvroType):
    """An Arrow UDF ``(body, schema id[, schema text]) -> struct<data, error>``.

    ``by_id`` has the writer schemas; with None, each message brings its own, which is parsed
    once per batch and id. A schema that cannot be read fails its messages and says why.

    It is marked non-deterministic so that Catalyst neither copies it into the filters
    above it nor runs it twice per row.
    """
    result = T.StructType(
        [
            T.StructField("data", spark_type(as_record(reader))),
            T.StructField("error", T.StringType()),
        ]
    )

    if by_id is None:

        def decode(bodies: pa.Array, ids: pa.Array, texts: pa.Array) -> pa.Array:
            def brought(_, rows):
                text = texts[int(rows[0])].as_py()
                return None if text is None else _writer(text)

            return _decode_batch(bodies, ids, brought, reader)

    else:
        writers = {int(key): _writer(text) for key, text in by_id.items()}

        def decode(bodies: pa.Array, ids: pa.Array) -> pa.Array:
            return _decode_batch(bodies, ids, lambda writer_id, _: writers.get(writer_id), reader)

    return F.arrow_udf(decode, returnType=result).asNondeterministic()
