"""Avro bodies of any shape to and from Arrow columns, a column at a time.

A body is read as ``decode`` reads flat ones: a position per message, and one value of all
messages at a time. Inside arrays and maps, one item of all messages that still have one is
read at a time, so the steps are as many as the longest of them has items, not as all have.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from . import avro_types
from .avro_types import PROMOTIONS, AvroType, Member, arrow_type, default_value
from .records import NO_DEFAULT

register_pickle_by_value(sys.modules[__name__])
register_pickle_by_value(avro_types)

WIDTHS = {"float": ("<f4", 4), "double": ("<f8", 8)}


class Cursor:
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

    def fail(self, rows: np.ndarray, reason: str) -> None:
        """Record a reason for rows that have not failed yet; they are not read any further."""
        rows = rows[~self.failed[rows]]
        self.error[rows] = reason
        self.failed[rows] = True

    def number(self, rows: np.ndarray, where: str, width: int = 10) -> np.ndarray:
        """A zig-zag varint of each row; a failed row gives 0."""
        unsigned = np.zeros(len(rows), np.uint64)
        left = np.flatnonzero(~self.failed[rows])
        for step in range(width):
            outside = self.at[rows[left]] >= self.end[rows[left]]
            if outside.any():
                self.fail(rows[left[outside]], f"body ends inside field {where}")
                left = left[~outside]
            octet = self.octets[self.at[rows[left]]]
            unsigned[left] |= (octet & 0x7F).astype(np.uint64) << np.uint64(7 * step)
            self.at[rows[left]] += 1
            left = left[octet > 0x7F]
            if not len(left):
                break
        else:
            self.fail(rows[left], f"number in field {where} is longer than {width} bytes")
        signed = (unsigned >> np.uint64(1)).view(np.int64) ^ -(unsigned & np.uint64(1)).view(np.int64)
        signed[self.failed[rows]] = 0
        return signed

    def cut(self, rows: np.ndarray, sizes: np.ndarray, where: str) -> pa.Array:
        """So many bytes of each row; a failed row gives none. ``rows`` ascend."""
        self.fail(rows[sizes < 0], f"value in field {where} has a negative length")
        self.fail(rows[sizes > self.end[rows] - self.at[rows]], f"body ends inside field {where}")
        sizes = np.where(self.failed[rows], 0, sizes)
        edges = np.empty(2 * len(rows), np.int64)
        edges[0::2] = self.at[rows]
        edges[1::2] = self.at[rows] + sizes
        self.at[rows] += sizes
        kind = pa.large_binary()
        pieces = pa.LargeBinaryArray.from_buffers(kind, max(len(edges) - 1, 0), [None, pa.py_buffer(edges), self.data])
        return pieces.take(pa.array(np.arange(0, len(edges), 2))).cast(pa.binary())

    def text(self, rows: np.ndarray, found: pa.Array, where: str) -> pa.Array:
        """Bytes as text; rows whose bytes are not UTF-8 fail."""
        try:
            return found.cast(pa.string())
        except pa.ArrowInvalid:
            broken = np.zeros(len(rows), bool)
            for place, piece in enumerate(found.to_pylist()):
                try:
                    piece.decode("utf-8")
                except UnicodeDecodeError:
                    broken[place] = True
            self.fail(rows[broken], f"string in field {where} is not UTF-8")
            return pc.if_else(pa.array(broken), b"", found).cast(pa.string())


def _spread(column: pa.Array, places: np.ndarray, count: int) -> pa.Array:
    """The column's values at these places of a longer one; the others are null."""
    if len(places) == count:
        return column
    index = np.full(count, -1, np.int64)
    index[places] = np.arange(len(places))
    return column.take(pa.array(index, mask=index < 0))


def read(cursor: Cursor, rows: np.ndarray, writer: AvroType, reader: AvroType | None, where: str) -> pa.Array:
    """The next value of each row, written as ``writer``, as a column of the reader's type.

    Without a reader the value is passed over, and what comes back means nothing.
    """
    if writer.kind == "optional":
        branch = cursor.number(rows, where)
        cursor.fail(rows[(branch < 0) | (branch > 1)], f"union in field {where} has no such branch")
        null = branch == writer.null_branch
        if reader is not None and reader.kind != "optional":
            cursor.fail(rows[null], f"field {where} is null")
        there = np.flatnonzero(~null)
        target = reader.inner if reader is not None and reader.kind == "optional" else reader
        return _spread(read(cursor, rows[there], writer.inner, target, where), there, len(rows))
    if reader is not None and reader.kind == "optional":
        if writer.kind == "null":
            return pa.nulls(len(rows), arrow_type(reader))
        return read(cursor, rows, writer, reader.inner, where)
    if reader is not None and reader.kind != writer.kind and reader.kind not in PROMOTIONS.get(writer.kind, ()):
        cursor.fail(rows, f"field {where} was written as {writer.kind}, not {reader.kind}")
        return pa.nulls(len(rows), arrow_type(reader))
    found = _READERS[writer.kind](cursor, rows, writer, reader, where)
    if reader is None or reader.kind == writer.kind:
        return found
    if reader.kind == "string":
        return cursor.text(rows, found, where)
    return found.cast(arrow_type(reader), safe=False)


def _read_null(cursor, rows, writer, reader, where):
    return pa.nulls(len(rows), pa.string())


def _read_boolean(cursor, rows, writer, reader, where):
    octets = _fixed_width(cursor, rows, 1, where)[:, 0]
    cursor.fail(rows[octets > 1], f"boolean in field {where} is neither 0 nor 1")
    return pa.array(octets == 1)


def _fixed_width(cursor: Cursor, rows: np.ndarray, width: int, where: str) -> np.ndarray:
    """So many bytes of each row as a matrix; a failed row has zeros."""
    cursor.fail(rows[cursor.end[rows] - cursor.at[rows] < width], f"body ends inside field {where}")
    live = np.flatnonzero(~cursor.failed[rows])
    out = np.zeros((len(rows), width), np.uint8)
    out[live] = cursor.octets[cursor.at[rows[live]][:, None] + np.arange(width)]
    cursor.at[rows[live]] += width
    return out


def _read_int(cursor, rows, writer, reader, where):
    found = cursor.number(rows, where, 5)
    cursor.fail(rows[found != found.astype(np.int32)], f"number in field {where} is not an int")
    return pa.array(found.astype(np.int32))


def _read_long(cursor, rows, writer, reader, where):
    return pa.array(cursor.number(rows, where))


def _read_float(cursor, rows, writer, reader, where):
    dtype, width = WIDTHS[writer.kind]
    return pa.array(_fixed_width(cursor, rows, width, where).view(dtype)[:, 0])


def _read_bytes(cursor, rows, writer, reader, where):
    return cursor.cut(rows, cursor.number(rows, where), where)


def _read_string(cursor, rows, writer, reader, where):
    found = _read_bytes(cursor, rows, writer, reader, where)
    return found if reader is None or reader.kind == "bytes" else cursor.text(rows, found, where)


def _read_fixed(cursor, rows, writer, reader, where):
    if reader is not None and reader.size != writer.size:
        cursor.fail(rows, f"field {where} was written with {writer.size} bytes, not {reader.size}")
    return cursor.cut(rows, np.where(cursor.failed[rows], 0, writer.size), where)


def _read_enum(cursor, rows, writer, reader, where):
    place = cursor.number(rows, where)
    outside = (place < 0) | (place >= len(writer.symbols))
    cursor.fail(rows[outside], f"enum in field {where} has no symbol of that number")
    known = list(writer.symbols)
    if reader is not None:
        other = None if reader.default == NO_DEFAULT else reader.default
        known = [symbol if symbol in reader.symbols else other for symbol in known]
        missing = np.array([symbol is None for symbol in known], bool)
        place = np.where(outside, 0, place)
        if missing.any():
            cursor.fail(rows[missing[place]], f"enum in field {where} has a symbol that the reader lacks")
    return pa.array(known, pa.string()).take(pa.array(np.where(outside, 0, place)))


def _target(member: Member, reader: AvroType) -> Member | None:
    """The reader's member for a written one, by its name or one of its aliases."""
    by_alias = None
    for target in reader.members:
        if target.name == member.name:
            return target
        if member.name in target.aliases:
            by_alias = by_alias or target
    return by_alias


def _read_record(cursor, rows, writer, reader, where):
    found = {}
    for member in writer.members:
        target = _target(member, reader) if reader is not None else None
        inside = f"{where}.{member.name}" if where else member.name
        column = read(cursor, rows, member.type, target.type if target else None, inside)
        if target is not None:
            found[target.name] = column
    if reader is None:
        return pa.nulls(len(rows))
    for target in reader.members:
        if target.name in found:
            continue
        kind, value = arrow_type(target.type), None
        if target.has_default:
            value = default_value(target.type, target.default)
        else:
            cursor.fail(rows, f"field {f'{where}.' if where else ''}{target.name} is missing and has no default")
        found[target.name] = pa.array([value] * len(rows), kind)
    columns = [found[m.name] for m in reader.members]
    if not columns:
        return pa.array([{}] * len(rows), pa.struct([]))
    return pa.StructArray.from_arrays(columns, fields=list(arrow_type(reader)))


def _counts(cursor: Cursor, rows: np.ndarray, where: str) -> np.ndarray:
    """How many items the next block of each row has; the size of a sized block is passed over."""
    count = cursor.number(rows, where)
    sized = np.flatnonzero(count < 0)
    if len(sized):
        cursor.number(rows[sized], where)
    count = np.abs(count)
    # An item takes a byte at least; items of no bytes are as many as there are bytes left, at most.
    cursor.fail(rows[(count < 0) | (count > cursor.end[rows] - cursor.at[rows])], f"body ends inside field {where}")
    return np.where(cursor.failed[rows], 0, count)


def _items(cursor: Cursor, rows: np.ndarray, where: str, one) -> tuple[list[list[pa.Array]], np.ndarray]:
    """All items of each row: for each part of an item its pieces, and the place of each item's row."""
    left = _counts(cursor, rows, where)
    parts: list = []
    owners = [np.zeros(0, np.int64)]
    active = np.flatnonzero(left > 0)
    while len(active):
        parts.append(one(rows[active]))
        owners.append(active)
        left[active] -= 1
        ended = active[left[active] == 0]
        if len(ended):
            left[ended] = _counts(cursor, rows[ended], where)
        active = active[(left[active] > 0) & ~cursor.failed[rows[active]]]
    return parts, np.concatenate(owners)


def _gathered(pieces: list[pa.Array], owners: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Pieces read item by item, in the order of their rows."""
    if not pieces:
        return pa.array([], kind)
    return pa.concat_arrays(pieces).take(pa.array(np.argsort(owners, kind="stable")))


def _offsets(owners: np.ndarray, count: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=count))]), pa.int32())


def _read_array(cursor, rows, writer, reader, where):
    target = reader.inner if reader is not None else None
    parts, owners = _items(cursor, rows, where, lambda live: read(cursor, live, writer.inner, target, where))
    if reader is None:
        return pa.nulls(len(rows))
    values = _gathered(parts, owners, arrow_type(target))
    return pa.ListArray.from_arrays(_offsets(owners, len(rows)), values, type=arrow_type(reader))


def _read_map(cursor, rows, writer, reader, where):
    target = reader.inner if reader is not None else None

    def entry(live):
        key = cursor.text(live, _read_bytes(cursor, live, writer, None, where), where)
        return key, read(cursor, live, writer.inner, target, where)

    parts, owners = _items(cursor, rows, where, entry)
    if reader is None:
        return pa.nulls(len(rows))
    keys = _gathered([key for key, _ in parts], owners, pa.string())
    values = _gathered([value for _, value in parts], owners, arrow_type(target))
    return pa.MapArray.from_arrays(_offsets(owners, len(rows)), keys, values, type=arrow_type(reader))


_READERS = {
    "null": _read_null,
    "boolean": _read_boolean,
    "int": _read_int,
    "long": _read_long,
    "float": _read_float,
    "double": _read_float,
    "bytes": _read_bytes,
    "string": _read_string,
    "fixed": _read_fixed,
    "enum": _read_enum,
    "record": _read_record,
    "array": _read_array,
    "map": _read_map,
}


def read_records(bodies: pa.Array, writer: AvroType, reader: AvroType) -> tuple[list, np.ndarray]:
    """Messages of one writer record as the reader's columns, and why each bad one is bad (None if good)."""
    cursor = Cursor(bodies.cast(pa.large_binary()))
    made = read(cursor, np.arange(len(bodies)), writer, reader, "")
    return made.flatten(), cursor.error


# --- Writing ----------------------------------------------------------------------------


def _varints(numbers: np.ndarray) -> pa.Array:
    unsigned = ((numbers << 1) ^ (numbers >> 63)).view(np.uint64)
    places = np.arange(10, dtype=np.uint64)
    groups = ((unsigned[:, None] >> (places * np.uint64(7))) & np.uint64(0x7F)).astype(np.uint8)
    sizes = 1 + (unsigned[:, None] >= np.uint64(1) << (places[1:] * np.uint64(7))).sum(1)
    groups[np.arange(10) < sizes[:, None] - 1] |= 0x80
    return _binary(groups[np.arange(10) < sizes[:, None]], sizes)


def _binary(octets: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(octets))
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), data])


def _joined(*pieces: pa.Array) -> pa.Array:
    """The pieces of each row one after the other; null where one of them is."""
    return pc.binary_join_element_wise(*pieces, pa.scalar(b"", pa.binary()))


def _sized(found: pa.Array) -> pa.Array:
    sizes = pc.binary_length(found).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _joined(_varints(sizes), found)


def _blocks(sizes: np.ndarray, items: pa.Array) -> pa.Array:
    """Items of each row as one block, with its end; a row without items has the end alone."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), items)
    inside = pc.binary_join(lists, pa.scalar(b"", pa.binary()))
    end = pa.repeat(pa.scalar(b"\0", pa.binary()), len(sizes))
    return pc.if_else(pa.array(sizes == 0), end, _joined(_varints(sizes), inside, end))


def write(column: pa.Array, kind: AvroType) -> pa.Array:
    """The bytes of each value; null where the value, or one inside it, does not fit the type."""
    if kind.kind == "optional":
        null, branch = (pa.repeat(pa.scalar(bytes([2 * b]), pa.binary()), len(column)) for b in (kind.null_branch, 1 - kind.null_branch))
        return pc.if_else(column.is_null(), null, _joined(branch, write(column, kind.inner)))
    if kind.kind == "null":
        return pa.repeat(pa.scalar(b"", pa.binary()), len(column))
    made = _WRITERS[kind.kind](column, kind)
    return pc.if_else(column.is_null(), pa.scalar(None, pa.binary()), made)


def _write_whole(column, kind):
    return _varints(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))


def _write_boolean(column, kind):
    found = column.fill_null(False).to_numpy(zero_copy_only=False)
    return _binary(found.astype(np.uint8), np.ones(len(column), np.int64))


def _write_float(column, kind):
    dtype, width = WIDTHS[kind.kind]
    found = column.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype)
    return _binary(found.view(np.uint8), np.full(len(column), width))


def _write_enum(column, kind):
    place = pc.index_in(column, value_set=pa.array(kind.symbols, pa.string()))
    return pc.if_else(place.is_null(), pa.scalar(None, pa.binary()), _write_whole(place, kind))


def _write_fixed(column, kind):
    found = column.cast(pa.binary())
    return pc.if_else(pc.equal(pc.binary_length(found), kind.size), found, pa.scalar(None, pa.binary()))


def _write_record(column, kind):
    parts = dict(zip([field.name for field in column.type], column.flatten(), strict=True))
    pieces = [write(parts[member.name], member.type) for member in kind.members]
    return _joined(*pieces) if pieces else pa.repeat(pa.scalar(b"", pa.binary()), len(column))


def _write_array(column, kind):
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _blocks(sizes, write(column.flatten(), kind.inner))


def _write_map(column, kind):
    edges = column.offsets.to_numpy()
    keys, values = (part[edges[0] : edges[-1]] for part in (column.keys, column.items))
    entries = _joined(_sized(keys.cast(pa.binary())), write(values, kind.inner))
    return _blocks(np.diff(edges).astype(np.int64), entries)


_WRITERS = {
    "boolean": _write_boolean,
    "int": _write_whole,
    "long": _write_whole,
    "float": _write_float,
    "double": _write_float,
    "bytes": lambda column, kind: _sized(column.cast(pa.binary())),
    "string": lambda column, kind: _sized(column.cast(pa.binary())),
    "fixed": _write_fixed,
    "enum": _write_enum,
    "record": _write_record,
    "array": _write_array,
    "map": _write_map,
}


def encoder(record: AvroType):
    """An Arrow UDF ``struct -> struct<body, error>``.

    The struct has columns of members; those it lacks are written with their default, or as
    null. A value that does not fit fails its row, and the first member with one is named.
    """

    def absent(member: Member, count: int) -> pa.Array:
        value = default_value(member.type, member.default) if member.has_default else None
        return pa.array([value] * count, arrow_type(member.type))

    def encode(rows: pa.Array) -> pa.Array:
        parts = dict(zip([field.name for field in rows.type], rows.flatten(), strict=True))
        pieces = []
        for member in record.members:
            column = parts[member.name] if member.name in parts else absent(member, len(rows))
            pieces.append(write(column, member.type))
        body = _joined(*pieces) if pieces else pa.repeat(pa.scalar(b"", pa.binary()), len(rows))
        error = pa.nulls(len(rows), pa.string())
        for member, piece in reversed(list(zip(record.members, pieces, strict=True))):
            text = pa.scalar(f"field {member.name} is null or does not fit its type")
            error = pc.if_else(piece.is_null(), text, error)
        return pa.StructArray.from_arrays([body, error], ["body", "error"])

    return F.arrow_udf(encode, returnType="struct<body: binary, error: string>").asNondeterministic()
