"""Token ids as packed matrices: a row of ids per sequence, with its segments.

Each task packs the documents that it reads, a window of pieces at a time, by best-fit
decreasing; a segment tree over capacities finds the fullest sequence that still has room.
The emptiest sequences of a window are packed again with the next. No ids are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, ship_code
from .packing import TEXT_AT_ONCE, _slices, default_vocabulary, word_ids

LENGTH = 4096
PAD = 0
# A window ends with the batch that brings it to so many ids; so many sequences stay open after it.
WINDOW, CARRIED = 4 * 2**20, 64
SEQUENCES_AT_ONCE = 512


class CapacityTree:
    """How many open sequences have each room, with the sums of all spans of rooms above them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, room: int, number: int) -> None:
        node = self.leaves + room
        while node:
            self.counts[node] += number
            node >>= 1

    def best(self, size: int) -> int | None:
        """The smallest room of at least ``size`` that some sequence has."""
        node = self.leaves + size
        if not self.counts[node]:
            # Up to the first span on the right that is not empty, then down its left edge.
            while node & 1 or not self.counts[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.counts[2 * node])
        return node - self.leaves


def packed_bins(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The items of each sequence, by best-fit decreasing; ties go to the item that comes first."""
    tree, with_room, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        room = tree.best(size)
        if room is None:
            room, number = capacity, len(bins)
            bins.append([])
        else:
            number = with_room[room].pop()
            tree.add(room, -1)
        bins[number].append(item)
        if room > size:
            with_room[room - size].append(number)
            tree.add(room - size, 1)
    return bins


def id_type(vocabulary_size: int) -> np.dtype:
    """The smallest little-endian unsigned type that holds all ids."""
    return np.dtype("<u2" if vocabulary_size <= 2**16 else "<u4")


FIELDS = ("ids", "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts")


def _spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Waiting:
    """Pieces that wait to be packed: all ids in one buffer, and a column of each fact."""

    def __init__(self, length: int, dtype: np.dtype, key_type: pa.DataType):
        self.length, self.ids = length, np.empty(0, dtype)
        self.sizes, self.numbers, self.starts = (np.empty(0, np.int64) for _ in range(3))
        self.keys = pa.array([], key_type)

    def add(self, ids: np.ndarray, bounds: np.ndarray, keys: pa.Array) -> None:
        """The documents of a batch, cut into pieces; none is empty, as each ends with an id."""
        sizes = np.diff(bounds)
        pieces = -(-sizes // self.length)
        row = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = number * self.length
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, np.minimum(sizes[row] - start, self.length)])
        self.numbers = np.concatenate([self.numbers, number])
        self.starts = np.concatenate([self.starts, start])
        self.keys = pa.concat_arrays([self.keys, keys.take(pa.array(row))])

    def taken(self, order: np.ndarray) -> Waiting:
        """These pieces, in this order, as a window of their own."""
        out = Waiting(self.length, self.ids.dtype, self.keys.type)
        begins = np.cumsum(self.sizes) - self.sizes
        out.ids = self.ids[_spans(begins[order], self.sizes[order])]
        out.sizes, out.numbers, out.starts = self.sizes[order], self.numbers[order], self.starts[order]
        out.keys = self.keys.take(pa.array(order))
        return out

    def rows(self, counts: np.ndarray) -> pa.RecordBatch:
        """All pieces as sequences, which have so many of them each."""
        row = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(self.sizes)
        first = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
        within = ends - self.sizes - first[row]
        matrix = np.full(len(counts) * self.length, PAD, self.ids.dtype)
        matrix[_spans(row * self.length + within, self.sizes)] = self.ids
        lists = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        longer = pa.array(np.concatenate([[0], np.cumsum(counts + 1)]), pa.int32())
        segments = np.zeros(len(row) + len(counts), np.int32)
        segments[np.arange(len(row)) + row + 1] = within + self.sizes
        width = np.arange(len(counts) + 1, dtype=np.int32) * (self.length * self.ids.dtype.itemsize)
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(width), pa.py_buffer(matrix)])
        columns = [
            ids,
            pa.ListArray.from_arrays(longer, pa.array(segments)),
            pa.ListArray.from_arrays(lists, pa.array(within.astype(np.int32))),
            pa.ListArray.from_arrays(lists, self.keys),
            pa.ListArray.from_arrays(lists, pa.array(self.numbers.astype(np.int32))),
            pa.ListArray.from_arrays(lists, pa.array(self.starts)),
        ]
        return pa.RecordBatch.from_arrays(columns, list(FIELDS))


def matrices(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Sequences of at most ``length`` ids, a row each.

    ============================  ========================================================
    ``sequence_id`` long          unique, gaps between tasks
    ``n_ids`` int                 ids without padding
    ``ids`` binary                the row of the matrix: ``length`` little-endian unsigned ids
                                  of 2 bytes (4 for large vocabularies), padded with 0
    ``cu_seqlens`` array<int>     0 and the ends of the segments, so the last is ``n_ids``
    ``position_resets``           where positions start again at 0: the start of each segment
    ``doc_ids``, ``pieces``,      of each segment its document, the number of the piece of
    ``starts``                    it, and how many ids of the document come before
    ============================  ========================================================

    A document's ids are those of its words and 1; a null text counts as empty and has the
    one id. Longer documents are cut every ``length`` ids and lose none. Rows that are alike
    and null keys count each; an empty table gives an empty result. A task holds one window
    of ids, or one document if that is longer.
    """
    ship_code(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    types = f"ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, pieces array<int>, starts array<long>"
    read = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    key_type = to_arrow_type(docs.schema[key].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary)
        dtype = id_type(words.tokenizer.get_vocab_size())
        held = Waiting(length, dtype, key_type)

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            bins = packed_bins(held.sizes, length)
            sizes = held.sizes.tolist()
            bins.sort(key=lambda items: sum(sizes[i] for i in items))
            carried = 0 if last else CARRIED
            for start in range(carried, len(bins), SEQUENCES_AT_ONCE):
                some = [sorted(items) for items in bins[start : start + SEQUENCES_AT_ONCE]]
                order = np.array([i for items in some for i in items], np.int64)
                yield held.taken(order).rows(np.array([len(items) for items in some], np.int64))
            held = held.taken(np.array(sorted(i for items in bins[:carried] for i in items), np.int64))

        for whole in batches:
            for batch in _slices(whole, "_text", TEXT_AT_ONCE):
                ids, bounds = words(batch.column("_text"))
                held.add(ids.astype(dtype), bounds, batch.column("_id").cast(key_type))
                if len(held.ids) >= WINDOW:
                    yield from emit(False)
        if len(held.sizes):
            yield from emit(True)

    rows = read.mapInArrow(pack, types)
    return rows.select(
        F.monotonically_increasing_id().alias("sequence_id"), F.element_at("cu_seqlens", -1).alias("n_ids"), *FIELDS
    )


def write_matrices(docs: DataFrame, vocabulary: str, path: str, **options) -> None:
    """Write :func:`matrices` as a Parquet table; a part is a matrix, a column each of its facts."""
    matrices(docs, vocabulary, **options).write.parquet(path)


def matrix(rows: list, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Some rows as one matrix of ids and one of positions, which restart at each segment."""
    ids, positions = [], []
    for row in rows:
        ids.append(np.frombuffer(row["ids"], np.dtype(f"<u{len(row['ids']) // length}")))
        resets = np.zeros(length, np.int64)
        starts = np.array([*row["position_resets"], row["n_ids"]])
        starts = starts[starts < length]
        resets[starts] = np.diff(starts, prepend=0)
        positions.append(np.arange(length) - np.cumsum(resets))
    return np.stack(ids), np.stack(positions)


def op7_tokens(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` as packed matrices of 4096 ids a row."""
    return matrices(documents(spark, sf_dir), default_vocabulary())
