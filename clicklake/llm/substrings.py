"""Removal of byte strings that an earlier document has, by a difference-cover sample and sorted names.

Of all suffixes, those at the places of a difference cover (modulo ``period``) are sampled:
any two equal strings of ``length`` bytes have a sampled place at the same distance from
their starts. The tuples of bytes at sampled places are sorted and named; a name that one
place alone has settles that suffix, as nothing can equal it. The sort then goes on, one
level deeper, for suffixes that a shared name leaves open: they and the others merged with
them (those with such a place in reach) are named by all ``length`` bytes, which is as far as
the order matters. Equal prefixes stand next to each other, and the first document of each
run keeps it.

This is not a whole suffix array: names are 64-bit hashes, not ranks, so equal strings are
adjacent but others in no lexicographic order, and one level by all bytes takes the place
of a recursion on names.

Documents are put together in chunks, similar ones in the same; within a chunk the sort
is numpy's. Names that chunks share are found in ranges of the sorted names: a chunk sends
each name once per range, so that a string which a third of all documents has comes to
its range once per chunk.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ship_code, stored

LENGTH = 50
PERIODS = (31, 21, 13, 7, 3)
LEAST_TUPLE = 16
# Bytes of text that a chunk has, and half of it from which one key is spread over chunks.
CHUNK = 6 * 2**20
CHUNKS_PER_RANGE = 2
# Names of sampled tuples have so many bits more than it takes to count them.
SPARE_BITS = 12
KEY_BYTES = 16
# Keys that all tasks are told how far to spread: some MB at any size of the table.
MOST_HEAVY = 100_000


@functools.cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The smallest set, first in order, whose differences are all numbers modulo ``period``."""
    for size in itertools.count():
        for rest in itertools.combinations(range(1, period), size):
            places = (0, *rest)
            if len({(a - b) % period for a in places for b in places}) == period:
                return places


def period_for(length: int) -> int:
    """The longest period that leaves tuples of ``LEAST_TUPLE`` bytes, or of one byte at least."""
    return next((p for p in PERIODS if length - p + 1 >= LEAST_TUPLE), 1)


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@functools.cache
def _byte_values() -> np.ndarray:
    return _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def names_of(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit name of the ``length`` bytes at every place that has so many after it.

    Strings of twice the length are made of two, and those of any length of its powers of two.
    """
    doubled, power, span = _byte_values()[data], np.uint64(0xD6E8FEB86659FD93), 1
    found, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if length & span:
                if found is None:
                    found = doubled
                else:
                    count = max(len(doubled) - done, 0)
                    found = found[:count] * power + doubled[done : done + count]
                done += span
            if done == length:
                return _mixed(found)
            doubled = doubled[: max(len(doubled) - span, 0)] * power + doubled[span:]
            power, span = power * power, span * 2


def names_at(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit name of the ``length`` bytes at each of these places.

    Only they are read, eight bytes at a time; the last eight end with the string.
    """
    if length < 8 or len(data) < length:
        return names_of(data, length)[places]
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    found = np.zeros(len(places), np.uint64)
    with np.errstate(over="ignore"):
        for step in [*range(0, length - 8, 8), length - 8]:
            found = _mixed(found * np.uint64(0xD6E8FEB86659FD93) + words[places + step])
    return found


def distinct_of(names: np.ndarray) -> np.ndarray:
    """Distinct names in order; sorting is faster here than the hash table of ``np.unique``."""
    names = np.sort(names)
    return names[np.concatenate([[True], names[1:] != names[:-1]])] if len(names) else names


def packed_names(names: np.ndarray) -> bytes:
    """Sorted names as compressed differences, byte by byte of all."""
    steps = np.diff(names, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked_names(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def range_ends(names: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each range of names of so many bits starts and ends among the sorted names."""
    edges = np.array([(n << bits) // ranges for n in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])


def _steps(starts: np.ndarray, counts: np.ndarray, step: int) -> np.ndarray:
    """So many places from each start, ``step`` apart."""
    counts = counts.astype(np.int64)
    return np.repeat(starts - step * (np.cumsum(counts) - counts), counts) + step * np.arange(counts.sum())


class Chunk:
    """The texts of a chunk, end to end, in the order of their documents."""

    def __init__(self, rows: pa.Table):
        ids = rows["_id"].to_pylist()
        # A document without an id stands after all others.
        self.order = sorted(range(len(ids)), key=lambda n: (ids[n] is None, 0 if ids[n] is None else ids[n]))
        self.ids = [ids[n] for n in self.order]
        bodies = rows["_body"].combine_chunks().take(pa.array(self.order, pa.int64())).to_pylist()
        self.sizes = np.array([len(b) for b in bodies], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(bodies), np.uint8)
        del bodies
        # Documents of one id do not come before each other.
        same = np.array([n > 0 and self.ids[n] == self.ids[n - 1] for n in range(len(ids))], bool)
        self.rank = np.cumsum(~same) - 1

    def starts_of(self, length: int) -> np.ndarray:
        """Which places have ``length`` bytes of their document after them."""
        found = np.ones(len(self.data), bool)
        last = np.minimum(self.sizes, length - 1)
        found[_steps(self.ends - last, last, 1)] = False
        return found

    def sampled(self, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places, by their place in their document, and the names of their tuples."""
        period = period_for(length)
        tuple_length = length - period + 1
        room = self.sizes - tuple_length
        some = [_steps(self.starts + c, np.maximum((room - c) // period + 1, 0), period) for c in difference_cover(period)]
        places = np.sort(np.concatenate(some))
        return places, names_at(self.data, places, tuple_length) >> np.uint64(64 - bits)

    def reached(self, places: np.ndarray, length: int) -> np.ndarray:
        """The starts of strings of ``length`` bytes that hold the tuple of one of these places."""
        reach = length - (length - period_for(length) + 1) + 1
        change = np.zeros(len(self.data) + reach + 1, np.int32)
        change[places + 1] -= 1  # places differ
        np.add.at(change, np.maximum(places - reach + 1, 0), 1)
        return np.flatnonzero((np.cumsum(change[: len(self.data)], dtype=np.int32) > 0) & self.starts_of(length))

    def sorted_names(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """These places and their names, in the order of names; where runs start, and the first place of each."""
        names = names_at(self.data, places, length)
        order = np.argsort(names)
        names, places = names[order], places[order]
        first = np.ones(len(names), bool)
        first[1:] = names[1:] != names[:-1]
        starts = np.flatnonzero(first)
        return places, names, starts, np.minimum.reduceat(places, starts) if len(starts) else places

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")


def _shared(names: np.ndarray, flags: dict, bits: int, ranges: int) -> np.ndarray:
    """Which of the chunk's distinct names the answers of their ranges mark."""
    ends = range_ends(names, bits, ranges)
    marked = np.zeros(len(names), bool)
    for number, blob in flags.items():
        a, b = ends[number], ends[number + 1]
        marked[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a).astype(bool)
    return marked


SENT = "_range int, _chunk long, _names binary, _documents binary, _ids binary"
ANSWER = "_chunk long, _level int, _range int, _marks binary"
EMPTY = pa.binary()


def _send(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.int32(), pa.int64(), EMPTY, EMPTY, EMPTY]
    names = [part.split()[0] for part in SENT.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _answer(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = [pa.int64(), pa.int32(), pa.int32(), EMPTY]
    names = [part.split()[0] for part in ANSWER.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class Search:
    """The steps of the search, each a function of the rows of one chunk or of one range."""

    def __init__(self, length: int, bits: int, ranges: int):
        self.length, self.bits, self.ranges = length, bits, ranges

    def _ids(self, ids: list) -> bytes:
        values = np.array([2**63 - 1 if i is None else i for i in ids], np.int64)
        return zstandard.ZstdCompressor(level=1).compress(np.diff(values, prepend=0).tobytes())

    def tuples(self, rows: pa.Table) -> pa.Table:
        """Sends the sorted distinct names of a chunk's sampled tuples to their ranges."""
        chunk = Chunk(rows)
        names = distinct_of(chunk.sampled(self.length, self.bits)[1])
        ends, out = range_ends(names, self.bits, self.ranges), []
        for number, (a, b) in enumerate(itertools.pairwise(ends)):
            if b > a:
                out.append((number, rows["_chunk"][0].as_py(), packed_names(names[a:b]), None, None))
        return _send(out)

    def shared_tuples(self, rows: pa.Table) -> pa.Table:
        """Marks, for each chunk, the names of a range that another chunk has too."""
        lists = [unpacked_names(b) for b in rows["_names"].to_pylist()]
        whole = np.sort(np.concatenate(lists))
        twice = distinct_of(whole[1:][whole[1:] == whole[:-1]])
        out = []
        for chunk, names in zip(rows["_chunk"].to_pylist(), lists, strict=True):
            place = np.minimum(np.searchsorted(twice, names), max(len(twice) - 1, 0))
            marks = twice[place] == names if len(twice) else np.zeros(len(names), bool)
            if marks.any():
                out.append((chunk, 1, rows["_range"][0].as_py(), np.packbits(marks).tobytes()))
        return _answer(out)

    def _open(self, chunk: Chunk, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, dict]:
        """Sampled places with names that other chunks have, or that the chunk has twice."""
        flags: dict = {1: {}, 2: {}}
        for level, number, blob in zip(*(answers[c].to_pylist() for c in ("_level", "_range", "_marks")), strict=True):
            flags[level][number] = blob
        places, names = chunk.sampled(self.length, self.bits)
        distinct, place, count = np.unique(names, return_inverse=True, return_counts=True)
        outside = _shared(distinct, flags[1], self.bits, self.ranges)[place]
        return places[outside], places[(count > 1)[place]], flags

    def strings(self, rows: pa.Table, answers: pa.Table) -> pa.Table:
        """Sends the names of the open strings to their ranges, with the first document of each."""
        if not len(rows):
            return _send([])
        chunk = Chunk(rows)
        outside, _, _ = self._open(chunk, answers)
        _, names, first, earliest = chunk.sorted_names(chunk.reached(outside, self.length), self.length)
        documents_, names = chunk.document_of(earliest), names[first]
        ends, out = range_ends(names, 64, self.ranges), []
        for number, (a, b) in enumerate(itertools.pairwise(ends)):
            if b > a:
                own, of = np.unique(documents_[a:b], return_inverse=True)
                kind = np.uint16 if len(own) < 2**16 else np.uint32
                ids = self._ids([chunk.ids[n] for n in own])
                out.append((number, rows["_chunk"][0].as_py(), packed_names(names[a:b]), of.astype(kind).tobytes(), ids))
        return _send(out)

    def first_strings(self, rows: pa.Table) -> pa.Table:
        """Marks, for each chunk, the names of a range that a document of a smaller id has elsewhere."""
        lists = [unpacked_names(b) for b in rows["_names"].to_pylist()]
        firsts = []
        for names, ids, of in zip(lists, rows["_ids"].to_pylist(), rows["_documents"].to_pylist(), strict=True):
            values = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.int64))
            firsts.append(values[np.frombuffer(of, np.uint16 if len(of) == 2 * len(names) else np.uint32)])
        names, documents_ = np.concatenate(lists), np.concatenate(firsts)
        order = np.lexsort((documents_, names))
        starts = np.ones(len(order), bool)
        starts[1:] = names[order[1:]] != names[order[:-1]]
        least = documents_[order][np.flatnonzero(starts)][np.cumsum(starts) - 1]
        marks = np.empty(len(order), bool)
        marks[order] = least < documents_[order]
        ends, out = np.cumsum([0, *map(len, lists)]), []
        for chunk, (a, b) in zip(rows["_chunk"].to_pylist(), itertools.pairwise(ends), strict=True):
            if marks[a:b].any():
                out.append((chunk, 2, rows["_range"][0].as_py(), np.packbits(marks[a:b]).tobytes()))
        return _answer(out)

    def removed(self, kind: pa.DataType, with_text: bool):
        """What is left of each document of a chunk."""

        def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
            chunk = Chunk(rows)
            outside, inside, flags = self._open(chunk, answers)
            change = np.zeros(len(chunk.data) + self.length + 1, np.int32)
            places, names, first, _ = chunk.sorted_names(chunk.reached(outside, self.length), self.length)
            earlier = _shared(names[first], flags[2], 64, self.ranges)
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(names))))
            np.add.at(change, places[earlier[run]] if len(first) else places, 1)
            np.add.at(change, (places[earlier[run]] if len(first) else places) + self.length, -1)
            places, names, first, earliest = chunk.sorted_names(chunk.reached(inside, self.length), self.length)
            rank = chunk.rank[chunk.document_of(places)] if len(places) else places
            least = chunk.rank[chunk.document_of(earliest)] if len(places) else places
            later = places[rank > np.repeat(least, np.diff(np.append(first, len(names))))] if len(first) else places
            np.add.at(change, later, 1)
            np.add.at(change, later + self.length, -1)
            gone = np.cumsum(change[: len(chunk.data)], dtype=np.int32) > 0
            removed, spans, digests, texts = [], [], [], []
            for a, b in zip(chunk.starts, chunk.ends, strict=True):
                part = gone[a:b]
                removed.append(int(part.sum()))
                spans.append(int(part[:1].sum() + (part[1:] & ~part[:-1]).sum()))
                left = chunk.data[a:b][~part].tobytes()
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left if with_text else None)
            columns = [pa.array(chunk.ids, kind), pa.array(chunk.sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names_ = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.binary()))
                names_.append("kept")
            return pa.table(columns, names=names_)

        return remove


def _placed(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int, int]:
    """Documents in chunks, the number of chunks, and the bytes of all texts.

    A document's key is the smallest name of its strings of ``KEY_BYTES`` bytes, so similar
    documents mostly share one, and its chunk. A key with over half a chunk of text is spread
    over as many chunks as it fills. The ``MOST_HEAVY`` largest of such keys are told to all
    tasks, and those beyond are joined.
    """

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for body in batch.column("_body").to_pylist():
                names = names_of(np.frombuffer(body, np.uint8), KEY_BYTES) if len(body) >= KEY_BYTES else ()
                keys.append(int(names.min().view(np.int64)) if len(names) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_body"), pa.array(keys, pa.int64())], ["_id", "_body", "_key"])

    kind = docs.schema["_id"].dataType.simpleString()
    keyed = docs.mapInArrow(key, f"_id {kind}, _body binary, _key long")
    size = F.octet_length("_body").cast("long")
    total = docs.select(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    chunks = max(1, -(-total // chunk_bytes))
    heavy = keyed.groupBy("_key").agg(F.sum(size).alias("_bytes")).filter(F.col("_bytes") > chunk_bytes // 2)
    heavy = heavy.select(F.col("_key").alias("_heavy"), F.ceil(F.col("_bytes") / chunk_bytes * 2).alias("_parts"))
    heavy = stored(heavy, "substrings-heavy")
    heaviest = heavy.orderBy(F.desc("_parts"), "_heavy").limit(MOST_HEAVY)
    of_key = F.col("_key") == F.col("_heavy")
    told = keyed.join(F.broadcast(heaviest), of_key, "left")
    if heavy.count() > MOST_HEAVY:
        # None of the others has more than that part of all text, so they can be joined by key.
        others = heavy.join(heaviest.select("_heavy"), "_heavy", "left_anti")
        rest = told.filter("_parts IS NULL").drop("_heavy", "_parts").join(others, of_key, "left")
        told = told.filter("_parts IS NOT NULL").unionByName(rest)
    salt = F.pmod(F.xxhash64("_id", "_body"), F.coalesce("_parts", F.lit(1)))
    chunk = F.pmod(F.xxhash64("_key", salt), F.lit(chunks)).cast("long")
    return told.select("_id", "_body", chunk.alias("_chunk")).repartition(chunks, "_chunk"), chunks, total


def without_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    chunk_bytes: int = CHUNK,
    with_text: bool = False,
) -> DataFrame:
    """Each document without the bytes that lie in a string of ``length`` bytes of an earlier one.

    Gives ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` (runs of removed bytes) and
    ``kept_sha256``; ``with_text`` adds ``kept``, the bytes that are left. Texts are UTF-8;
    strings overlap, do not cross documents, and are judged on the input. Earlier means of a
    smaller key, a whole number: rows of one key do not touch each other, and rows without
    a key come after all others. A null text counts as empty. An empty table gives an empty
    result.

    Names of 64 bits stand for strings. A task holds a chunk of ``chunk_bytes`` of text, or
    one document if that is longer.
    """
    ship_code(docs.sparkSession)
    kind = docs.schema[key].dataType
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    read = docs.select(F.col(key).alias("_id"), body.alias("_body"))
    placed, chunks, total = _placed(read, chunk_bytes)
    ranges = max(1, -(-chunks // CHUNKS_PER_RANGE))
    search = Search(length, min(64, max(1, total).bit_length() + SPARE_BITS), ranges)
    by_chunk = placed.groupBy("_chunk")
    tuples = by_chunk.applyInArrow(lambda rows: search.tuples(rows), SENT)
    level_1 = tuples.groupBy("_range").applyInArrow(lambda rows: search.shared_tuples(rows), ANSWER)
    strings = by_chunk.cogroup(level_1.groupBy("_chunk")).applyInArrow(lambda rows, found: search.strings(rows, found), SENT)
    level_2 = strings.groupBy("_range").applyInArrow(lambda rows: search.first_strings(rows), ANSWER)
    answers = level_1.unionByName(level_2)
    schema = f"_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind.simpleString()]
    removed = by_chunk.cogroup(answers.groupBy("_chunk")).applyInArrow(
        search.removed(arrow, with_text), schema + ", kept binary" * with_text
    )
    return removed.withColumnRenamed("_id", key)


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` without the 50-byte strings that earlier ones have."""
    return without_repeats(documents(spark, sf_dir))


OP4_SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, len(h) // 2 AS n FROM texts),
starts AS (SELECT doc_id, unnest(range(n - 49)) AS p, h FROM sized WHERE n >= 50),
strings AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS d FROM strings GROUP BY s),
found AS (SELECT doc_id, p FROM strings JOIN firsts USING (s) WHERE d < doc_id),
steps AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before,
    lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS after FROM found),
runs AS (
  SELECT doc_id, p, CASE WHEN after IS NULL THEN 50 ELSE least(50, after - p) END AS covers,
    CASE WHEN before IS NULL OR p - before > 50 THEN 1 ELSE 0 END AS opens,
    CASE WHEN after IS NULL OR after - p > 50 THEN 1 ELSE 0 END AS closes FROM steps),
begins AS (SELECT doc_id, list(p ORDER BY p) FILTER (opens = 1) AS b, list(p + 50 ORDER BY p) FILTER (closes = 1) AS e,
    sum(covers) AS removed, sum(opens) AS n_spans FROM runs GROUP BY doc_id),
kept AS (
  SELECT sized.doc_id, n, h, coalesce(removed, 0) AS removed, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN b IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(b) + 2), lambda i:
      substr(h, 2 * coalesce(e[i - 1], 0) + 1, 2 * (coalesce(b[i], n) - coalesce(e[i - 1], 0)))), '') END AS k
  FROM sized LEFT JOIN begins ON sized.doc_id = begins.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
  sha256(unhex(k)) AS kept_sha256
FROM kept
"""
