"""Best-fit packing of tokenized documents, with certified bounds.

Documents are cut into pieces of at most the length of a sequence. Partitions of pieces are
packed by best-fit decreasing, and dual-feasible functions bound how few sequences could
do, of each partition and of the whole. What a partition uses above its share of the whole's
bound is its gap: it opens as many of its emptiest sequences as the gap asks for, however many;
a partition without a gap opens the emptiest one only. The pieces of open sequences are
exchanged, in as many tasks as they fill, and packed again, until the whole meets its bound, or
one task has packed all that was open.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, documents, give_back, rows_of, ship_code, stored

LENGTH = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
# A row per piece is some 50 bytes: a task holds some 13 MB of them, and up to so many times that
# when open pieces of partitions are put together.
PIECES_PER_PART, MERGED = 2**18, 4
# So many sequences are opened for each one that a partition uses above its bound.
OPENED_PER_GAP = 32
TEXT_AT_ONCE = 8 * 2**20
WORDS_KEPT, WORDS_AT_ONCE = 2**20, 2**15


class WordIds:
    """Token ids of texts, by way of their distinct words.

    The vocabulary's tokens never reach over white space, which it drops, so a text's ids
    are those of its words one after the other. Words seen before are kept, a million at
    most; then they are learnt anew.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Spark's tasks share the cores out already; threads of each task only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum()))
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of distinct words are; new words are learnt."""
        if len(self.words) > WORDS_KEPT:
            self.forget()
        names = words.to_numpy(zero_copy_only=False)
        places = np.fromiter(map(self.words.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(places < 0)
        places[new] = len(self.words) + np.arange(len(new))
        for start in range(0, len(new), WORDS_AT_ONCE):
            self._learn(names[new[start : start + WORDS_AT_ONCE]].tolist())
        return places

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text ended by ``END``, and where each text starts."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = lists.flatten()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        distinct = words.dictionary_encode()
        del lists, words
        places = self._places(distinct.dictionary)
        codes = distinct.indices.to_numpy(zero_copy_only=False)
        lengths = np.diff(self.starts)[places].astype(np.int32)[codes]
        lengths[empty] = 0
        word_ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        text_words = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        starts = word_ends[text_words] + np.arange(len(text_words))
        # Each id stands as far from its word's first place here as in the list of known words.
        flat = np.repeat(self.starts[places][codes] - word_ends[:-1], lengths)
        flat += np.arange(word_ends[-1])
        out = np.insert(self.ids[flat], word_ends[text_words[1:]], np.uint32(END))
        return out, starts


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The vocabulary at a path, read once per worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _slices(batch: pa.RecordBatch, text: str, most: int = TEXT_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text; one row at least."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield rows_of(batch, start, stop - start)
        start = stop
    give_back()


def pieces(
    docs: DataFrame,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document's ids are those of its words and ``END``; a null text counts as empty, so it
    has one id. Ids are cut every ``length``; ``start`` counts the ids before. ``with_ids``
    adds the ids themselves.
    """
    ship_code(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "_text"):
                ids, starts = word_ids(vocabulary)(batch.column("_text"))
                sizes = np.diff(starts)
                number = -(-sizes // length)
                row = np.repeat(np.arange(len(sizes)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * length
                size = np.minimum(sizes[row] - start, length)
                begin = starts[row] + start
                data = ids.astype("<u4", copy=False)
                sums = [zlib.crc32(data[a : a + n]) for a, n in zip(begin, size, strict=True)]
                columns = [batch.column("_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(sums, pa.int64())]
                names = ["_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    offsets = np.concatenate([begin, begin[-1:] + size[-1:]])
                    columns.append(pa.LargeListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(cut, schema).withColumnRenamed("_id", key)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, by best-fit decreasing; ties go to the item that comes first.

    Open bins stand by the room that they have left. The bits of one number say which rooms
    there are, and its lowest bit at or above a length is the best fit.
    """
    bins = np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, number, count = capacity, count, count + 1
        bins[item] = number
        left = room - size
        with_room[left].append(number)
        rooms |= 1 << left
    return bins


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """At least so many bins are needed, by dual-feasible functions; ``counts`` is by length.

    f_a takes lengths above capacity - a as a whole bin, those under a as nothing, and the
    rest as they are; u_k rounds (k + 1) * length / capacity down, unless it is whole, and
    divides by k. Each function's sum bounds the number of bins.
    """
    size = np.arange(capacity + 1)
    number = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    length = np.concatenate([np.cumsum((counts * size)[::-1])[::-1], [0]])
    a = np.arange(capacity // 2 + 1)
    whole = number[capacity - a + 1]
    best = float((whole + (length[a] - length[capacity - a + 1]) / capacity).max())
    for k in range(1, 33):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        best = max(best, float((counts * np.where(exact, size / capacity, scaled // capacity / k)).sum()))
    return best


ROUND = "_round int, _part long, _bin long, offset long, _open boolean, _bound double"


def _packer(capacity: int, number: int, names: list[str], share: float):
    """Packs the pieces of one partition, tells its bound, and opens its emptiest sequences.

    A packing that meets the bound cannot be bettered within the partition, only by exchange;
    ``share`` is what the whole's bound allows for each token.
    """

    def pack(rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_numpy()
        bins = best_fit(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        if number:  # what the pieces had before, if that was better
            _, before = np.unique(np.stack([rows["_part"].to_numpy(), rows["_bin"].to_numpy()]), axis=1, return_inverse=True)
            before = before.ravel()
            if before.max() < bins.max():
                bins = before
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - lengths[order] - np.concatenate([[0], np.cumsum(filled)])[bins[order]]
        is_open = np.zeros(len(filled), bool)
        gap = len(filled) - int(share * int(lengths.sum()))
        emptiest = np.argsort(filled, kind="stable")[: max(1, OPENED_PER_GAP * gap)]
        is_open[emptiest[filled[emptiest] < capacity]] = True
        part = rows["_to"][0].as_py()
        made = {
            "_round": pa.array(np.full(len(bins), number), pa.int32()),
            "_part": pa.array(np.full(len(bins), part), pa.int64()),
            "_bin": pa.array(bins),
            "offset": pa.array(offset),
            "_open": pa.array(is_open[bins]),
            "_bound": pa.array(np.full(len(bins), bound)),
        }
        return pa.table([*(rows[n] for n in names), *made.values()], names=[*names, *made])

    return pack


def packed(cut: DataFrame, capacity: int = LENGTH, per_part: int = PIECES_PER_PART) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces, which need a column ``length`` of 1 to ``capacity``.

    Offsets are gapless from 0 within each sequence. Other columns stay, but those named
    ``sequence_id`` and ``offset``. Pieces that are alike count each; an empty table gives
    an empty result. A task holds about ``per_part`` pieces, and ``MERGED`` times as many in
    an exchange at most. The rounds end when the whole meets its bound, when one task has packed all that was still open, or when a round over
    as many tasks as the one before saved nothing; :func:`certificate` tells how far the
    whole is from its bound.
    """
    ship_code(cut.sparkSession)
    given = [name for name in cut.columns if name not in ("sequence_id", "offset")]
    # Under names of its own, so that no column of the pieces clashes with those in here.
    names = [f"c{number}" for number in range(len(given))]
    names[given.index("length")] = "length"
    table = stored(cut.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(given, names, strict=True)]), "packing-pieces")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    counted = table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in counted:
        counts[row["length"]] = row["n"]
    bound = int(np.ceil(lower_bound(counts, capacity) - 1e-6))
    share = bound / max(int((counts * np.arange(capacity + 1)).sum()), 1)
    parts = buckets_for(int(counts.sum()), per_part)
    hashed = F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in names], F.monotonically_increasing_id()), F.lit(parts))
    pool, done, number = table.withColumns({"_part": F.lit(0).cast("long"), "_bin": F.lit(0).cast("long"), "_to": hashed}), [], 0
    used = None
    while True:
        made = pool.groupBy("_to").applyInArrow(_packer(capacity, number, names, share), f"{kinds}, {ROUND}")
        made = stored(made, f"packing-round-{number}")
        sequences = lambda rows: rows.select("_part", "_bin").distinct().count()
        done.append(made.filter(~F.col("_open")))
        left = made.filter("_open")
        before, used = used, sum(sequences(rows) for rows in done) + sequences(left)
        now = min(parts, max(-(-parts // MERGED), buckets_for(left.count(), MERGED * per_part)))
        if parts <= 1 or used <= bound or (before is not None and now == parts and used >= before):
            done.append(left)
            break
        parts = now
        number += 1
        # Whole sequences are dealt anew, so that none has to end worse than it was.
        dealt = F.pmod(F.xxhash64("_part", "_bin", F.lit(number)), F.lit(parts))
        pool = left.select(*names, "_part", "_bin", dealt.alias("_to"))
    whole = done[0]
    for rows in done[1:]:
        whole = whole.unionByName(rows)
    # Parts are numbered below 2**31 and their sequences below 2**24.
    sequence = F.shiftleft(F.col("_round").cast("long"), 56).bitwiseOR(F.shiftleft("_part", 24)).bitwiseOR(F.col("_bin"))
    columns = [F.col(f"`{b}`").alias(a) for a, b in zip(given, names, strict=True)]
    return whole.select(*columns, sequence.alias("sequence_id"), "offset")


def certificate(sequences: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """One row: how many ``sequences`` were used and the ``bound`` that no packing can beat."""
    counted = sequences.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in counted:
        counts[row["length"]] = row["n"]
    bound = int(np.ceil(lower_bound(counts, capacity) - 1e-6))
    return sequences.agg(F.count_distinct("sequence_id").alias("sequences"), F.lit(bound).cast("long").alias("bound"))


def default_vocabulary() -> str:
    """The path of the vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 tokens, a row per piece."""
    return packed(pieces(documents(spark, sf_dir), default_vocabulary()))
