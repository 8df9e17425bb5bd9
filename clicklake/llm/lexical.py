"""Ranked lexical search by pipelined term partitioning.

One pass over the texts makes an index: blocks of documents, and in each block a posting list
per asked term. The terms belong to owners, rare terms to the first and common ones to the
last. Bundles of items then pass from owner to owner, a Spark cogroup each: a bundle meets one
block's lists of that owner, adds integer contributions to its sparse accumulators of document
scores, and moves on. After the last owner each bundle gives its best documents.

An accumulator is dropped on the way only if the best the owners still to come can add leaves
it below the count-th best of its block, so the ranking is exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, documents, give_back, rows_of, ship_code, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 10
# Owner 0 has the terms of at least the first weight, and so on; a term weighs 3000 if a
# twentieth of the documents hold it, 1500 if 22 % do, 700 if half do.
OWNER_WEIGHTS = (3000, 1500, 700)
# A block holds at most so many documents, a bundle about so many items: a task's dense
# accumulators take at most some 20 MB.
BLOCK_DOCUMENTS = 8192
BUNDLE_ITEMS = 256
# Texts in work at a time.
TEXT_BYTES = 8 << 20
# The filter of asked terms has a fixed size, whatever is asked: 512 KB.
FILTER_BITS = 1 << 22
# A posting adds less than this times its term's weight.
MOST = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "block long, term string, held int, docs binary, counts binary, ids binary, known binary, lengths binary"
BUNDLE = "block long, bundle long, ids binary, known binary, lengths binary, places binary, scores binary"
FOUND = "bundle long, place int, doc_id long, score long"


def _letters() -> np.ndarray:
    """Bytes as terms have them, and blanks for all others; bytes of other letters stay."""
    table = np.full(256, 0x20, np.uint8)
    for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = np.arange(first, last + 1)
    table[0x41:0x5B] += 0x20
    return table


def terms_of(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of each term of binary texts without nulls, and the distinct terms."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = b"".join(texts.to_pylist())
    clean = table[np.frombuffer(data, np.uint8)]
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(clean)])
    lists = pc.ascii_split_whitespace(plain)
    coded = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.cast(pa.large_binary())
    worded = pc.greater(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)
    there = worded[codes] if len(codes) else np.zeros(0, bool)
    return rows[there], codes[there], distinct


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, in runs of about ``TEXT_BYTES`` of text; a longer text is a run of its own."""
    sizes = pc.binary_length(batch.column("_text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(sizes) - sizes) // TEXT_BYTES
    starts = np.flatnonzero(np.diff(run, prepend=-1)) if len(run) else []
    for start, end in zip(starts, [*starts[1:], len(run)], strict=True):
        yield rows_of(batch, int(start), int(end - start))


def _indexed(filter_words: np.ndarray):
    """Posting lists of the asked terms, block by block, and a row per block with its documents."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task = _letters(), TaskContext.get().partitionId()
        postings, ids, known, lengths, blocks = [], [], [], [], 0

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal blocks
            if not lengths:
                return
            block = (task << 32) + blocks
            blocks += 1
            columns = {"term": [None], "held": [0], "docs": [None], "counts": [None]}
            columns |= {
                "ids": [np.concatenate(ids).tobytes()],
                "known": [np.concatenate(known).tobytes()],
                "lengths": [np.concatenate(lengths).tobytes()],
            }
            if postings:
                terms = pa.concat_arrays([p[0] for p in postings]).dictionary_encode()
                codes = terms.indices.to_numpy(zero_copy_only=False)
                docs, counts = (np.concatenate([p[n] for p in postings]) for n in (1, 2))
                order = np.lexsort((docs, codes))
                docs, counts = docs[order].astype(np.uint16), counts[order].astype(np.uint32)
                ends = np.cumsum(np.bincount(codes, minlength=len(terms.dictionary)))
                for code, end in enumerate(ends):
                    start = ends[code - 1] if code else 0
                    columns["term"].append(terms.dictionary[code].as_py())
                    columns["held"].append(int(end - start))
                    columns["docs"].append(docs[start:end].tobytes())
                    columns["counts"].append(counts[start:end].tobytes())
                for name in ("ids", "known", "lengths"):
                    columns[name] += [None] * len(ends)
            for part in (postings, ids, known, lengths):
                part.clear()
            kinds = {"held": pa.int32()}
            made = [pa.array([block] * len(columns["held"]), pa.int64()), pa.array(columns["term"], pa.binary()).cast(pa.string())]
            made += [pa.array(columns[name], kinds.get(name, pa.binary())) for name in list(columns)[1:]]
            yield pa.RecordBatch.from_arrays(made, ["block", *columns])

        for batch in batches:
            for part in _pieces(batch):
                for start in range(0, part.num_rows, BLOCK_DOCUMENTS):
                    some = rows_of(part, start, BLOCK_DOCUMENTS)
                    if sum(map(len, lengths)) + some.num_rows > BLOCK_DOCUMENTS:
                        yield from told()
                    first = sum(map(len, lengths))
                    rows, codes, distinct = terms_of(some.column("_text").cast(pa.large_binary()).fill_null(b""), table)
                    bits = np.array([zlib.crc32(t) % FILTER_BITS for t in distinct.to_pylist()], np.int64)
                    asked = (filter_words[bits >> 5] >> (bits & 31).astype(np.uint32)) & 1 == 1
                    wanted = asked[codes] if len(codes) else np.zeros(0, bool)
                    pairs, counts = np.unique(rows[wanted] * len(distinct) + codes[wanted], return_counts=True)
                    if len(pairs):
                        postings.append((distinct.take(pa.array(pairs % len(distinct))), first + pairs // len(distinct), counts))
                    number = some.column("_id")
                    ids.append(number.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                    known.append(number.is_valid().to_numpy(zero_copy_only=False))
                    lengths.append(np.bincount(rows, minlength=some.num_rows).astype(np.int64))
            give_back()
        yield from told()

    return index


def _filter_words(terms: DataFrame) -> np.ndarray:
    """One bit per checksum of an asked term: at most ``FILTER_BITS`` / 32 rows come to the driver."""
    bit = F.crc32(F.col("term").cast("binary")) % FILTER_BITS
    one = F.expr("shiftleft(1L, CAST(_bit % 32 AS INT))")
    words = terms.select(bit.alias("_bit")).groupBy(F.floor(F.col("_bit") / 32).alias("word")).agg(F.bit_or(one).alias("bits"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for row in words.collect():
        out[row["word"]] = row["bits"]
    return out


def _owner(weight: Column) -> Column:
    owner = F.lit(len(OWNER_WEIGHTS))
    for number, least in reversed(list(enumerate(OWNER_WEIGHTS))):
        owner = F.when(weight >= least, number).otherwise(owner)
    return owner


def _scores(left: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places (item times documents of the block, plus document) and scores of a bundle so far."""
    held = [left[name][0].as_py() or b"" for name in ("places", "scores")]
    return np.frombuffer(held[0], np.int32), np.frombuffer(held[1], np.int64)


def _visit(totals: tuple[int, int], best: int, last: bool):
    """What one owner does with the bundle of a block."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {"bundle": [], "place": [], "doc_id": [], "score": []}
        bundles = []
        if left.num_rows:
            lengths = np.frombuffer(left["lengths"][0].as_py(), np.int64)
            places, scores = _scores(left)
            rest = dict.fromkeys(np.unique(places // len(lengths)).tolist())
            items = right["items"].to_pylist()
            for asks in items:
                for ask in asks:
                    rest[ask["place"]] = ask["rest"]
            # A row per item that has a score or a list here.
            row_of = {place: row for row, place in enumerate(sorted(rest))}
            sums = np.zeros((len(row_of), len(lengths)), np.int64)
            rows = np.array(sorted(rest), np.int64)
            sums[np.searchsorted(rows, places // len(lengths)), places % len(lengths)] = scores
            documents_, words = totals
            norm = np.array([10 + (90 * n * documents_) // words for n in lengths.tolist()], np.int64)
            for asks, weight, docs, counts in zip(items, *(right[c].to_pylist() for c in ("weight", "docs", "counts")), strict=True):
                docs = np.frombuffer(docs, np.uint16)
                counts = np.frombuffer(counts, np.uint32).astype(np.int64)
                added = weight * ((1_000_000_000 * counts) // (1000 * counts + 8 * norm[docs]))
                for ask in asks:
                    sums[row_of[ask["place"]], docs] += added
            ids = np.frombuffer(left["ids"][0].as_py(), np.int64)
            known = np.frombuffer(left["known"][0].as_py(), bool)
            kept_places, kept_scores = [], []
            for place, row in row_of.items():
                there = np.flatnonzero(sums[row])
                score = sums[row][there]
                if last:
                    order = np.lexsort((ids[there], ~known[there], -score))[:best]
                    found["bundle"] += [left["bundle"][0].as_py()] * len(order)
                    found["place"] += [place] * len(order)
                    found["doc_id"] += [i if k else None for i, k in zip(ids[there][order].tolist(), known[there][order].tolist())]
                    found["score"] += score[order].tolist()
                    continue
                if rest[place] is not None and len(score) > best:
                    least = np.partition(score, len(score) - best)[len(score) - best]
                    kept = score + rest[place] * MOST >= least
                    there, score = there[kept], score[kept]
                kept_places.append(place * len(lengths) + there)
                kept_scores.append(score)
            if not last:
                places = np.concatenate(kept_places or [np.zeros(0)]).astype(np.int32).tobytes()
                scores = np.concatenate(kept_scores or [np.zeros(0)]).astype(np.int64).tobytes()
                names = ("block", "bundle", "ids", "known", "lengths")
                bundles.append({name: left[name][0].as_py() for name in names} | {"places": places, "scores": scores})
        if last:
            kinds = {"bundle": pa.int64(), "place": pa.int32(), "doc_id": pa.int64(), "score": pa.int64()}
            return pa.table({name: pa.array(values, kinds[name]) for name, values in found.items()})
        kinds = [("block", pa.int64()), ("bundle", pa.int64())]
        kinds += [(name, pa.binary()) for name in ("ids", "known", "lengths", "places", "scores")]
        return pa.Table.from_pylist(bundles, pa.schema(kinds))

    return add


def ranked(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    best: int = BEST,
) -> DataFrame:
    """The ``best`` documents of highest score for each item: ``item``, ``rank``, ``key``, ``score``.

    Terms, weights and scores are those of the module's contract: integers but for the
    logarithm in a term's weight, so any order of adding gives the same. A null or empty text
    has no terms; it is found by no item and is not counted. Rows that are alike are documents
    of their own; a document without an id is counted and ranked, after others of its score.
    Item rows of one id, null among them, are one item with the terms of all. Items without a
    term that some document holds have no row, and no rows come of empty tables. ``rank`` is
    from 1, the highest score first, equal scores by ascending id. The other columns are not
    read.

    A document's text is read whole, once. A block has at most ``BLOCK_DOCUMENTS`` documents,
    whatever their terms or ids, so no hot id, source or term makes a large task.
    """
    spark = docs.sparkSession
    ship_code(spark)
    lowered = F.translate(F.col(f"`{item_text}`"), UPPER, LOWER)
    asking = items.select(F.col(f"`{item}`").alias("item"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    asking = stored(asking.distinct(), "lexical-asks")
    read = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("binary").alias("_text"))
    index = stored(read.mapInArrow(_indexed(_filter_words(asking)), INDEX), "lexical-index")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column("lengths").to_pylist():
                lengths = np.frombuffer(held, np.int64)
                counted = [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
                yield pa.RecordBatch.from_arrays(counted, ["documents", "words"])

    blocks = index.filter("term IS NULL")
    counted = blocks.select("lengths").mapInArrow(sums, "documents long, words long")
    totals = tuple(counted.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first())

    held = index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("held").alias("_df"))
    share = F.lit(2.0 * totals[0] + 2.0) / (F.lit(2.0) * F.col("_df") + 1.0)
    weighed = held.select("term", F.floor(F.lit(1000.0) * F.log(share)).cast("long").alias("weight")).filter("weight > 0")
    weighed = asking.join(weighed, "term").withColumn("owner", _owner(F.col("weight")))

    # Items get a bundle and a place in it; what owners still to come can add is told with each term.
    numbers = asking.select("item").distinct()
    bundles = buckets_for(numbers.count(), BUNDLE_ITEMS)
    in_bundle = Window.partitionBy("bundle").orderBy(F.col("item").asc_nulls_last())
    numbers = numbers.withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("long"))
    numbers = stored(numbers.withColumn("place", (F.row_number().over(in_bundle) - 1).cast("int")), "lexical-items")
    later = Window.partitionBy("bundle", "place").orderBy(F.desc("owner")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("bundle", "place", "owner")
    placed = weighed.join(numbers, weighed["item"].eqNullSafe(numbers["item"])).drop("item")
    placed = placed.withColumn("rest", F.sum("weight").over(later) - F.sum("weight").over(same))
    asks = placed.groupBy("term", "weight", "owner", "bundle").agg(F.collect_list(F.struct("place", "rest")).alias("items"))
    asks = stored(asks, "lexical-terms")

    nothing = F.lit(None).cast("binary")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles - 1).cast("long")))
    moving = blocks.select("block", every.alias("bundle"), "ids", "known", "lengths", nothing.alias("places"), nothing.alias("scores"))
    lists = index.filter("term IS NOT NULL").select(F.col("block").alias("_block"), "term", "docs", "counts")
    owners = len(OWNER_WEIGHTS) + 1
    for owner in range(owners):
        last = owner == owners - 1
        owned = lists.join(asks.filter(F.col("owner") == owner), "term").select("_block", "bundle", "weight", "docs", "counts", "items")
        together = moving.groupBy("block", "bundle").cogroup(owned.groupBy("_block", "bundle"))
        moving = together.applyInArrow(_visit(totals, best, last), FOUND if last else BUNDLE)

    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy("bundle", "place").orderBy(*order))
    top = moving.withColumn("rank", rank).filter(F.col("rank") <= best).join(numbers, ["bundle", "place"])
    return top.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(key), "score")


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for every item of ``benchmark``."""
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH read AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
lengths AS (SELECT row, doc_id, len(terms)::BIGINT AS n FROM read WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM lengths),
postings AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM read) GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), totals),
scored AS (
  SELECT item_id, doc_id, row,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // words)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (row), totals
  GROUP BY item_id, doc_id, row)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0)
WHERE rank <= 10
"""
