"""An exact join of documents by the Jaccard similarity of their word shingles.

Documents with the same shingles are one class, compared once. Classes are partitioned into
groups of similar ones by a min-hash. The matrix of tokens and groups holds each group's union
of tokens, as far as it bounds anything: of every class the rarest tokens, so many that two
similar classes share ``SHARED`` percent of the smaller one's number of tokens among them.
A join of the matrix with itself counts what groups share there, and only groups that share
enough, and have members of fitting sizes, are opened to each other: only then are texts
fetched and sets of tokens moved, the classes of the smaller group as queries to the larger.
A block of the larger is asked by way of its whole union, once more a bound. Groups whose
pivots join them to one component first need no further comparison.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, give_back, rows_of, ship_code, stored
from .components import components

WIDTH = 5
PERCENT = 75
ROWS_AT_ONCE = 2048
# Cells that count tokens: what they say orders tokens, and goes to every task (8 MB).
CELLS, SLICES = 2**21, 16
MEMBERS, QUERIES = 512, 2048
# Two groups are opened to each other if they share so many percent of a set's tokens, and so
# many at least, in the matrix. More percent are more rows there, and fewer sets that move.
SHARED, LEAST_SHARED = 8, 3
# What leaves out texts that no group asks for, before they are shuffled: 2 MB at any size.
FILTER_BITS = 2**24

_ONE, _TWO, _PRIME = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed_bits(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    values = (values ^ (values >> np.uint64(30))) * _ONE
    values = (values ^ (values >> np.uint64(27))) * _TWO
    return values ^ (values >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles.

    A-Z count as a-z; a text of fewer words has one shingle of them all, without words none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    words = lists.flatten()
    there = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    text_of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[there]
    codes = coded.indices.to_numpy(zero_copy_only=False)[there]
    known = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))[codes]
    starts = np.searchsorted(text_of, np.arange(len(texts) + 1))
    rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for place in range(width):
        rolled = rolled * _PRIME + hashes[place : place + len(rolled)]
    rolled = mixed_bits(rolled)
    for a, b in zip(starts, starts[1:], strict=False):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for value in hashes[a:b]:
                whole = whole * _PRIME + value
            yield mixed_bits(whole)
        else:
            yield np.empty(0, np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = rows_of(whole, start, ROWS_AT_ONCE)
            with np.errstate(over="ignore"):
                yield batch, list(shingle_sets(batch.column("_text"), width))
        give_back()


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(CELLS - 1)).astype(np.int64)


def token_counts(docs: DataFrame, width: int) -> np.ndarray:
    """In how many documents, nearly, the tokens of each cell are; over all documents.

    Only the order that this gives to tokens matters, and any order gives the same result:
    rare ones first make the matrix small. The table has a fixed size.
    """
    part = CELLS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for _, sets in _sets(batches, width):
            if sets:
                counts += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS)
        blobs = [zlib.compress(counts[s : s + part].astype("<u4").tobytes(), 1) for s in range(0, CELLS, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(part, np.int64)
        for blob in rows["counts"].to_pylist():
            total += np.frombuffer(zlib.decompress(blob), "<u4")
        blob = np.minimum(total, 2**32 - 1).astype("<u4").tobytes()
        return pa.table({"slice": rows["slice"][:1], "counts": pa.array([blob], pa.binary())})

    schema = "slice int, counts binary"
    summed = docs.select("_text").mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema)
    found = np.zeros(CELLS, np.uint32)
    for row in summed.collect():
        found[row["slice"] * part :][:part] = np.frombuffer(row["counts"], "<u4")
    return found


def least_common(size, percent: int):
    """The fewest tokens that a set of this size shares with a similar one."""
    return -(-percent * size // 100)


def least_shared(size: int, percent: int) -> int:
    """So many tokens of the matrix a set of this size shares with any similar set that is not smaller."""
    return min(least_common(size, percent), max(LEAST_SHARED, SHARED * size // 100))


class Order:
    """Rare tokens first, and the min-hash that names a set's group."""

    def __init__(self, counts: np.ndarray, percent: int):
        self.counts, self.percent = counts, percent
        mean = counts.mean(dtype=np.float64)
        self.frequent = mean + 6 * mean**0.5 + 16

    def prefix(self, tokens: np.ndarray) -> np.ndarray:
        """The rarest tokens, so many that those of a similar set share ``least_shared`` with them."""
        size = len(tokens)
        order = np.lexsort((tokens, self.counts[_cell(tokens)]))
        return tokens[order[: size - least_common(size, self.percent) + least_shared(size, self.percent)]]

    def group(self, tokens: np.ndarray) -> int:
        """The smallest hash of the set's frequent tokens, or of the others, whichever are more.

        So a passage that many documents share makes no group of them, unless it is most
        of their text.
        """
        frequent = self.counts[_cell(tokens)] > self.frequent
        return int(tokens[frequent if 2 * frequent.sum() > len(tokens) else ~frequent].min().view(np.int64))


def digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.astype("<u8").tobytes())


class Block:
    """Sets of one block of a group: their union, and which sets have each of its tokens."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.members = of[order]
        self.union, starts = np.unique(tokens[order], return_index=True)
        self.starts = np.append(starts, len(tokens))

    def links(self, tokens: np.ndarray) -> np.ndarray:
        """The numbers of the sets similar to this one; none are compared beyond the bound."""
        place = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        shared = place[self.union[place] == tokens]
        if len(shared) < least_common(len(tokens), self.percent):
            return np.empty(0, np.int64)
        lengths = self.starts[shared + 1] - self.starts[shared]
        at = np.repeat(self.starts[shared] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        common = np.bincount(self.members[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= self.percent * (self.sizes + len(tokens) - common))


class Sets:
    """Which of so many things are joined."""

    def __init__(self, count: int):
        self.parent = list(range(count))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


LINKS = "a binary, b binary, _left boolean"


def _open(percent: int):
    """Links of one block: of its members with each other, and of queries with them.

    Links that join nothing anew are left out. Members that are joined with the group's
    pivot (its smallest class, a query of every block of its group) need not be compared
    with each other; those that are not are told, so that other blocks can be asked.
    """

    def compare(rows: pa.Table) -> pa.Table:
        ids = rows["_class"].to_pylist()
        kinds = rows["_kind"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in rows["_tokens"].to_pylist()]
        members = [n for n in range(len(ids)) if kinds[n] == 0]
        queries = [n for n in range(len(ids)) if kinds[n] != 0]
        first, second, left = [], [], []
        if members:
            block, joined = Block([sets[n] for n in members], percent), Sets(len(ids))

            def compare_one(number: int) -> None:
                for other in block.links(sets[number]):
                    if joined.join(number, members[other]):
                        first.append(ids[number])
                        second.append(ids[members[other]])
                        left.append(False)

            for number in sorted(queries, key=lambda n: kinds[n] != 2):
                compare_one(number)
            if rows["_alone"][0].as_py():
                pivot = next((n for n in queries if kinds[n] == 2), members[0])
                for number in members if pivot in queries else [pivot, *members[1:]]:
                    if number == pivot or joined.root(number) != joined.root(pivot):
                        compare_one(number)
                if kinds[pivot] == 2:
                    away = [n for n in members if joined.root(n) != joined.root(pivot)]
                    first += [ids[n] for n in away]
                    second += [ids[n] for n in away]
                    left += [True] * len(away)
        return pa.table([pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array(left, pa.bool_())], ["a", "b", "_left"])

    return compare


def _cells(members: DataFrame, queries: DataFrame, blocks: DataFrame, alone: bool) -> DataFrame:
    """Where classes meet: ``_class``, ``_group``, ``_block``, ``_part``, ``_kind``, ``_alone``; no set is moved.

    Blocks have about ``MEMBERS`` members, parts about ``QUERIES`` queries. ``queries`` has a row
    per query and group. With ``alone``, members are compared with each other in the part of
    the first queries.
    """
    asked = queries.groupBy("_group").agg(F.count(F.lit(1)).alias("_asked"))
    parts = blocks.join(asked, "_group", "left").withColumn("_parts", F.greatest(F.ceil(F.coalesce("_asked", F.lit(0)) / QUERIES), F.lit(1)))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    hashed = lambda n: F.pmod(F.xxhash64("_class"), n)
    columns = ["_class", "_group", "_block", "_part", "_kind"]
    placed = members.join(parts, "_group").withColumn("_block", hashed(F.col("_blocks")))
    placed = placed.withColumn("_part", up_to(F.col("_parts"))).withColumn("_kind", F.lit(0))
    asking = queries.join(parts, "_group").withColumn("_part", hashed(F.col("_parts")))
    pivot = F.col("_kind") == 2  # asked in all blocks, and in the part that compares members
    asking = asking.withColumn("_part", F.when(pivot, F.lit(0)).otherwise(F.col("_part"))).withColumn("_block", up_to(F.col("_blocks")))
    together = placed.select(columns).unionByName(asking.select(columns))
    return together.withColumn("_alone", (F.col("_part") == 0) & F.lit(alone))


def _opened(sets: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """The links found in the cells; each set is shuffled to the cells that it is in."""
    together = cells.join(sets, "_class")
    return together.groupBy("_group", "_block", "_part").applyInArrow(_open(percent), LINKS)


def _wanted_texts(marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``marked`` with a class of ``wanted``; most others go before any shuffle.

    The filter is a bit per hash, of a fixed size: the more texts are wanted, the more others
    pass it, and the join has the last word.
    """
    name = lambda key, mark: F.pmod(F.xxhash64(key, mark), F.lit(FILTER_BITS))
    bits = wanted.select(name("_one._id", "_one._mark").alias("_bit"))
    one = F.expr("shiftleft(1L, CAST(_bit % 32 AS INT))")
    words = bits.groupBy(F.floor(F.col("_bit") / 32).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    held = np.zeros(FILTER_BITS // 32, np.uint32)
    held[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    shared = marked.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def may_be(bit: pa.Array) -> pa.Array:
        place = bit.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1)

    some = marked.filter(may_be(name("_id", "_mark")))
    same = F.col("_id").eqNullSafe(F.col("_one._id")) & (F.col("_mark") == F.col("_one._mark"))
    return some.join(wanted, same).select("_text", "_class")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Every document's shingle count and component: ``key``, ``n_shingles``, ``component_id``.

    Two documents are linked when ``100 * common >= percent * all`` holds for their sets of
    ``width``-word shingles. The component is the smallest key that links reach. Documents
    without words (null text too) link with nothing, not even each other, and their
    component is their own key. Rows of one key need not have one text. Null keys are
    reached and passed through but never smallest; a component of them alone is null. An
    empty table gives an empty result.

    Tokens are 64-bit hashes of shingles. No link between different texts is lost: similar
    sets share a token of their matrix rows, and all that meet are compared by their
    whole sets unless they are already joined.
    """
    ship_code(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    read = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    # Any share of the rows may have one id, null too: a text is found again by its digest as well.
    marked = read.withColumn("_mark", F.unhex(F.md5(F.col("_text").cast("binary"))))
    order = Order(token_counts(read, width), percent)
    spark = docs.sparkSession
    shared_order = spark.sparkContext.broadcast(order)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared_order.value
        for batch, sets in _sets(batches, width):
            full = [len(s) > 0 for s in sets]
            made = [
                batch.column("_id"),
                batch.column("_mark"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest(s) if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                pa.array([rank.group(s) if f else None for s, f in zip(sets, full, strict=True)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(made, ["_id", "_mark", "_size", "_class", "_group"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared_order.value
        for _, sets in _sets(batches, width):
            distinct = {s.tobytes(): s for s in sets if len(s)}
            rows = [rank.prefix(s) for s in distinct.values()]
            if rows:
                groups = np.repeat([rank.group(s) for s in distinct.values()], [len(r) for r in rows])
                pairs = np.unique(np.stack([np.concatenate(rows).view(np.int64), groups]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["_token", "_group"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch, sets in _sets(batches, width):
            classes = batch.column("_class").to_pylist()
            rows = []
            for n, s in enumerate(sets):
                if len(s) and classes[n] not in seen and digest(s) == classes[n]:
                    rows.append(n)
                    seen.add(classes[n])
            blobs = [sets[n].astype("<u8").tobytes() for n in rows]
            made = [batch.column("_class").take(pa.array(rows, pa.int64())), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["_class", "_tokens"])

    signed = stored(marked.mapInArrow(sign, f"_id {kind}, _mark binary, _size long, _class binary, _group long"), "jaccard-sets")
    one = F.min(F.struct("_id", "_mark")).alias("_one")
    of_class = [F.min("_id").alias("_first"), one, F.first("_group").alias("_group"), F.first("_size").alias("_size")]
    classes = signed.filter("_class IS NOT NULL").groupBy("_class").agg(*of_class)
    classes = stored(classes, "jaccard-classes")
    facts = [F.count(F.lit(1)).alias("_count"), F.min("_class").alias("_pivot"), F.min("_size").alias("_low"), F.max("_size").alias("_high")]
    sizes = stored(classes.groupBy("_group").agg(*facts), "jaccard-groups")
    # The token-group matrix, by token; rows of a single group can bring nothing together.
    matrix = read.select("_text").mapInArrow(tell, "_token long, _group long").groupBy("_token").agg(F.collect_set("_group").alias("_groups"))
    shared = matrix.filter(F.size("_groups") > 1).groupBy(F.array_sort("_groups").alias("_groups")).agg(F.count(F.lit(1)).alias("_tokens"))
    ones = shared.select(F.explode("_groups").alias("_one"), "_groups", "_tokens")
    pairs = ones.select("_one", F.explode(F.filter("_groups", lambda g: g > F.col("_one"))).alias("_other"), "_tokens")
    pairs = pairs.groupBy("_one", "_other").agg(F.sum("_tokens").alias("_shared"))
    size_of = lambda name: sizes.select(
        F.col("_group").alias(name), *[F.col(c).alias(name + c) for c in ("_count", "_low", "_high")]
    )
    told = pairs.join(size_of("_one"), "_one").join(size_of("_other"), "_other")
    # The smaller of two similar sets has that share of the larger at least.
    fits = lambda small, large: 100 * F.col(small) >= percent * F.col(large)
    low = F.least("_one_low", "_other_low")
    of_size = F.greatest(F.lit(LEAST_SHARED), F.floor(SHARED * low / 100))
    enough = F.col("_shared") >= F.least(F.ceil(percent * low / 100), of_size)
    told = told.filter(enough & fits("_one_high", "_other_low") & fits("_other_high", "_one_low"))
    swap = F.col("_one_count") > F.col("_other_count")
    told = told.select(
        F.when(swap, F.col("_other")).otherwise(F.col("_one")).alias("_from"),
        *[
            F.when(swap, F.col(f"_one{c}")).otherwise(F.col(f"_other{c}")).alias(c or "_group")
            for c in ("", "_low", "_high")
        ],
    )
    told = stored(told, "jaccard-pairs")
    asking = classes.withColumnRenamed("_group", "_from").join(told, "_from").withColumn("_kind", F.lit(1))
    asking = asking.filter(fits("_high", "_size") & fits("_size", "_low"))
    blocks = sizes.select("_group", F.ceil(F.col("_count") / MEMBERS).alias("_blocks"), "_pivot")
    many = blocks.filter("_blocks > 1")
    pivots = many.select(F.col("_pivot").alias("_class"), "_group", F.lit(2).alias("_kind"))
    columns = ["_class", "_group", "_kind"]
    # First, members of a group with each other, and of each group the pivot with the largest
    # group it is opened to: most near copies are joined by these few.
    largest = F.max(F.struct("_count", "_group")).alias("_largest")
    sized = blocks.drop("_pivot")
    alone = told.join(sizes.select("_group", "_count"), "_group").groupBy("_from").agg(largest)
    alone = alone.join(sizes.select(F.col("_group").alias("_from"), F.col("_pivot").alias("_class")), "_from")
    queries = stored(alone.select("_class", "_largest._group", F.lit(1).alias("_kind")).unionByName(pivots), "jaccard-first-queries")
    opened = told.select("_group").unionByName(sizes.filter("_count > 1").select("_group"))
    wanted = classes.join(opened.unionByName(told.select(F.col("_from").alias("_group"))).distinct(), "_group", "left_semi")
    # Rows of one id and text give a class once a task; equal sets in a cell do no harm.
    sets = _wanted_texts(marked, wanted.select("_one", "_class")).mapInArrow(whole, "_class binary, _tokens binary")
    sets = stored(sets, "jaccard-tokens")
    first = queries.select("_group").unionByName(sizes.filter("_count > 1").select("_group")).distinct()
    members = classes.join(first, "_group", "left_semi").select("_class", "_group")
    found = stored(_opened(sets, _cells(members, queries, sized, True), percent), "jaccard-links")
    links = found.filter("NOT _left").select("a", "b")
    away = found.filter("_left").select(F.col("a").alias("_class")).distinct()
    if not away.isEmpty():
        # Members away from their group's pivot are queries to all blocks of the group.
        late = away.join(classes, "_class").select("_class", "_group", F.lit(1).alias("_kind"))
        several = members.join(late.select("_group").distinct(), "_group", "left_semi")
        links = stored(links.unionByName(_opened(sets, _cells(several, late, sized, False), percent).select("a", "b")), "jaccard-links")
    # Then every class with the groups that its own is opened to, but for groups joined with it as a whole.
    roots = components(links).withColumnRenamed("node", "_class")
    rooted = classes.select("_class", "_group").join(roots, "_class", "left").withColumn("_root", F.coalesce("root", "_class"))
    rooted = stored(rooted.select("_class", "_group", "_root"), "jaccard-roots")
    one_root = F.when(F.min("_root") == F.max("_root"), F.min("_root")).alias("_whole")
    asking = asking.select(columns).join(rooted.select("_class", "_root"), "_class").join(rooted.groupBy("_group").agg(one_root), "_group")
    asking = stored(asking.filter(~F.col("_root").eqNullSafe(F.col("_whole"))).select(columns), "jaccard-queries")
    asked = classes.join(asking.select("_group").distinct(), "_group", "left_semi").select("_class", "_group")
    more = _opened(sets, _cells(asked, asking, sized, False), percent).select("a", "b")
    links = stored(links.unionByName(more), "jaccard-all-links")
    rooted = components(links).withColumnRenamed("node", "_class")
    owned = classes.join(rooted, "_class", "left").select("_class", "_first", F.coalesce("root", "_class").alias("_root"))
    least = owned.groupBy("_root").agg(F.min("_first").alias("_component"))
    labels = owned.join(least, "_root").select("_class", "_component")
    component = F.when(F.col("_class").isNull(), F.col("_id")).otherwise(F.col("_component"))
    result = signed.join(labels, "_class", "left").select("_id", F.col("_size").alias("n_shingles"), component.alias("component_id"))
    return result.withColumnRenamed("_id", key)


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` with their shingle counts and components of near copies."""
    return similar(documents(spark, sf_dir))


OP10_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = other)
SELECT reach.doc_id, any_value(CAST(n AS BIGINT)) AS n_shingles, min(other) AS component_id
FROM reach JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id
"""
