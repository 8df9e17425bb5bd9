"""A quality classifier of supervised subword embeddings.

Every word, and every run of one to four characters of it, has a vector in a hashed table; so
has the distance, in powers of two, at which a word comes again. A document is the average of
the vectors of all its words, character runs and distances; softmax over a linear layer tells
its label. Table and layer are learned together by stochastic gradient descent in numpy, on a
bounded sample of labelled rows; all rows are then scored where they are read, without a
shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, give_back, in_pieces, ship_code, stored

# The sample: at most so many labelled rows, of at most so many features in all.
TRAIN_ROWS = 8192
TRAIN_FEATURES = 1 << 25
# The model: 2^17 vectors of 16 single-precision numbers, 8 MB at any size of the corpus.
BUCKETS, DIMENSION = 1 << 17, 16
LONGEST_RUN = 4
# Descent: the sample is gone through as often as so many steps need, one document a step.
STEPS = 40_000
RATE = 0.1
SEED = 12

# Words, characters and documents in work at a time.
TOKENS_AT_ONCE, CHARACTERS_AT_ONCE, ROWS_AT_ONCE = 1 << 18, 1 << 15, 2000
FEATURES = "label int, order_ long, places binary, counts binary"
MODEL = "vectors binary, layer binary, bias binary"


def _hashed(codes: np.ndarray) -> np.ndarray:
    """Buckets of 64-bit numbers, by their mixed upper bits."""
    mixed = (codes ^ (codes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def word_features(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (word, bucket), in order of the words, for each kind of feature in turn.

    The kinds are the word itself, and the runs of each length in the word between ``<`` and
    ``>``. A word too short for a run has none of that length.
    """
    checks = np.array([zlib.crc32(word) for word in words], np.uint64)
    yield np.arange(len(words)), _hashed(checks << np.uint64(3))
    marked = [f"<{word.decode('utf-8', 'replace')}>" for word in words]
    sizes = np.array([len(word) for word in marked], np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word_of = np.repeat(np.arange(len(words)), sizes)
    to_end = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    codes = np.full(len(points), 7, np.uint64)
    for length in range(1, LONGEST_RUN + 1):
        codes = codes[: len(points) - length + 1] * np.uint64(0x100000001B3) + points[length - 1 :]
        there = to_end[: len(codes)] >= length
        yield word_of[: len(codes)][there], _hashed((codes[there] << np.uint64(3)) + np.uint64(length))


def recurrence(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each word, how far back its row has it: 0 for not at all, 1 for next to it, 2 for 2, 3 for 3 or 4 and so on."""
    if not len(rows):
        return np.zeros(0, np.int64)
    order = np.argsort(rows * (int(codes.max()) + 1) + codes, kind="stable")
    same = (rows[order][1:] == rows[order][:-1]) & (codes[order][1:] == codes[order][:-1])
    out = np.zeros(len(rows), np.int64)
    back = np.ceil(np.log2(np.diff(order), where=same, out=np.zeros(len(same)))) + 1
    out[order[1:]] = np.where(same, back, 0)
    return out


# The buckets of distances, as many as rows can have.
RECURRENCES = _hashed((np.arange(64, dtype=np.uint64) << np.uint64(3)) + np.uint64(7))


def _in_characters(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of words of about ``CHARACTERS_AT_ONCE`` bytes; a longer word is a run of its own."""
    run = np.cumsum([len(word) for word in words]) // CHARACTERS_AT_ONCE
    starts = np.flatnonzero(np.diff(run, prepend=-1)) if len(words) else np.zeros(0, int)
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(words)], strict=True)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row and code of each word of the texts, and the distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    there = np.array([len(word) > 0 for word in words], bool)[codes] if len(codes) else np.zeros(0, bool)
    return rows[there], codes[there], words


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("_text").cast(pa.large_string()).fill_null("")


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct features of each labelled text, and how often each occurs."""
    for batch in in_pieces(batches, ROWS_AT_ONCE):
        rows, codes, words = _words(_texts(batch))
        again = RECURRENCES[recurrence(rows, codes)]
        pairs = [(w + start, f) for start, end in _in_characters(words) for w, f in word_features(words[start:end])]
        word_of, bucket = (np.concatenate([p[n] for p in pairs] or [np.zeros(0, np.int64)]) for n in (0, 1))
        order = np.argsort(word_of, kind="stable")
        bucket, ends = bucket[order], np.cumsum(np.bincount(word_of, minlength=len(words)))
        starts = ends - np.diff(ends, prepend=0)
        borders = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        places, counts = [], []
        for first, last in zip(borders, borders[1:], strict=False):
            mine, times = np.unique(codes[first:last], return_counts=True)
            sizes = ends[mine] - starts[mine]
            inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            features = np.concatenate([bucket[np.repeat(starts[mine], sizes) + inside], again[first:last]])
            weights = np.concatenate([np.repeat(times, sizes), np.ones(last - first)])
            distinct, where = np.unique(features, return_inverse=True)
            places.append(distinct.astype(np.int32).tobytes())
            counts.append(np.bincount(where, weights, len(distinct)).astype(np.float32).tobytes())
        columns = [batch.column("label"), batch.column("order_"), pa.array(places, pa.binary()), pa.array(counts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["label", "order_", "places", "counts"])
        give_back()


def _train(sample: pa.Table) -> pa.Table:
    """Vectors, layer and bias after ``STEPS`` steps over the sample, in an order that the seed fixes."""
    chance = np.random.default_rng(SEED)
    vectors = chance.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    layer, bias = np.zeros((2, DIMENSION), np.float32), np.zeros(2, np.float32)
    moved, layer_moved, bias_moved = np.full(BUCKETS, 1e-8, np.float32), np.full((2, DIMENSION), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    sample = sample.sort_by("order_")
    labels = sample["label"].to_numpy()
    examples = [
        (np.frombuffer(p, np.int32), np.frombuffer(c, np.float32))
        for p, c in zip(sample["places"].to_pylist(), sample["counts"].to_pylist(), strict=True)
    ]
    step = 0
    while examples and step < STEPS:
        for number in chance.permutation(len(examples))[: STEPS - step]:
            places, counts = examples[number]
            share = counts / max(float(counts.sum()), 1.0)
            held = vectors[places]
            average = share @ held
            scores = layer @ average + bias
            odds = np.exp(scores - scores.max())
            wrong = odds / odds.sum()
            wrong[labels[number]] -= 1
            rate = RATE * (1 - step / STEPS)
            back = wrong @ layer
            slope = np.outer(wrong, average)
            # Each step is scaled by the slopes met before (AdaGrad), as rare features have small ones.
            moved[places] += share * share * float(back @ back / DIMENSION)
            vectors[places] = held - (rate * share / np.sqrt(moved[places]))[:, None] * back
            layer_moved += slope * slope
            layer -= rate * slope / np.sqrt(layer_moved)
            bias_moved += wrong * wrong
            bias -= rate * wrong / np.sqrt(bias_moved)
            step += 1
    return pa.table({n: pa.array([v.tobytes()], pa.binary()) for n, v in (("vectors", vectors), ("layer", layer), ("bias", bias))})


def _scored(vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray, names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, ROWS_AT_ONCE):
            rows, codes, words = _words(_texts(batch))
            of_word, features = np.zeros((len(words), DIMENSION)), np.zeros(len(words))
            for start, end in _in_characters(words):
                for word_of, bucket in word_features(words[start:end]):
                    first = np.flatnonzero(np.diff(word_of, prepend=-1))
                    if len(first):
                        of_word[start + word_of[first]] += np.add.reduceat(vectors[bucket], first, axis=0, dtype=np.float64)
                        features[start + word_of[first]] += np.diff(np.append(first, len(bucket)))
            again, of_distance = recurrence(rows, codes), vectors[RECURRENCES].astype(np.float64)
            total, number = np.zeros((batch.num_rows, DIMENSION)), np.zeros(batch.num_rows)
            for start in range(0, len(rows), TOKENS_AT_ONCE):
                row, code = rows[start : start + TOKENS_AT_ONCE], codes[start : start + TOKENS_AT_ONCE]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                met = of_word[code] + of_distance[again[start : start + TOKENS_AT_ONCE]]
                total[row[first]] += np.add.reduceat(met, first, axis=0)
                number += np.bincount(row, features[code] + 1, batch.num_rows)
            sums = (total / np.maximum(number, 1)[:, None]) @ layer.T.astype(np.float64) + bias
            made = 1 / (1 + np.exp(np.clip(sums[:, 0] - sums[:, 1], -500, 500)))
            columns = [batch.column("_row").field(n) for n in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made)], [f"c{n}" for n in range(len(names))] + ["_score"])
            give_back()

    return score


def is_held_out(key: Column) -> Column:
    """Rows that no training sees: those whose id's checksum leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """A bounded sample of labelled texts: ``label``, ``order_``, ``_text``.

    Labels of rows that are held out, of none or another label than 0 and 1, or without an id
    do not count. At most ``TRAIN_ROWS`` labels are taken, those of the smallest hashes, and
    of their texts (an id may have several) again as many; equal rows count once. A null text
    is an empty one.
    """
    known = labels.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.filter(F.col("_id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("_id"))).distinct()
    known = known.orderBy(F.xxhash64("_id"), "_id", "label").limit(TRAIN_ROWS)
    read = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    # At most TRAIN_ROWS rows of two numbers are sent to all tasks.
    met = read.join(F.broadcast(known), "_id").distinct()
    order = F.xxhash64("_id", "_text", "label")
    return met.select("label", order.alias("order_"), "_text").orderBy("order_").limit(TRAIN_ROWS)


def trained(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, layer and bias learned from rows of ``sample``; without a row they tell nothing.

    Rows in order of their hash that would bring the features above ``TRAIN_FEATURES`` are
    left out, so that the task that learns holds at most 256 MB of them.
    """
    ship_code(rows.sparkSession)
    found = stored(rows.mapInArrow(_featured, FEATURES), "subwords-sample")
    so_far = F.sum(F.length("places") / 4).over(Window.orderBy("order_").rowsBetween(Window.unboundedPreceding, 0))
    fitting = found.select("order_", "places").withColumn("_sum", so_far).filter(F.col("_sum") <= TRAIN_FEATURES)
    kept = found.join(F.broadcast(fitting.select("order_").distinct()), "order_")
    model = kept.groupBy(F.lit(0).alias("_all")).applyInArrow(_train, MODEL).collect()
    if not model:
        return np.zeros((BUCKETS, DIMENSION), np.float32), np.zeros((2, DIMENSION), np.float32), np.zeros(2, np.float32)
    held = [np.frombuffer(model[0][name], np.float32) for name in ("vectors", "layer", "bias")]
    return held[0].reshape(BUCKETS, DIMENSION), held[1].reshape(2, DIMENSION), held[2]


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Every row with ``held_out``, ``score`` and ``predicted``; columns of these names are replaced.

    ``score`` is the probability of label 1 by the text alone, ``predicted`` is 1 from 0.5 on.
    A null text counts as empty; empty texts have the score of no features. Rows that are
    alike score alike. A row without an id is not held out. Without a labelled row that may
    be learned from, all scores are 0.5. An empty table gives an empty result.
    """
    vectors, layer, bias = trained(sample(docs, labels, key, text, label))
    made = ["held_out", "score", "predicted"]
    names = [name for name in docs.columns if name not in made]
    row = F.struct(*[F.col(f"`{name}`") for name in names])
    kinds = ", ".join(f"c{n} {docs.schema[name].dataType.simpleString()}" for n, name in enumerate(names))
    read = docs.select(row.alias("_row"), F.col(f"`{text}`").alias("_text"))
    found = read.mapInArrow(_scored(vectors, layer, bias, names), f"{kinds}, _score double")
    place = {name: F.col(f"c{n}") for n, name in enumerate(names)}
    return found.select(
        *[column.alias(name) for name, column in place.items()],
        is_held_out(place[key].cast("long")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def op12_subwords(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    read = documents(spark, sf_dir).select("doc_id", "text")
    found = scored(read, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", "predicted")
