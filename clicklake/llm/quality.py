"""Quality rules: divergence of a document's histograms from its language's.

References are counted over all documents of a language: how often each class of
characters comes, and how often each of its most common words. A document is compared with
them by the Jensen-Shannon distance, once it is long enough for its histogram to mean
something.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, documents, give_back, rows_of, ship_code, stored

COMMON_WORDS = 64
# A document must be at least so long to be judged by its characters, or by its words.
LEAST_CHARS, LEAST_WORDS = 200, 50
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.28, 0.5
CLASSES = ("upper", "lower", "letter", "digit", "space", "mark", "punctuation", "symbol", "other")
SYMBOLS = "#*$%&|<>"
# Codes below this fit into one number by threes.
PACKED = 2**21
# Texts that are measured together, and those whose words are counted before they are sent on.
ROWS_AT_ONCE, ROWS_COUNTED = 2048, 16384


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point, by its general category; symbols are ``SYMBOLS`` and category S."""
    of = {"Lu": 0, "Lt": 0, "Ll": 1, "Lo": 2, "Lm": 2, "N": 3, "Z": 4, "M": 5, "P": 6, "S": 7}
    table = np.full(0x110000, 8, np.uint8)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))
        table[point] = of.get(category, of.get(category[0], 8))
    table[[ord(c) for c in "\t\n\x0b\x0c\r"]] = 4
    table[[ord(c) for c in SYMBOLS]] = 7
    return table


def window_names(codes: np.ndarray) -> np.ndarray:
    """A number for each three codes in a row, the same for the same three."""
    count = int(codes.max()) + 1
    if count <= PACKED:
        return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    # Pairs are numbered first: they are no more than the words, and those are below 2**31.
    pairs = np.unique(codes[:-2] * count + codes[1:-1], return_inverse=True)[1]
    return pairs * count + codes[2:]


class Words:
    """The words of a batch of texts, numbered within the batch."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten()
        there = pc.greater(pc.binary_length(words), 0)
        text_of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        self.text_of = text_of[there.to_numpy(zero_copy_only=False)]
        self.words = words.filter(there)
        coded = self.words.dictionary_encode()
        self.distinct, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.searchsorted(self.text_of, np.arange(len(texts) + 1))
        self.counts = np.diff(self.starts)

    def chars(self) -> np.ndarray:
        """Code points in the words of each text."""
        lengths = pc.utf8_length(self.words).to_numpy(zero_copy_only=False)
        return np.bincount(self.text_of, weights=lengths, minlength=len(self.counts)).astype(np.int64)

    def repeated(self) -> np.ndarray:
        """Words of each text that lie in a window of three words found twice or more in it."""
        out = np.zeros(len(self.counts), np.int64)
        for text, (a, b) in enumerate(zip(self.starts, self.starts[1:], strict=False)):
            if b - a < 4:
                continue
            codes = self.codes[a:b]
            if len(self.distinct) >= PACKED:
                codes = np.unique(codes, return_inverse=True)[1]
            windows = window_names(codes)
            ordered = np.sort(windows)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                place = np.minimum(np.searchsorted(twice, windows), len(twice) - 1)
                found = twice[place] == windows
                inside = np.zeros(b - a, bool)
                inside[:-2] |= found
                inside[1:-1] |= found
                inside[2:] |= found
                out[text] = inside.sum()
        return out


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    text_of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    there = worded.to_numpy(zero_copy_only=False)
    keys = np.unique(text_of[there] * (len(codes) + 1) + codes[there])
    all_, distinct = np.bincount(text_of[there], minlength=len(texts)), np.bincount(keys // (len(codes) + 1), minlength=len(texts))
    return (all_ - distinct).astype(np.int64)


def char_counts(texts: pa.Array) -> np.ndarray:
    """How many code points of each class each text has."""
    table, out = class_table(), np.zeros((len(texts), len(CLASSES)), np.int64)
    for number, text in enumerate(texts.to_pylist()):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[number] = np.bincount(table[points], minlength=len(CLASSES))
    return out


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance (root of the divergence in bits) of each row to the reference."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    q = np.broadcast_to(reference / max(reference.sum(), 1), p.shape)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / middle), 0).sum(1) for x in (p, q)]
    return np.sqrt(np.clip((parts[0] + parts[1]) / 2, 0, 1))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield rows_of(batch, start, ROWS_AT_ONCE)
        give_back()


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("_text").cast(pa.large_string()).fill_null("")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histograms by language; words and classes are counted where they are read."""
    classes: dict = {}
    words: dict = {}
    rows = 0

    def told() -> Iterator[pa.RecordBatch]:
        for language, counts in classes.items():
            parts = pa.concat_tables(words[language]).group_by("values").aggregate([("counts", "sum")])
            names = pa.concat_arrays([pa.array(CLASSES, pa.large_string()), parts["values"].combine_chunks()])
            numbers = pa.concat_arrays([pa.array(counts), parts["counts_sum"].combine_chunks()])
            is_word = pa.array(np.arange(len(names)) >= len(CLASSES))
            columns = [pa.array([language] * len(names), pa.string()), is_word, names.cast(pa.string()), numbers]
            yield pa.RecordBatch.from_arrays(columns, ["language", "is_word", "name", "n"])
        classes.clear()
        words.clear()

    for batch in _batches(batches):
        languages = batch.column("_language").dictionary_encode("encode")
        for code, language in enumerate(languages.dictionary.to_pylist()):
            texts = _texts(batch).filter(pc.equal(languages.indices, code))
            classes[language] = classes.get(language, 0) + char_counts(texts).sum(0)
            counted = pc.value_counts(pc.ascii_split_whitespace(texts).flatten())
            counted = counted.filter(pc.greater(pc.binary_length(counted.field("values")), 0))
            words.setdefault(language, []).append(pa.Table.from_struct_array(counted))
        rows += batch.num_rows
        if rows >= ROWS_COUNTED:
            yield from told()
            rows = 0
    yield from told()


def references(docs: DataFrame, language: str = "lang", text: str = "text", words: int = COMMON_WORDS) -> DataFrame:
    """The histograms of every language, over all documents: ``language``, ``is_word``, ``name``, ``n``.

    The ``words`` most common words have a row each, ties to the smaller word, and a row of
    name null holds the rest; each class of characters has a row. Documents without a
    language are one language, null.
    """
    ship_code(docs.sparkSession)
    read = docs.select(F.col(language).cast("string").alias("_language"), F.col(text).alias("_text"))
    counted = read.mapInArrow(_count, "language string, is_word boolean, name string, n long")
    summed = stored(counted.groupBy("language", "is_word", "name").agg(F.sum("n").alias("n")), "quality-counts")
    # The largest of each part of a language, then of the language: no task holds or sorts all its
    # words, and as parts grow in number with the words, none grows. Rows past the rank go early.
    named = summed.filter("is_word")
    parts = buckets_for(named.count())
    spread = named.withColumn("_part", F.pmod(F.xxhash64("name"), F.lit(parts)))
    order = [F.desc("n"), F.asc("name")]

    def first(rows: DataFrame, *group: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= words)

    top = first(first(spread, "language", "_part"), "language")
    common = stored(top.select("language", "is_word", "name", "n"), "quality-common")
    left = named.select("language", "n").unionByName(common.select("language", (-F.col("n")).alias("n")))
    rest = left.groupBy("language").agg(F.sum("n").alias("n"))
    rest = rest.select("language", F.lit(True).alias("is_word"), F.lit(None).cast("string").alias("name"), "n")
    return summed.filter("NOT is_word").unionByName(common).unionByName(rest)


def histograms(table: DataFrame) -> dict:
    """References as ``{language: (class counts, common words, word counts)}``.

    A language has some 70 rows here; languages are as many as ``lang`` has values.
    """
    out: dict = {}
    for row in table.collect():
        classes, words = out.setdefault(row["language"], ({}, {}))
        (words if row["is_word"] else classes)[row["name"]] = row["n"]
    found = {}
    for language, (classes, words) in out.items():
        names = sorted(name for name in words if name is not None)
        counts = [words[name] for name in names] + [words.get(None, 0)]
        found[language] = (np.array([classes.get(c, 0) for c in CLASSES]), names, np.array(counts))
    return found


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double"


def _measure(known: dict, names: list[str]):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            texts = _texts(batch)
            words = Words(texts)
            by_char, by_word = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
            classes = char_counts(texts)
            languages = np.array(batch.column("_language").to_pylist(), object)
            for language in set(languages.tolist()):
                if language not in known:
                    continue
                reference, common, word_counts = known[language]
                rows = np.flatnonzero(languages == language) if language is not None else np.flatnonzero([x is None for x in languages])
                by_char[rows] = distance(classes[rows], reference)
                place = pc.index_in(words.distinct, value_set=pa.array(common, pa.large_string())).fill_null(len(common)).to_numpy(zero_copy_only=False)
                width = len(common) + 1
                number = np.full(len(texts), -1)
                number[rows] = np.arange(len(rows))
                mine = number[words.text_of]
                keys = mine[mine >= 0] * width + place[words.codes[mine >= 0]]
                by_word[rows] = distance(np.bincount(keys, minlength=len(rows) * width).reshape(len(rows), width), word_counts)
            by_char[classes.sum(1) < LEAST_CHARS] = np.nan
            by_word[words.counts < LEAST_WORDS] = np.nan
            made = [
                pa.array(words.counts.astype(np.int64)),
                pa.array(words.chars()),
                pc.count_substring_regex(texts, f"[{SYMBOLS}]").cast(pa.int64()),
                pa.array(duplicate_lines(texts)),
                pa.array(words.repeated()),
                pa.array(by_char, from_pandas=True),
                pa.array(by_word, from_pandas=True),
            ]
            columns = [batch.column("_row").field(n) for n in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns + made, [f"c{n}" for n in range(len(names))] + [m.split()[0] for m in MEASURES.split(", ")])

    return measure


def measured(docs: DataFrame, language: str = "lang", text: str = "text", known: dict | None = None) -> DataFrame:
    """Every row with its measures, its distances and the verdict.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``char_distance`` and ``word_distance`` (null where a text is too short to be judged),
    ``base_failed`` and ``kept``; columns of these names are replaced. A null text has no
    words; it and an empty one fail the base rule. Null languages are one language. Rows
    that are alike count each; an empty table gives an empty result.
    """
    ship_code(docs.sparkSession)
    known = histograms(references(docs, language, text)) if known is None else known
    made = [m.split()[0] for m in MEASURES.split(", ")] + ["base_failed", "kept"]
    names = [name for name in docs.columns if name not in made]
    row = F.struct(*[F.col(f"`{name}`") for name in names])
    read = docs.select(row.alias("_row"), F.col(language).cast("string").alias("_language"), F.col(text).alias("_text"))
    kinds = ", ".join(f"c{n} {docs.schema[name].dataType.simpleString()}" for n, name in enumerate(names))
    found = read.mapInArrow(_measure(known, names), f"{kinds}, {MEASURES}")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    strange = (F.col("char_distance") > MOST_CHAR_DISTANCE) | (F.col("word_distance") > MOST_WORD_DISTANCE)
    judged = found.withColumns({"base_failed": failed, "kept": ~failed & ~F.coalesce(strange, F.lit(False))})
    return judged.select(*[F.col(f"c{n}").alias(name) for n, name in enumerate(names)], *made)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """The measures and the verdict of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return measured(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "char_distance", "word_distance",
    )
