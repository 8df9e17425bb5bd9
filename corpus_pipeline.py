"""A corpus pipeline: quality rules, near copies, secrets, mixing, packing.

Every stage takes the documents that the one before kept, and all but the last return the
columns of ``documents``. Repeated rows, and rows without an id, are documents of their own:
where an operator needs to tell rows apart, they are numbered as they stand in the table,
which must be one that gives the same rows in the same order whenever it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklake.llm import jaccard, mixing, packing, quality, secrets
from clicklake.llm.common import in_small_batches, stored, unused


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Adds a key per row: the id, those without one last, and the row's number."""
    (name,) = unused(docs, "_row_key")
    last = F.lit(2**63 - 1)
    key = F.struct(F.coalesce(F.col("doc_id"), last).alias("id"), F.monotonically_increasing_id().alias("row"))
    return docs.withColumn(name, key), name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality.measured(docs).filter("kept").select(*docs.columns)


def keep_first_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies."""
    rows, key = _numbered(docs)
    first = jaccard.similar(rows, key).filter(F.col(key) == F.col("component_id")).select(key)
    return rows.join(first, key, "left_semi").select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the text, PEM keys whole, and counts the characters anew where one was."""
    found = secrets.scanned(docs, secrets.HIDING)
    # A column of its own: below a new column "text", Spark takes the name in lambdas for the new one.
    (after,) = unused(found, "_after")
    found = found.withColumn(after, secrets.redacted(F.col("text"), F.col("_spans")))
    chars = F.when(F.size("_spans") > 0, F.char_length(after).cast("long")).otherwise(F.col("n_chars"))
    changed = {"text": F.col(after), "n_chars": chars}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents as the mix takes them.

    A document comes as often as its words are taken, rounded; as a source's documents are
    taken in turn, only the one where a source's share ends is rounded at all. Documents
    without words come once.
    """
    rows, key = _numbered(docs)
    (copies,) = unused(rows, "_copies")
    taken = mixing.mixed(rows, key)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(1))
    taken = taken.select(key, times.cast("int").alias(copies)).filter(F.col(copies) > 0)
    joined = rows.join(taken, key).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return joined.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences of 4096, a row per piece."""
    return packing.packed(packing.pieces(docs, packing.default_vocabulary()))


STAGES = [
    ("quality", in_small_batches(keep_good)),
    ("near_copies", in_small_batches(keep_first_of_copies)),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", in_small_batches(pack)),
]
# SQL has neither the tokenizer nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads the table that the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
