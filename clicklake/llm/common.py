"""What several operators share: word patterns, row places, tables in the shared folder."""

from __future__ import annotations

import ctypes
import functools
import json
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.lake import shared_folder

# Words part at ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"

ROWS_PER_BUCKET = 4096
# Documents that go to Python together: texts are long, and the default is for short rows.
ARROW_ROWS = 2000


@functools.cache
def _ship(context: SparkContext) -> None:
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="clicklake-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as files:
        for module in sorted(package.rglob("*.py")):
            files.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per session, so that they need no install.

    Spark sends them the archive from the driver; Python steps keep what they learn (words,
    tables) in its modules between tasks.
    """
    _ship(spark.sparkContext)


def rows_of(batch: pa.RecordBatch, start: int, count: int) -> pa.RecordBatch:
    """Some rows as a batch of their own; a slice would leave nested columns with an offset."""
    if start == 0 and count >= batch.num_rows:
        return batch
    return batch.take(pa.array(range(start, min(start + count, batch.num_rows)), pa.int64()))


def in_pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches again, none with more than so many rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield rows_of(batch, start, rows)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_small_batches(function: Callable) -> Callable:
    """The function of a session and more, with Arrow batches of ``ARROW_ROWS`` rows in that session."""

    @functools.wraps(function)
    def run(spark: SparkSession, *more):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        return function(spark, *more)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores after them until no column of ``df`` has them."""
    taken = {column.lower() for column in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def word_count(text: Column) -> Column:
    """The number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def literal_rows(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A few given rows as a frame of constants; ``fields`` is like ``name:string,n:int``."""
    held = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")
    return spark.range(1, numPartitions=1).select(F.inline(held))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: read again, not computed again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets_for(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Into how many buckets rows go, so that the mean bucket stays small at any size."""
    return max(1, -(-rows // rows_per_bucket))


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before, in each group.

    ``bucket`` grows with ``order``. Sums of whole buckets are added up over one row per
    bucket, and rows only within their bucket, so that no task holds a whole group. The
    columns of ``group`` and ``bucket`` must not be null.
    """
    held, before_, within_ = unused(df, "_value", "_before", "_within")
    valued = df.withColumn(held, value)
    sums = valued.groupBy(*group, bucket).agg(F.sum(held).alias("_sum"))
    over_buckets = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(over_buckets), F.lit(0)).alias(before_))
    in_bucket = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = valued.withColumn(within_, F.coalesce(F.sum(held).over(in_bucket), F.lit(0)))
    return within.join(before, [*group, bucket]).select(
        *[F.col(c) for c in df.columns], (F.col(before_) + F.col(within_)).cast("long").alias(name)
    )
