"""Lake tables, and the shared folder for intermediate tables."""

from __future__ import annotations

import contextlib
import functools
import itertools
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .settings import table_format

QUERY_COLUMN, BATCH_COLUMN = "query_id", "batch_id"
OWN_ID = "clicklake.stream.id"
# Set to "true" where the file system of a local-looking checkpoint folder is shared by all hosts.
SHARED_SETTING = "spark.clicklake.checkpointDirIsShared"


def stream_id(spark: SparkSession) -> str:
    """The id of the stream whose batch is being processed; it lasts with the checkpoint.

    Without one, streams would replace each other's batches, so that is an error: inside a
    stream it means that Python threads are not pinned to those of the JVM.
    """
    context = spark.sparkContext
    name = context.getLocalProperty("sql.streaming.queryId") or context.getLocalProperty(OWN_ID)
    if not name:
        raise ValueError(
            "no stream id: a batch is processed outside a stream (see as_stream), or PYSPARK_PIN_THREAD is off"
        )
    return name


@contextlib.contextmanager
def as_stream(spark: SparkSession, name: str) -> Iterator[None]:
    """Process batches outside a stream, under an id of the caller's own.

    Batches of one id and number replace each other, as a retry should.
    """
    context = spark.sparkContext
    before = context.getLocalProperty(OWN_ID)
    context.setLocalProperty(OWN_ID, name)
    try:
        yield
    finally:
        context.setLocalProperty(OWN_ID, before)


def stream_folder(spark: SparkSession, path: str) -> str:
    """Where the present stream keeps its batches of a file table.

    Streams that share a table, or a stream that was started anew, count their batches
    from 0, so each has a folder of its own.
    """
    return f"{path.rstrip('/')}/{QUERY_COLUMN}={stream_id(spark)}"


def batch_folder(spark: SparkSession, path: str, batch_id: int) -> str:
    """Where the present stream keeps one micro-batch of a file table."""
    return f"{stream_folder(spark, path)}/{BATCH_COLUMN}={batch_id}"


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, *, merge_schema: bool = False
) -> DataFrame:
    """A lake table; the folders of streams and batches do not show as columns.

    ``merge_schema`` looks into all files for columns, as is needed for a file table whose
    reader record has grown.
    """
    reader = spark.read.format(fmt or table_format(spark))
    if merge_schema:
        reader = reader.option("mergeSchema", "true")
    return reader.load(path).drop(QUERY_COLUMN, BATCH_COLUMN)


@functools.cache
def _local_folder() -> tempfile.TemporaryDirectory:
    """A folder of this process, removed when it ends."""
    return tempfile.TemporaryDirectory(prefix="clicklake-", ignore_cleanup_errors=True)


def _is_local(spark: SparkSession) -> bool:
    """Whether the driver runs all tasks; the executors of ``local-cluster`` are processes of their own."""
    return spark.sparkContext.master.split("[")[0] == "local"


def _on_local_disk(spark: SparkSession, base: str) -> bool:
    scheme = urlsplit(base).scheme
    if not scheme:
        scheme = urlsplit(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).scheme
    return scheme == "file"


def _shared_bases(spark: SparkSession) -> list[str]:
    """Where the shared folder may be, best first.

    ``spark.checkpoint.dir``, and the warehouse of a cluster. On a local file system they are
    refused, but not on a standalone cluster, whose executors are asked (see ``_usable``).
    """
    context, local = spark.sparkContext, _is_local(spark)
    named = [spark.conf.get("spark.checkpoint.dir", None), context.getCheckpointDir()]
    if not local:
        named.append(spark.conf.get("spark.sql.warehouse.dir", None))
    bases = list(dict.fromkeys(base for base in named if base))
    if local:
        return bases
    if not bases:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.master.startswith(("local-cluster[", "spark://")) or spark.conf.get(SHARED_SETTING, None) == "true":
        return bases
    shared = [base for base in bases if not _on_local_disk(spark, base)]
    if not shared:
        raise ValueError(
            f"spark.checkpoint.dir is on a local file system ({bases[0]}); name a shared one, "
            f"or set {SHARED_SETTING}=true if all hosts mount it"
        )
    return shared


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the warehouse; on a cluster, a folder that executors would not share is refused."""
    bases = _shared_bases(spark)
    return bases[0] if bases else _local_folder().name


def _all_write_to(spark: SparkSession, path: str) -> bool:
    """Whether the driver and the tasks read what tasks on all cores wrote below a folder."""
    tasks = max(2, spark.sparkContext.defaultParallelism)
    try:
        spark.range(tasks, numPartitions=tasks).write.parquet(f"{path}/seen-by-all")
        return spark.read.schema("id long").parquet(f"{path}/seen-by-all").count() == tasks
    except (PySparkException, Py4JJavaError):
        return False


def _usable(spark: SparkSession, path: str) -> bool:
    """Make a session's folder, to be removed when the JVM ends; whether all of the session can write there."""
    own, inner = (spark._jvm.org.apache.hadoop.fs.Path(name) for name in (path, f"{path}/clicklake"))
    try:
        files = own.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.mkdirs(inner):
            return False
        files.deleteOnExit(own)
    except (PySparkException, Py4JJavaError):
        return False
    if _is_local(spark) or spark.conf.get(SHARED_SETTING, None) == "true" or not _on_local_disk(spark, path):
        return True
    return _all_write_to(spark, path)


@functools.cache
def _session_folder(bases: tuple[str, ...], application: str, spark: SparkSession) -> str:
    """This session's part of the shared folder, removed when its JVM ends.

    It shares no parent but the base with other sessions, which may be of other users.
    """
    temporary = (_local_folder().name for _ in range(_is_local(spark)))
    for base in itertools.chain(bases, temporary):
        path = f"{base.rstrip('/')}/{application}-{uuid.uuid4().hex}"
        if _usable(spark, path):
            return f"{path}/clicklake"
    raise ValueError(
        f"driver and executors cannot write to one folder below {' or '.join(bases)}; "
        "set spark.checkpoint.dir to a folder that all executors share"
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``, the cluster's shared folder.

    What is written there is removed when the session's JVM ends. Where it is not set or cannot
    be written, a cluster session uses the warehouse, and a local one a temporary folder of
    this process. On a local file system, the executors of a standalone cluster write a few
    rows first, and the folder is refused if the driver does not find them; on other
    clusters it is always refused, as their executors share no local disk.
    """
    folder = _session_folder(tuple(_shared_bases(spark)), spark.sparkContext.applicationId, spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"
