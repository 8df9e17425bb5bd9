"""Sinks: append streams, exactly-once batch folders, topics and dead-letter topics."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.records import DLQ_TOPIC
from ..operators.deadletter import dlq_messages
from ..operators.keys import TOPIC_PARTITIONS, client_partition
from ..sources.events import KAFKA_SCHEMA, KAFKA_WITH_HEADERS
from ..sources.lake import BATCH_COLUMN, QUERY_COLUMN, batch_folder, stream_id
from ..sources.settings import kafka_options, table_format

CHECKPOINT_IN_TABLE = "_checkpoints/streaming-queries"


def write_stream(
    df: DataFrame,
    path: str,
    checkpoint: str | None = None,
    *,
    fmt: str | None = None,
    partition_by: Sequence[str] = (),
    trigger: dict | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Append a stream to a lake table, exactly once.

    The checkpoint is kept inside the table folder unless another one is given. A file
    table keeps a log of the stream's files there as well, and readers follow it: let one
    stream alone write to the folder, always with the same checkpoint.
    ``trigger`` holds the arguments of ``DataStreamWriter.trigger``, such as
    ``{"processingTime": "5 seconds"}`` or ``{"availableNow": True}``.
    """
    writer = (
        df.writeStream.format(fmt or table_format(df.sparkSession))
        .outputMode("append")
        .option("checkpointLocation", checkpoint or f"{path.rstrip('/')}/{CHECKPOINT_IN_TABLE}")
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if trigger:
        writer = writer.trigger(**trigger)
    if name:
        writer = writer.queryName(name)
    return writer.start(path)


def stream_to_table(
    df: DataFrame,
    table: str,
    checkpoint: str,
    *,
    fmt: str | None = None,
    path: str | None = None,
    partition_by: Sequence[str] = (),
    trigger: dict | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Append a stream to a table of the session's catalog, exactly once.

    A table that is not there is made: in ``fmt`` (that of the session by default), at
    ``path`` if one is given, partitioned by columns. One that is there keeps its layout, such
    as the ``days(event_time)`` of :func:`write_catalog_table`. Of a file table, let one stream
    alone be the writer, as with :func:`write_stream`.
    """
    writer = df.writeStream.format(fmt or table_format(df.sparkSession)).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if trigger:
        writer = writer.trigger(**trigger)
    if name:
        writer = writer.queryName(name)
    return writer.toTable(table)


def run_batches(
    df: DataFrame,
    process: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Call ``process(batch, batch_id)`` on each micro-batch.

    A batch is committed after ``process`` returns. If it raises, the batch stays
    uncommitted and is given to it again after a restart.
    """
    writer = df.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    if name:
        writer = writer.queryName(name)
    return writer.start()


def await_end(query: StreamingQuery, timeout: float | None = None) -> None:
    """Wait for a stream; with a ``timeout``, stop it and raise when it has not ended in time."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not end within {timeout} seconds")


def write_table(
    df: DataFrame,
    path: str,
    *,
    fmt: str | None = None,
    partition_by: Sequence[str] = (),
    rebalance: bool = False,
) -> None:
    """Append a batch to a lake table.

    Tasks write the partitions they meet, without a shuffle. For input in no order of
    time, ``rebalance`` first brings the rows of a partition together in tasks of equal
    size, so that a large partition is spread and a small one has few files.
    """
    if rebalance and partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(fmt or table_format(df.sparkSession)).mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_catalog_table(
    df: DataFrame,
    table: str,
    *,
    fmt: str | None = None,
    path: str | None = None,
    partition_by: Sequence[str] = (),
    days: str | None = None,
) -> None:
    """Append a batch to a table of the session's catalog, which is made if it is not there.

    ``partition_by`` has columns, as every catalog takes them. ``days`` is a time column to
    partition by day without a column for it, which catalogs of table formats with hidden
    partitioning take (Iceberg's, for one); the session catalog refuses it.
    """
    fmt = fmt or table_format(df.sparkSession)
    if days is None:
        writer = df.write.format(fmt).mode("append")
        writer = writer.option("path", path) if path else writer
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
        return
    writer = df.writeTo(table)
    if df.sparkSession.catalog.tableExists(table):
        writer.append()
        return
    writer = writer.using(fmt).partitionedBy(*[F.col(name) for name in partition_by], F.partitioning.days(days))
    (writer.tableProperty("location", path) if path else writer).create()


def compact(spark: SparkSession, path: str, target: str, until: str, by: str = "dt") -> None:
    """Rewrite the closed days of a batch table, those before ``until``, into few files.

    What is rewritten are the folders of a stream, a batch and a day that no earlier run
    took, so rows of a closed day that come later are taken by the next run. A run writes its
    rows, and then the names of its folders: without the names, its rows do not count. Read
    the two by :func:`read_compacted`, and remove what was taken by :func:`remove_compacted`.
    """
    batches = _folders(spark, path, by).filter(F.col(by) < F.lit(until).cast("date"))
    taken = _taken(spark, target, by)
    new = batches.join(taken, [QUERY_COLUMN, BATCH_COLUMN, by], "left_anti")
    run = f"run={uuid.uuid4().hex}"
    rows = new.drop(QUERY_COLUMN, BATCH_COLUMN).hint("rebalance", by)
    rows.write.partitionBy(by).parquet(f"{target}/rows/{run}")
    names = new.select(QUERY_COLUMN, BATCH_COLUMN, by).distinct().coalesce(1)
    names.write.parquet(f"{target}/folders/{run}")


def _folders(spark: SparkSession, path: str, by: str) -> DataFrame:
    """A batch table with the names of the folders that its rows are in."""
    rows = spark.read.parquet(path)
    kinds = {QUERY_COLUMN: "string", BATCH_COLUMN: "long", by: "date"}
    return rows.withColumns({name: F.col(name).cast(kind) for name, kind in kinds.items()})


def _taken(spark: SparkSession, target: str, by: str) -> DataFrame:
    """The folders that finished runs of :func:`compact` took, and the ``run``."""
    schema = f"{QUERY_COLUMN} string, {BATCH_COLUMN} long, {by} date, run string"
    try:
        return spark.read.schema(schema).parquet(f"{target}/folders")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_compacted(spark: SparkSession, path: str, target: str, by: str = "dt") -> DataFrame:
    """Every row of a batch table once: what was compacted from ``target``, all else from the batches."""
    taken = _taken(spark, target, by)
    batches = _folders(spark, path, by).join(taken, [QUERY_COLUMN, BATCH_COLUMN, by], "left_anti")
    batches = batches.drop(QUERY_COLUMN, BATCH_COLUMN)
    runs = taken.select("run").distinct()
    if runs.isEmpty():
        return batches
    rows = spark.read.option("mergeSchema", "true").parquet(f"{target}/rows")
    rows = rows.withColumn("run", F.col("run").cast("string")).join(runs, "run", "left_semi").drop("run")
    return rows.unionByName(batches, allowMissingColumns=True)


def remove_compacted(spark: SparkSession, path: str, target: str, by: str = "dt") -> int:
    """Remove the batch folders that finished runs took; how many were still there.

    Call it when no reader has listed the table and still reads it. A batch that is tried
    again afterwards comes back with the same rows, which are known as taken.
    """
    removed = 0
    for row in _taken(spark, target, by).select(QUERY_COLUMN, BATCH_COLUMN, by).distinct().toLocalIterator():
        folder = f"{path.rstrip('/')}/{QUERY_COLUMN}={row[0]}/{BATCH_COLUMN}={row[1]}/{by}={row[2]}"
        name = spark._jvm.org.apache.hadoop.fs.Path(folder)
        removed += name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)
    return removed


def write_batch(
    df: DataFrame,
    path: str,
    batch_id: int,
    *,
    fmt: str | None = None,
    partition_by: Sequence[str] = (),
    rebalance: bool = False,
) -> None:
    """Write one micro-batch of a stream so that writing it again changes nothing.

    A file table has a folder per stream and batch, which a retry overwrites; Delta skips
    a batch that its transaction log already has. A skipped write runs nothing, so counts
    must not be taken from it. ``rebalance`` is that of :func:`write_table`.
    """
    spark = df.sparkSession
    fmt = fmt or table_format(spark)
    if rebalance and partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "delta":
        options = {"txnAppId": stream_id(spark), "txnVersion": batch_id}
        writer.mode("append").options(**options).save(path)
    else:
        # The whole folder is replaced, also where the session overwrites partitions one by one.
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.save(batch_folder(spark, path, batch_id))


def has_batch(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether a file table has the folder of a micro-batch, from this or an earlier try."""
    try:
        spark.read.parquet(batch_folder(spark, path, batch_id))
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def topic_rows(df: DataFrame, topic: str | None = None, n: int = TOPIC_PARTITIONS) -> DataFrame:
    """``key`` and ``value`` rows in the full Kafka row form, for a topic folder.

    Columns the frame has are kept, ``headers`` too. Otherwise the partition is the one a
    client would choose for the key, the time is now, and the offset is NULL, as no broker
    numbers the rows of a folder.
    """
    absent = {
        "key": F.lit(None),
        "topic": F.lit(topic),
        "partition": client_partition(F.col("key"), F.col("value"), n) if "key" in df.columns else F.lit(0),
        "offset": F.lit(None),
        "timestamp": F.current_timestamp(),
        "timestampType": F.lit(0),
    }
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else absent[f.name]).cast(f.dataType).alias(f.name)
            for f in (KAFKA_SCHEMA if "headers" not in df.columns else KAFKA_WITH_HEADERS)
        ]
    )


def sink_options(
    topic: str, options: Mapping[str, str] | None = None, env: Mapping[str, str] | None = None
) -> dict[str, str]:
    """The options of a Kafka sink: the connection of ``env``, the topic, and further ones."""
    connection = {
        key: text
        for key, text in kafka_options(env).items()
        if key.startswith("kafka.") and key != "kafka.client.id"
    }
    return connection | {"topic": topic} | dict(options or {})


def write_kafka(
    df: DataFrame,
    topic: str,
    *,
    folder: str | None = None,
    options: dict[str, str] | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    env: Mapping[str, str] | None = None,
) -> StreamingQuery | None:
    """Append keyed messages to a topic: Kafka, or a topic folder when one is given.

    A streaming frame needs a checkpoint and gives back its query. The connection is that
    of ``env`` (the process's environment by default). ``options`` are passed through, so
    ``kafka.*`` sets batching, compression and idempotence of the client.
    """
    if df.isStreaming and checkpoint is None:
        raise ValueError("a streaming topic sink needs a checkpoint")
    if folder is not None:
        if df.isStreaming:

            def append(batch: DataFrame, batch_id: int) -> None:
                write_batch(topic_rows(batch, topic), folder, batch_id, fmt="parquet")

            return run_batches(df, append, checkpoint, trigger)
        topic_rows(df, topic).write.mode("append").parquet(folder)
        return None
    chosen = sink_options(topic, options, env)
    if not df.isStreaming:
        df.write.format("kafka").options(**chosen).save()
        return None
    stream = df.writeStream.format("kafka").outputMode("append").options(**chosen)
    stream = stream.option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).start()


def write_dlq(
    df: DataFrame,
    form: str = "json",
    *,
    topic: str = DLQ_TOPIC,
    writer_id: int = 1,
    raw_as: str = "hex",
    folder: str | None = None,
    batch_id: int | None = None,
    env: Mapping[str, str] | None = None,
) -> None:
    """Send failed messages (Kafka columns and ``error``) to the dead-letter topic.

    In a topic folder, ``batch_id`` makes the write repeatable (see :func:`write_batch`);
    in Kafka, the letters of a batch that is tried again are there twice, under the same
    names: ``letters_once`` reads each once.
    """
    letters = dlq_messages(df, form, topic=topic, writer_id=writer_id, raw_as=raw_as)
    if folder is not None and batch_id is not None:
        write_batch(topic_rows(letters), folder, batch_id, fmt="parquet")
    else:
        write_kafka(letters, topic, folder=folder, env=env)
