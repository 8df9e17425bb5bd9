"""The ingest stream: messages in; lake table, dead letters and late rows out."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.storagelevel import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.derive import event_time, with_dt
from ..functions.records import DLQ_TOPIC
from ..operators.codec import decode_avro, flatten
from ..operators.late import DEFAULT_DELAY, is_late
from ..sources.lake import BATCH_COLUMN, batch_folder, stream_folder
from .sinks import has_batch, run_batches, write_batch, write_dlq


class RowsLost(RuntimeError):
    """The source no longer had all rows of a batch while it was written."""


@dataclass
class Ingest:
    """What to do with each micro-batch.

    Good rows are appended to ``table`` with ``event_time`` and ``dt`` (and partitioned
    by ``dt``), failed messages to the dead-letter topic. With ``late``, rows older than
    the newest time of all earlier batches minus ``delay`` go to that table instead.
    ``progress`` keeps one row per batch: its counts, the newest time so far, and when it
    was ``committed``.

    Every output of a batch replaces what an earlier try of the same batch wrote, so a
    restart neither loses nor doubles rows. Several streams may share their outputs.
    ``rebalance`` brings the rows of a date together before they are written, which takes a
    shuffle and leaves few files. ``env`` has the connection of the dead-letter topic.

    ``schemas`` may be a function, called once per batch, so that schemas registered later
    are found without a restart; a ``reader`` then keeps the columns of the table the same.
    """

    schemas: DataFrame | dict[int, str] | Callable[[], DataFrame | dict[int, str]]
    table: str
    dead_letters: str | None
    progress: str
    reader: str | None = None
    late: str | None = None
    delay: str = DEFAULT_DELAY
    timestamp_field: str = "timestamp"
    precision: str = "s"
    keep_kafka: bool = False
    fmt: str | None = None
    dlq_form: str = "json"
    dlq_topic: str = DLQ_TOPIC
    dlq_schema_id: int = 1
    dlq_raw_as: str = "hex"
    null_string_default: bool = False
    codec: str = "auto"
    rebalance: bool = False
    env: Mapping[str, str] | None = None

    def start(self, messages: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Start the stream over messages in the Kafka row form."""
        return run_batches(messages, self.process, checkpoint, trigger)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Route one micro-batch.

        The batch is read and decoded once and kept on the executors, in memory or on
        their disks. It is counted first, by an action of its own, as a write that a
        transaction log already has runs nothing. Kept rows of a lost executor are read
        again, and the source may no longer have them (``failOnDataLoss=false``): the batch
        is counted again after the writes, and if rows are gone, it fails and stays uncommitted.
        """
        started = time.monotonic()
        spark = batch.sparkSession
        before = newest_before(spark, self.progress, batch_id)
        routed = self._routed(batch, before)
        partitions = ["dt"] if "_event_time" in routed.columns else []
        good, late = F.col("error").isNull(), F.col("_late")
        routed.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counts = self._count(routed, bool(partitions))
            self._append(routed.filter(good & ~late), self.table, batch_id, partitions)
            if self._due(spark, self.dead_letters, batch_id, counts["bad"]):
                self._write_letters(routed.filter(~good), batch_id)
            if self._due(spark, self.late, batch_id, counts["late"]):
                self._append(routed.filter(good & late), self.late, batch_id, ["dt"])
            now = self._count(routed, bool(partitions))
        finally:
            routed.unpersist()
        if now != counts:
            raise RowsLost(f"batch {batch_id} had {counts} before it was written and {now} after")
        self._record(spark, batch_id, counts, before, time.monotonic() - started)

    def _count(self, routed: DataFrame, timed: bool) -> dict:
        return routed.agg(*self._counts(timed)).first().asDict()

    @staticmethod
    def _counts(timed: bool) -> list:
        newest = F.unix_micros(F.max("_event_time")) if timed else F.lit(None).cast("long")
        return [
            F.count(F.lit(1)).alias("events"),
            F.count("error").alias("bad"),
            F.count(F.when(F.col("error").isNull() & F.col("_late"), 1)).alias("late"),
            newest.alias("newest"),
        ]

    def _due(self, spark: SparkSession, folder: str | None, batch_id: int, rows: int) -> bool:
        """Whether there are rows to write, or rows of an earlier try to replace.

        A second try can find fewer failed messages, if their schema came in between.
        """
        return rows > 0 or (folder is not None and has_batch(spark, folder, batch_id))

    def _write_letters(self, rows: DataFrame, batch_id: int) -> None:
        write_dlq(
            rows,
            self.dlq_form,
            topic=self.dlq_topic,
            writer_id=self.dlq_schema_id,
            raw_as=self.dlq_raw_as,
            folder=self.dead_letters,
            batch_id=batch_id,
            env=self.env,
        )

    def _routed(self, batch: DataFrame, before) -> DataFrame:
        schemas = self.schemas() if callable(self.schemas) else self.schemas
        decoded = decode_avro(
            batch, schemas, self.reader, null_string_default=self.null_string_default, codec=self.codec
        )
        late = F.lit(False)
        if self.timestamp_field in decoded.schema["data"].dataType.names:
            time_column = event_time(F.col("data")[self.timestamp_field], self.precision)
            decoded = decoded.withColumn("_event_time", time_column)
            if self.late and before is not None:
                newest = F.timestamp_micros(F.lit(before))
                late = is_late(F.col("_event_time"), newest, self.delay)
        return decoded.withColumn("_late", late)

    def _append(self, rows: DataFrame, path: str, batch_id: int, partitions: list[str]) -> None:
        if partitions:
            timed = F.col("data").withField("event_time", F.col("_event_time"))
            rows = rows.withColumn("data", timed)
        records = flatten(rows, keep_kafka=self.keep_kafka)
        if partitions:
            records = with_dt(records)
        write_batch(
            records, path, batch_id, fmt=self.fmt, partition_by=partitions, rebalance=self.rebalance
        )

    def _record(self, spark, batch_id: int, counts: dict, before, seconds: float) -> None:
        newest = max((t for t in (before, counts["newest"]) if t is not None), default=None)
        good = counts["events"] - counts["bad"] - counts["late"]
        row = {
            "events": F.lit(counts["events"]).cast("long"),
            "good": F.lit(good).cast("long"),
            "bad": F.lit(counts["bad"]).cast("long"),
            "late": F.lit(counts["late"]).cast("long"),
            "max_seen": F.timestamp_micros(F.lit(newest).cast("long")),
            "seconds": F.lit(seconds),
            "committed": F.current_timestamp(),
        }
        line = spark.range(1, numPartitions=1).select(*[c.alias(n) for n, c in row.items()])
        write_batch(line, self.progress, batch_id, fmt="parquet")


def newest_before(spark: SparkSession, progress: str, batch_id: int) -> int | None:
    """The newest event time of the stream's batches before ``batch_id``, in epoch microseconds.

    Each progress row carries the newest time so far, so the row of the batch before is
    enough; all rows of the stream are read only if that one is missing.
    """
    if batch_id == 0:
        return None
    newest = F.unix_micros(F.max("max_seen"))
    every = stream_folder(spark, progress)
    for path in (batch_folder(spark, progress, batch_id - 1), every):
        try:
            rows = spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if path == every:
            rows = rows.filter(F.col(BATCH_COLUMN) < batch_id)
        return rows.agg(newest).first()[0]
    return None


def read_progress(spark: SparkSession, progress: str) -> DataFrame:
    """The progress table: the counts of every batch, by ``query_id`` and ``batch_id``."""
    return spark.read.parquet(progress)
