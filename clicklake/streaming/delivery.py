"""Delivery reports: what of each batch reached which partition of a topic."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keys import TOPIC_PARTITIONS, with_client_partition
from ..sources.lake import BATCH_COLUMN, QUERY_COLUMN, stream_id
from .sinks import run_batches, topic_rows, write_batch, write_kafka

REPORT = f"{QUERY_COLUMN} string, {BATCH_COLUMN} long, topic string, partition int, rows long, error string, at timestamp"
# An error's text is kept up to so many characters.
ERROR_CHARACTERS = 2000


@dataclass
class Delivery:
    """Sends batches of keyed messages to a topic, and reports each.

    A batch that was written leaves a row per topic partition with the rows it took, counted
    while they were written, without a second pass; a retry replaces them. A batch that failed
    leaves a row with the error, which stays when the batch succeeds later. The error is
    raised again, so that the stream gives the batch to it once more.

    Messages have ``key`` and ``value``, and the ``partition`` a client would choose unless
    they have one. ``partitions`` is the number of the topic's partitions, a count per
    partition being taken; rows for others are reported together, under no partition.
    ``folder`` stands for the topic, as in ``write_kafka``.
    """

    topic: str
    report: str
    partitions: int = TOPIC_PARTITIONS
    folder: str | None = None
    options: dict[str, str] | None = None
    env: Mapping[str, str] | None = None

    def start(self, messages: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Send a stream of messages."""
        return run_batches(messages, self.process, checkpoint, trigger)

    def process(self, batch: DataFrame, batch_id: int) -> dict[int | None, int]:
        """Send one batch; the rows of each partition that took some."""
        spark = batch.sparkSession
        if "partition" not in batch.columns:
            batch = with_client_partition(batch, self.partitions)
        seen = Observation()
        of = {p: F.count_if(F.col("partition") == p).alias(f"p{p}") for p in range(self.partitions)}
        counted = batch.observe(seen, F.count(F.lit(1)).alias("rows"), *of.values())
        try:
            if self.folder is not None:
                write_batch(topic_rows(counted, self.topic), self.folder, batch_id, fmt="parquet")
            else:
                write_kafka(counted, self.topic, options=self.options, env=self.env)
        except Exception as failure:
            self._failed(spark, batch_id, failure)
            raise
        found = seen.get
        rows = {p: found[f"p{p}"] for p in range(self.partitions) if found[f"p{p}"]}
        if others := found["rows"] - sum(rows.values()):
            rows[None] = others
        self._sent(spark, batch_id, rows)
        return rows

    def _lines(self, spark: SparkSession, lines: list[tuple]) -> DataFrame:
        made = spark.createDataFrame(lines, "topic string, partition int, rows long, error string").coalesce(1)
        return made.withColumn("at", F.current_timestamp())

    def _sent(self, spark: SparkSession, batch_id: int, rows: dict[int | None, int]) -> None:
        lines = [(self.topic, p, n, None) for p, n in rows.items()]
        write_batch(self._lines(spark, lines), f"{self.report}/sent", batch_id, fmt="parquet")

    def _failed(self, spark: SparkSession, batch_id: int, failure: Exception) -> None:
        text = f"{type(failure).__name__}: {failure}"[:ERROR_CHARACTERS]
        line = self._lines(spark, [(self.topic, None, None, text)])
        line = line.withColumns({QUERY_COLUMN: F.lit(stream_id(spark)), BATCH_COLUMN: F.lit(batch_id).cast("long")})
        line.write.mode("append").parquet(f"{self.report}/failed")


def read_delivery(spark: SparkSession, report: str) -> DataFrame:
    """The report of all streams and batches: rows per partition, and an error per failed try."""
    found = spark.createDataFrame([], REPORT)
    for part in ("sent", "failed"):
        try:
            rows = spark.read.schema(REPORT).parquet(f"{report}/{part}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found = found.unionByName(rows)
    return found
