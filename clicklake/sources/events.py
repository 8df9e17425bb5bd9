"""Topics: Kafka, or a folder of Parquet files in the Kafka row form."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .settings import kafka_options

KAFKA_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestampType", T.IntegerType()),
    ]
)
_HEADER = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
KAFKA_WITH_HEADERS = T.StructType([*KAFKA_SCHEMA.fields, T.StructField("headers", T.ArrayType(_HEADER))])


def read_events(
    spark: SparkSession,
    source: str = "kafka",
    options: dict[str, str] | None = None,
    *,
    streaming: bool = True,
    latest_since: datetime | None = None,
    after: str | None = None,
    headers: bool = False,
) -> DataFrame:
    """Messages of a topic as a stream or a batch, always in the Kafka row form.

    ``source="kafka"`` reads Kafka with the options of the environment, overridden by
    ``options``; a batch read starts at the earliest offset unless told otherwise.
    Any other source is the path of a topic folder, with file-source options such as
    ``maxFilesPerTrigger`` and ``maxBytesPerTrigger``, which bound a batch. A topic folder
    starts at its first file; ``after`` names a mark (see :func:`mark_latest`), and the files
    that were there when it was made are left out. ``latest_since`` leaves out files by their
    time instead, which needs clocks that agree. ``headers`` adds the messages' headers as a
    column.
    """
    schema = KAFKA_WITH_HEADERS if headers else KAFKA_SCHEMA
    reader = spark.readStream if streaming else spark.read
    if source == "kafka":
        chosen = kafka_options() | ({"includeHeaders": "true"} if headers else {}) | (options or {})
        if not streaming:
            for name in ("maxOffsetsPerTrigger", "minOffsetsPerTrigger", "maxTriggerDelay"):
                chosen.pop(name, None)
            if chosen["startingOffsets"] == "latest":
                chosen["startingOffsets"] = "earliest"
        return reader.format("kafka").options(**chosen).load()
    chosen = {"recursiveFileLookup": "true"} | (options or {})
    rows = reader.format("parquet").schema(schema).options(**chosen).load(source)
    if latest_since is not None:
        rows = rows.filter(F.col("_metadata.file_modification_time") > F.lit(latest_since))
    if after is not None:
        seen = spark.read.schema("_seen string").parquet(after)
        rows = rows.withColumn("_file", F.col("_metadata.file_path"))
        rows = rows.join(seen, F.col("_file") == F.col("_seen"), "left_anti")
    return rows.select(*schema.names)


def mark_latest(spark: SparkSession, folder: str, mark: str) -> str:
    """Note which files a topic folder has now, so that a stream can start after them.

    ``mark`` is a path beside the stream's checkpoint; a mark that is there stays as it is, so
    a restarted job starts where it first did. Nothing hangs on file times or clocks.
    """
    files = spark.read.format("parquet").schema(KAFKA_SCHEMA).option("recursiveFileLookup", "true").load(folder)
    files.select(F.col("_metadata.file_path").alias("_seen")).distinct().write.mode("ignore").parquet(mark)
    return mark
