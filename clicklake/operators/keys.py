"""Keyed messages and their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wire import message_key

# Fixed value: partitions of a topic.
TOPIC_PARTITIONS = 12


def client_partition(key: Column, value: Column, n: int = TOPIC_PARTITIONS) -> Column:
    """The topic partition that the default partitioner of librdkafka clients gives a key.

    That is the key's CRC-32 modulo the number of partitions, so rows that Spark writes and
    rows that such clients write meet in one partition. A key that is null or empty has no
    partition of its own: clients choose one at random, and here the value's hash does, so
    that a task that is tried again sends its rows to the same partitions.
    """
    key, value = key.cast("binary"), value.cast("binary")
    keyed = F.octet_length(key) > 0
    return F.when(keyed, F.crc32(key) % n).otherwise(F.pmod(F.xxhash64(value), F.lit(n))).cast("int")


def with_client_partition(
    df: DataFrame, n: int = TOPIC_PARTITIONS, key: str = "key", value: str = "value"
) -> DataFrame:
    """Add (or replace) ``partition``, as :func:`client_partition` chooses it."""
    return df.withColumn("partition", client_partition(F.col(f"`{key}`"), F.col(f"`{value}`"), n))


def to_kafka_rows(
    df: DataFrame, key: str = "session_id", value: str = "value", partitions: int | None = None
) -> DataFrame:
    """``key`` and ``value`` columns for the Kafka sink, and topic columns when present.

    With ``partitions``, the number of the topic's partitions, rows go where a client would
    send them; otherwise Spark's Kafka sink chooses.
    """
    kept = [name for name in ("topic", "partition", "headers") if name in df.columns]
    rows = df.select(message_key(F.col(f"`{key}`")).alias("key"), F.col(f"`{value}`").alias("value"), *kept)
    return with_client_partition(rows, partitions) if partitions else rows


def with_partition(df: DataFrame, n: int = TOPIC_PARTITIONS, key: str = "session_id") -> DataFrame:
    """Add the topic ``partition`` of each row: equal keys always share one.

    The hash is Spark's, so the numbers differ from those a Kafka client would choose (see
    :func:`client_partition`).
    """
    return df.withColumn("partition", F.pmod(F.hash(f"`{key}`"), F.lit(n)))


def partition_by_key(
    df: DataFrame,
    n: int = TOPIC_PARTITIONS,
    key: str = "session_id",
    order_by: Sequence[str] = ("timestamp", "event_id"),
    tasks: int | None = None,
) -> DataFrame:
    """Give rows their topic ``partition`` and put each key's rows in order.

    Rows are range partitioned by (partition, key, order), so a key that holds much of
    the data is spread over several tasks, each with a consecutive part of it: read in
    task order, every key is in order, however large. ``order_by`` should tell the rows
    of a key apart, as equal rows cannot be spread. Spark sorts no streams: on a stream,
    call it on each batch of ``run_batches``.
    """
    order = ["partition", key, *order_by]
    keyed = with_partition(df, n, key)
    ranged = keyed.repartitionByRange(tasks, *order) if tasks else keyed.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)
