"""Counts, previews and run totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREVIEW_ROWS = 20
BATCHES_PER_BUCKET = 10_000
MOST_BROADCAST = 1_000_000

# The lower 33 bits of a monotonically increasing id count the rows of its task.
ROWS_OF_TASK = 2**33 - 1


def row_count(df: DataFrame) -> DataFrame:
    """The number of rows, as one row."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order_by: str | None = None) -> DataFrame:
    """The first ``n`` rows, in no order unless ``order_by`` is given."""
    return (df.orderBy(order_by) if order_by else df).limit(n)


def _running_total(counts: DataFrame, order: str, bucket: Column, group: Sequence[str] = ()) -> DataFrame:
    """Add ``total_events``, the sum of ``events`` up to each row by ``order``, in each group.

    ``bucket`` grows with ``order`` and parts the rows: the total is the sum of all
    buckets before plus the sum so far within the bucket, so that no window holds more
    than the rows of one bucket or one row per bucket.
    """
    # A bucket is joined by its text, as one of no value is a bucket too.
    named = F.coalesce(bucket.cast("string"), F.lit(""))
    rows = counts.withColumns({"_bucket": bucket, "_name": named})
    sums = rows.groupBy(*group, "_name").agg(F.sum("events").alias("_events"), F.first("_bucket").alias("_bucket"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_events").over(earlier), F.lit(0))
    same = {name: f"_same_{name}" for name in (*group, "_name")}
    sums = sums.select(*[F.col(name).alias(other) for name, other in same.items()], before.alias("_before"))
    so_far = Window.partitionBy(*group, "_name").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    matches = [F.col(name).eqNullSafe(F.col(other)) for name, other in same.items() if name in group]
    matches.append(F.col("_name") == F.col(same["_name"]))
    return rows.join(sums, matches).select(
        *counts.columns, (F.col("_before") + F.sum("events").over(so_far)).alias("total_events")
    )


def daily_totals(df: DataFrame, date: str = "dt") -> DataFrame:
    """Events per day, counted before any shuffle, and the running total of days."""
    days = df.groupBy(date).agg(F.count(F.lit(1)).alias("events"))
    return _running_total(days, date, F.trunc(date, "month"))


def ingest_totals(progress: DataFrame, over_streams: bool = False) -> DataFrame:
    """The running event total of each stream after each of its batches.

    Batches of one number of two streams are not of the same moment, so streams
    (``query_id``, where the table has it) are counted apart. ``over_streams`` counts them
    together, in the order in which their batches were ``committed`` (those of one
    microsecond by stream and number): the last total is all events of all streams.
    """
    if over_streams:
        order = F.struct("committed", "query_id", "batch_id").alias("_order")
        batches = progress.select("query_id", "batch_id", "committed", "events", order)
        return _running_total(batches, "_order", F.date_trunc("hour", "committed")).drop("_order")
    group = [name for name in ("query_id",) if name in progress.columns]
    batches = progress.groupBy(*group, "batch_id").agg(F.sum("events").alias("events"))
    bucket = F.call_function("div", F.col("batch_id"), F.lit(BATCHES_PER_BUCKET))
    return _running_total(batches, "batch_id", bucket, group)


def event_totals(
    df: DataFrame, order_by: Sequence[str], folder: str, tasks: int | None = None
) -> DataFrame:
    """Every event with the running total up to it, in the order of ``order_by``.

    The events are sorted over all tasks (``tasks`` of them, if given) and written to
    ``folder`` with their place in their task; the total before a task comes from the
    counts of the tasks. No window holds the events, the written table fixes which task
    each of them was in, and they are shuffled once: the totals, a row of two numbers for
    each of at most ``MOST_BROADCAST`` tasks, go to where the events are. Above that many
    tasks, events and totals are joined as Spark chooses. ``order_by`` should tell all
    events apart.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(ROWS_OF_TASK))
    numbers = [tasks] if tasks else []
    ordered = df.repartitionByRange(*numbers, *order_by).sortWithinPartitions(*order_by)
    placed = ordered.withColumns({"_task": F.spark_partition_id(), "_place": place})
    placed.write.parquet(folder)
    events = df.sparkSession.read.parquet(folder)
    of_tasks = events.groupBy("_task").agg(F.count(F.lit(1)).alias("events"))
    bucket = F.call_function("div", F.col("_task"), F.lit(BATCHES_PER_BUCKET))
    totals = _running_total(of_tasks, "_task", bucket)
    before = totals.select("_task", (F.col("total_events") - F.col("events")).alias("_before"))
    highest = events.agg(F.max("_task")).first()[0] or 0
    if highest < MOST_BROADCAST:
        before = F.broadcast(before)
    total = F.col("_before") + F.col("_place") + 1
    return events.join(before, "_task").select(*df.columns, total.alias("total_events"))


def run_summary(progress: DataFrame) -> DataFrame:
    """Total seconds and total events of a progress table."""
    return progress.agg(
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
    )
