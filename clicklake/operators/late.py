"""Watermarks and late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_DELAY = "24 hours"


def with_watermark(df: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Declare the watermark; it drops nothing until a stateful operator follows (see ``windows``)."""
    return df.withWatermark("event_time", delay)


def is_late(event_time: Column, max_seen: Column, delay: str = DEFAULT_DELAY) -> Column:
    """True when a row is older than ``max_seen`` minus ``delay``.

    A row without a time, or one seen before any other, is not late.
    """
    return F.coalesce(event_time < max_seen - F.expr(f"INTERVAL {delay}"), F.lit(False))


def split_late(df: DataFrame, delay: str = DEFAULT_DELAY) -> tuple[DataFrame, DataFrame]:
    """On-time and late rows of a batch table, measured from its newest ``event_time``.

    The newest time is a scalar subquery: a second, one-column pass over the table and no
    join.
    """
    newest = df.agg(F.max("event_time")).scalar()
    late = is_late(F.col("event_time"), newest, delay)
    return df.filter(~late), df.filter(late)
