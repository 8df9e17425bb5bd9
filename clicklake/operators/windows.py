"""Operators that keep state under the watermark of ``event_time``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .late import DEFAULT_DELAY, with_watermark


def window_counts(
    df: DataFrame, width: str = "1 hour", by: Sequence[str] = (), delay: str = DEFAULT_DELAY
) -> DataFrame:
    """Events per window of ``event_time`` (and per ``by``): the columns of ``by``, ``start``, ``end``, ``events``.

    On a stream in append mode, a window comes out once, when the watermark (the newest
    time of the batches before, minus ``delay``) has reached its end; rows of windows that
    ended before are dropped, and state is one number per open window. On a batch, every
    window comes out. Rows without a time are in no window. Counts are added up before the
    shuffle, so a window of most rows is no hot one.
    """
    width_of = F.window("event_time", width)
    counted = with_watermark(df, delay).groupBy(*by, width_of).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(*by, "window.start", "window.end", "events")


def first_arrivals(df: DataFrame, keys: Sequence[str] = ("event_id",), delay: str = DEFAULT_DELAY) -> DataFrame:
    """Each event once, however often it is sent: the first of the rows of equal ``keys``.

    On a stream, a key is remembered for ``delay`` after its event time, and rows older than
    the watermark are dropped, as their key may be forgotten: state holds the keys of
    ``delay``, not of the whole stream. A row sent again must have the same event time or
    one within ``delay``. On a batch, keys are unique over the whole table.
    """
    if df.isStreaming:
        return with_watermark(df, delay).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))
