"""Event time and event date from an epoch-millisecond field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds of 0001-01-01 and 9999-12-31: outside them a timestamp has no date, and far
# outside the conversion itself overflows and would stop the job.
FIRST_SECOND = -62_135_596_800
LAST_SECOND = 253_402_300_799


def event_time(millis: Column, precision: str = "s") -> Column:
    """The instant of an epoch-millisecond BIGINT, cut to whole seconds by default.

    Seconds are cut toward zero. ``precision="ms"`` keeps the milliseconds. A number
    outside the years 1 to 9999 gives NULL, as does NULL.
    """
    number = millis.cast("long")
    seconds = F.call_function("div", number, F.lit(1000))
    if precision == "s":
        instant = F.timestamp_seconds(seconds)
    elif precision == "ms":
        instant = F.timestamp_millis(number)
    else:
        raise ValueError(f"precision is 's' or 'ms', not {precision!r}")
    return F.when(seconds.between(FIRST_SECOND, LAST_SECOND), instant)


def with_event_time(df: DataFrame, field: str = "timestamp", precision: str = "s") -> DataFrame:
    """Add ``event_time`` if the frame has the epoch-millisecond field."""
    if field not in df.columns:
        return df
    return df.withColumn("event_time", event_time(F.col(f"`{field}`"), precision))


def with_dt(df: DataFrame) -> DataFrame:
    """Add ``dt``, the date of ``event_time`` in the session time zone."""
    if "event_time" not in df.columns:
        raise ValueError("dt needs an event_time column; the record has no timestamp field")
    return df.withColumn("dt", F.to_date("event_time"))


def now_millis() -> Column:
    """The current time in epoch milliseconds."""
    return F.unix_millis(F.current_timestamp())
