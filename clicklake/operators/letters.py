"""Dead letters that are sent more than once, and read once.

A letter is named after the message it is about: the topic, partition and offset that a broker
gave it. The name goes with the letter as a Kafka header, so key and value stay as they are.
A batch that is tried again sends its letters again under the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER_HEADER = "dlq-message"
HEADERS = "array<struct<key:string,value:binary>>"
# For so long after a letter was written, another of its name is taken for the same.
LETTER_DELAY = "24 hours"
COORDINATES = ("topic", "partition", "offset")


def message_name(df: DataFrame) -> Column:
    """``topic/partition/offset`` of each message; NULL where one of them is not known."""
    if not set(COORDINATES) <= set(df.columns):
        return F.lit(None).cast("string")
    topic, partition, offset = (F.col(name).cast("string") for name in COORDINATES)
    return F.concat(topic, F.lit("/"), partition, F.lit("/"), offset)


def letter_headers(df: DataFrame) -> Column:
    """The headers of the letters of messages: the message's name, or none."""
    name = message_name(df)
    named = F.array(F.struct(F.lit(LETTER_HEADER).alias("key"), F.encode(name, "UTF-8").alias("value")))
    return F.when(name.isNotNull(), named).cast(HEADERS)


def letter_name(headers: Column) -> Column:
    """The name that a letter's headers give it; NULL for a letter without one."""
    named = F.filter(headers, lambda header: header["key"] == LETTER_HEADER)
    return F.decode(F.try_element_at(named, F.lit(1))["value"], "UTF-8")


def letters_once(letters: DataFrame, delay: str = LETTER_DELAY) -> DataFrame:
    """Every letter once: of those of one name, the first.

    ``headers`` are needed (see ``read_events``) and stay. Letters without a name, whose
    message had no offset, are all kept: nothing tells two of them from one sent twice. On a
    batch, the earliest letter of a name is taken, whole. On a stream, a name is remembered
    for ``delay`` after its letter's ``timestamp``, so choose it longer than a batch may wait
    to be tried again; named letters older than the watermark are dropped, and the stream's
    progress counts them (see ``dropped_rows``).
    """
    named = letters.withColumn("_letter", letter_name(F.col("headers")))
    without, some = named.filter("_letter IS NULL").drop("_letter"), named.filter("_letter IS NOT NULL")
    if letters.isStreaming:
        once = some.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["_letter"])
        return once.drop("_letter").unionByName(without)
    row = F.struct(*[F.col(f"`{name}`") for name in letters.columns])
    age = F.coalesce(F.unix_micros("timestamp"), F.lit(2**63 - 1))
    first = some.groupBy("_letter").agg(F.min_by(row, age).alias("_row"))
    return first.select("_row.*").unionByName(without)
