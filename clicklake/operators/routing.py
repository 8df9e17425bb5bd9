"""Good and bad rows: every row of the input is in exactly one part of a split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import encode_avro


def split_decoded(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded messages, and messages that need a dead letter (with their ``error``)."""
    return df.filter(F.col("error").isNull()).drop("error"), df.filter(F.col("error").isNotNull())


def split_encodable(
    df: DataFrame, schema_json: str, writer_id: int
) -> tuple[DataFrame, DataFrame]:
    """Rows with their framed ``value``, and rows that do not fit the record."""
    encoded = encode_avro(df, schema_json, writer_id)
    fits = F.col("encode_error").isNull()
    return encoded.filter(fits).drop("encode_error"), encoded.filter(~fits).drop("value")


def require_record(df: DataFrame) -> DataFrame:
    """Stop the job on a row without any value, such as an empty record."""
    present = reduce(lambda a, b: a | b, [F.col(f"`{name}`").isNotNull() for name in df.columns])
    stop = F.raise_error("expected a record, got an empty row").cast("boolean")
    return df.filter(F.when(present, F.lit(True)).otherwise(stop))
