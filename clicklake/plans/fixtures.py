"""Click and user events made from the ``events`` table, as rows and as messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import CLICK_STREAM_V1, USER_EVENT_V1, USER_EVENT_V2, USER_EVENT_V3
from ..functions.wire import message_key
from ..operators.codec import encode_avro
from ..sources.settings import DEFAULT_TOPIC

CLICK_ID = 7
USER_EVENT_IDS = {1: 101, 2: 102, 3: 103}
CLICK_SCHEMAS = {CLICK_ID: CLICK_STREAM_V1}
USER_EVENT_SCHEMAS = {101: USER_EVENT_V1, 102: USER_EVENT_V2, 103: USER_EVENT_V3}

CUT_BYTES = 9


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


CLICK_COLUMNS = (
    "concat('event_', event_id) AS event_id",
    "concat('user_', user_id) AS user_id",
    "concat('session_', user_id, '_', date_format(ts, 'yyyyMMdd')) AS session_id",
    "concat('/p/', get_json_object(props, '$.k')) AS url",
    "event_type",
    "element_at(array('mobile', 'Desktop', 'tablets'), cast(user_id % 3 AS int) + 1) AS device",
    "concat('https://r', event_id % 7, '.example/') AS referrer",
    "unix_millis(cast(ts AS timestamp)) AS timestamp",
)


def clicks(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """The click records, and ``extra`` expressions over ``events``."""
    return events(spark, sf_dir).selectExpr(*CLICK_COLUMNS, *extra)


def kafka_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed clicks in the Kafka row form; every tenth message is cut short."""
    rows = clicks(
        spark,
        sf_dir,
        "event_id AS number",
        "cast(event_id % 12 AS int) AS partition",
        "event_id div 12 AS offset",
        "cast(ts AS timestamp) AS sent",
    )
    framed = encode_avro(rows, CLICK_STREAM_V1, CLICK_ID)
    cut = F.when(F.col("number") % 10 == 0, F.substring("value", 1, CUT_BYTES))
    return framed.select(
        message_key(F.col("session_id")).alias("key"),
        cut.otherwise(F.col("value")).alias("value"),
        F.lit(DEFAULT_TOPIC).alias("topic"),
        "partition",
        "offset",
        F.col("sent").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events, each to be written with one of three record versions."""
    return events(spark, sf_dir).selectExpr(
        "event_id",
        "cast(event_id % 3 + 1 AS int) AS version",
        "unix_millis(cast(ts AS timestamp)) AS timestamp",
        "user_id",
        "concat('session_', user_id, '_', date_format(ts, 'yyyyMMdd')) AS session_id",
        "event_type",
        "concat('/p/', get_json_object(props, '$.k')) AS page",
        "concat('https://r', event_id % 7, '.example/') AS referrer",
        "concat('ua/', event_id % 5) AS user_agent",
        "CASE WHEN event_id % 3 >= 1 THEN 'bypass-process' END AS user_process",
        "CASE WHEN event_id % 3 = 2 THEN 'bypass' END AS route",
    )


def user_event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id`` and the framed message, written with the version of the row."""
    rows = user_events(spark, sf_dir)
    for version, writer_id in USER_EVENT_IDS.items():
        schema = USER_EVENT_SCHEMAS[writer_id]
        rows = encode_avro(rows, schema, writer_id, output=f"v{version}")
    value = F.when(F.col("version") == 1, F.col("v1")).when(F.col("version") == 2, F.col("v2"))
    return rows.select("event_id", value.otherwise(F.col("v3")).alias("value"))
