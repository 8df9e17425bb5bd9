"""The registered queries, and the same results in plain SQL.

Every query reads whole tables. Tables that a query has to write go to the shared folder
of the session (see ``shared_folder``).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import wire
from ..functions.derive import with_dt, with_event_time
from ..functions.records import CLICK_STREAM_V1, DLQ_V1, USER_EVENT_V1, USER_EVENT_V3
from ..operators.codec import decode_avro, encode_avro, flatten
from ..operators.deadletter import dlq_messages, to_json_value
from ..operators.keys import partition_by_key, to_kafka_rows
from ..operators.late import split_late, with_watermark
from ..operators.routing import require_record, split_decoded, split_encodable
from ..operators.summary import (
    ROWS_OF_TASK,
    daily_totals,
    event_totals,
    ingest_totals,
    preview,
    row_count,
    run_summary,
)
from ..sources.events import mark_latest, read_events
from ..sources.lake import read_table, shared_folder
from ..sources.schemas import latest_schemas, subject_name
from ..streaming.ingest import Ingest, read_progress
from ..streaming.produce import produce
from ..streaming.sinks import (
    await_end,
    write_dlq,
    write_kafka,
    write_stream,
    write_table,
)
from .bronze import bronze
from .fixtures import (
    CLICK_ID,
    CLICK_SCHEMAS,
    USER_EVENT_SCHEMAS,
    clicks,
    events,
    kafka_rows,
    user_event_messages,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FILES_PER_TRIGGER = {"maxFilesPerTrigger": "1000"}
DLQ_ID = 1

# --- SQL of the fixtures ----------------------------------------------------------------
EVENT_ID = "'event_' || event_id"
SESSION = "'session_' || user_id || '_' || strftime(ts, '%Y%m%d')"
URL = "'/p/' || json_extract_string(props, '$.k')"
DEVICE = "CASE user_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'Desktop' ELSE 'tablets' END"
REFERRER = "'https://r' || (event_id % 7) || '.example/'"
MILLIS = "epoch_us(ts) // 1000"
CLICKS_SQL = f"""
SELECT {EVENT_ID} AS event_id, 'user_' || user_id AS user_id, {SESSION} AS session_id,
       {URL} AS url, event_type, {DEVICE} AS device, {REFERRER} AS referrer,
       {MILLIS} AS timestamp
FROM events"""
CUT_ERROR = "body ends inside field event_id"
# ----------------------------------------------------------------------------------------


def query(oracle: str | None = None):
    """Register a query under its function name, with its SQL when there is one."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


# --- Wire format and codec --------------------------------------------------------------


@query(CLICKS_SQL)
def click_records(spark, sf_dir):
    return clicks(spark, sf_dir)


@query(f"SELECT {EVENT_ID} AS event_id, CAST(7 AS BIGINT) AS schema_id, event_type AS body FROM events")
def header_fields(spark, sf_dir):
    message = wire.frame(F.col("event_type").cast("binary"), CLICK_ID)
    rows = clicks(spark, sf_dir).withColumn("value", message)
    return rows.select(
        "event_id",
        wire.schema_id(F.col("value")).alias("schema_id"),
        wire.strip_header(F.col("value")).cast("string").alias("body"),
    )


@query(
    """
    SELECT event_id, CASE WHEN event_id % 12 > 5 THEN event_id % 12 - 5 END AS body_bytes,
           CASE WHEN event_id % 12 > 5 THEN CAST(7 AS BIGINT) END AS schema_id,
           CASE WHEN event_id % 12 <= 5 THEN 'message is too short for a header and a body' END AS reason
    FROM events"""
)
def short_messages(spark, sf_dir):
    rows = encode_avro(clicks(spark, sf_dir, "event_id AS number"), CLICK_STREAM_V1, CLICK_ID)
    cut = F.substring(F.col("value"), F.lit(1), (F.col("number") % 12).cast("int"))
    rows = rows.select(F.col("number").alias("event_id"), cut.alias("value"))
    return rows.select(
        "event_id",
        F.length(wire.strip_header(F.col("value"))).cast("long").alias("body_bytes"),
        wire.schema_id(F.col("value")).alias("schema_id"),
        wire.header_error(F.col("value")).alias("reason"),
    )


def _varint_sql(unsigned: str) -> str:
    return f"""array_to_string([printf('%02X', ((z >> (7 * i)) & 127)
        + CASE WHEN (z >> (7 * i + 7)) > 0 THEN 128 ELSE 0 END)
        FOR i IN range(0, 9) IF i = 0 OR (z >> (7 * i)) > 0], '')""".replace("z >>", f"({unsigned}) >>")


def _string_sql(text: str) -> str:
    return f"{_varint_sql(f'2 * strlen({text})')} || hex({text})"


@query(
    "SELECT event_id, '0000000007' || "
    + " || ".join(
        _string_sql(name)
        for name in ("event_id", "user_id", "session_id", "url", "event_type", "device", "referrer")
    )
    + f" || {_varint_sql('2 * timestamp')} AS message FROM ({CLICKS_SQL})"
)
def avro_bytes(spark, sf_dir):
    framed = encode_avro(clicks(spark, sf_dir), CLICK_STREAM_V1, CLICK_ID)
    return framed.select("event_id", F.hex("value").alias("message"))


@query(CLICKS_SQL)
def avro_roundtrip(spark, sf_dir):
    framed = encode_avro(clicks(spark, sf_dir), CLICK_STREAM_V1, CLICK_ID).select("value")
    good, _ = split_decoded(decode_avro(framed, CLICK_SCHEMAS))
    return flatten(good)


DOCUMENT = """
{"type": "record", "name": "Document", "fields": [
  {"name": "doc_id", "type": "long"}, {"name": "text", "type": ["string", "null"]},
  {"name": "lang", "type": ["null", "string"]}, {"name": "n_chars", "type": "int"}]}
"""


@query("SELECT doc_id, text, lang, CAST(n_chars AS INTEGER) AS n_chars FROM documents")
def avro_roundtrip_documents(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    framed = encode_avro(documents, DOCUMENT, CLICK_ID).select("value")
    good, _ = split_decoded(decode_avro(framed, {CLICK_ID: DOCUMENT}))
    return flatten(good)


@query(f"SELECT event_type, {MILLIS} AS timestamp FROM events")
def avro_two_fields(spark, sf_dir):
    framed = encode_avro(clicks(spark, sf_dir), CLICK_STREAM_V1, CLICK_ID).select("value")
    decoded = decode_avro(framed, CLICK_SCHEMAS, fields=["event_type", "timestamp"])
    return flatten(decoded)


@query(f"SELECT CASE WHEN event_id % 10 <> 0 THEN {EVENT_ID} END AS event_id FROM events")
def undecoded_rows_are_null(spark, sf_dir):
    return flatten(decode_avro(kafka_rows(spark, sf_dir), CLICK_SCHEMAS, fields=["event_id"]))


# --- Schema versions --------------------------------------------------------------------

USER_EVENT_SQL = f"""event_id, {MILLIS} AS timestamp, user_id, {SESSION} AS session_id, event_type,
    {URL} AS page, {REFERRER} AS referrer, 'ua/' || (event_id % 5) AS user_agent"""


@query(
    f"""SELECT {USER_EVENT_SQL},
        CASE WHEN event_id % 3 >= 1 THEN 'bypass-process' ELSE 'null' END AS user_process,
        CASE WHEN event_id % 3 = 2 THEN 'bypass' ELSE 'null' END AS route FROM events"""
)
def schema_evolution(spark, sf_dir):
    messages = user_event_messages(spark, sf_dir)
    decoded = decode_avro(messages, USER_EVENT_SCHEMAS, USER_EVENT_V3)
    return decoded.select("event_id", "data.*")


@query(
    f"""SELECT {USER_EVENT_SQL},
        CASE WHEN event_id % 3 >= 1 THEN 'bypass-process' END AS user_process,
        CASE WHEN event_id % 3 = 2 THEN 'bypass' END AS route FROM events"""
)
def schema_evolution_with_nulls(spark, sf_dir):
    messages = user_event_messages(spark, sf_dir)
    decoded = decode_avro(messages, USER_EVENT_SCHEMAS, USER_EVENT_V3, null_string_default=True)
    return decoded.select("event_id", "data.*")


@query(f"SELECT {USER_EVENT_SQL} FROM events")
def schema_evolution_to_first(spark, sf_dir):
    messages = user_event_messages(spark, sf_dir)
    decoded = decode_avro(messages, USER_EVENT_SCHEMAS, USER_EVENT_V1)
    return decoded.select("event_id", "data.*")


@query(
    """SELECT event_type || '-value' AS subject, max(event_id) AS version,
       arg_max(user_id, event_id) AS schema_id, arg_max(props, event_id) AS schema_json
       FROM events GROUP BY event_type"""
)
def latest_schema_of_subjects(spark, sf_dir):
    """Every event registers its ``props`` as a schema version of its type's topic."""
    registered = events(spark, sf_dir).select(
        subject_name(F.col("event_type")).alias("subject"),
        F.col("event_id").alias("version"),
        F.col("user_id").alias("schema_id"),
        F.col("props").alias("schema_json"),
    )
    return latest_schemas(registered)


@query(
    f"""SELECT event_id, event_type || '-value' AS by_topic, event_type || '-key' AS by_topic_key,
       'clicks.' || {DEVICE} AS by_record,
       event_type || '-clicks.' || {DEVICE} || '-value' AS by_both FROM events"""
)
def subject_names(spark, sf_dir):
    rows = clicks(spark, sf_dir, "event_id AS number")
    topic, record = F.col("event_type"), F.concat(F.lit("clicks."), "device")
    return rows.select(
        F.col("number").alias("event_id"),
        subject_name(topic).alias("by_topic"),
        subject_name(topic, is_key=True).alias("by_topic_key"),
        subject_name(topic, record, "RecordNameStrategy").alias("by_record"),
        subject_name(topic, record, "TopicRecordNameStrategy").alias("by_both"),
    )


# --- Time -------------------------------------------------------------------------------


@query(
    f"""SELECT {EVENT_ID} AS event_id, (epoch_us(ts) // 1000000) * 1000 AS event_ms,
        strftime(ts, '%Y-%m-%d') AS dt FROM events"""
)
def event_times(spark, sf_dir):
    timed = with_dt(with_event_time(clicks(spark, sf_dir)))
    return timed.select(
        "event_id", F.unix_millis("event_time").alias("event_ms"), F.col("dt").cast("string").alias("dt")
    )


@query(f"SELECT {EVENT_ID} AS event_id, {MILLIS} AS event_ms FROM events")
def event_times_in_millis(spark, sf_dir):
    timed = with_event_time(clicks(spark, sf_dir), precision="ms")
    return timed.select("event_id", F.unix_millis("event_time").alias("event_ms"))


_LIMIT = "(SELECT (max(epoch_us(ts)) // 1000000 - 86400) FROM events)"


def _split_late(spark, sf_dir):
    return split_late(with_event_time(clicks(spark, sf_dir)))


@query(f"SELECT {EVENT_ID} AS event_id FROM events WHERE epoch_us(ts) // 1000000 < {_LIMIT}")
def late_rows(spark, sf_dir):
    return _split_late(spark, sf_dir)[1].select("event_id")


@query(f"SELECT {EVENT_ID} AS event_id FROM events WHERE epoch_us(ts) // 1000000 >= {_LIMIT}")
def on_time_rows(spark, sf_dir):
    return _split_late(spark, sf_dir)[0].select("event_id")


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS events,
       CAST(sum(count(*)) OVER (ORDER BY strftime(ts, '%Y-%m-%d')) AS BIGINT) AS total_events
       FROM events GROUP BY 1"""
)
def running_totals(spark, sf_dir):
    totals = daily_totals(with_dt(with_event_time(clicks(spark, sf_dir))))
    return totals.withColumn("dt", F.col("dt").cast("string"))


@query(
    f"""SELECT {EVENT_ID} AS event_id, row_number() OVER (ORDER BY {MILLIS}, {EVENT_ID}) AS total_events
        FROM events"""
)
def running_total_of_each_event(spark, sf_dir):
    rows = clicks(spark, sf_dir).select("event_id", "timestamp")
    totals = event_totals(rows, ["timestamp", "event_id"], shared_folder(spark, "event-totals"))
    return totals.select("event_id", "total_events")


# --- Routing and dead letters -----------------------------------------------------------


@query(f"{CLICKS_SQL} WHERE event_id % 10 <> 0")
def decoded_rows(spark, sf_dir):
    good, _ = split_decoded(decode_avro(kafka_rows(spark, sf_dir), CLICK_SCHEMAS))
    return flatten(good)


CUT_MESSAGE = "'0000000007' || printf('%02x', 2 * strlen('event_' || event_id)) || '657665'"


@query(
    f"""SELECT 'clickstream-topic' AS topic, CAST(event_id % 12 AS INTEGER) AS partition,
        event_id // 12 AS "offset", '{CUT_ERROR}' AS error, {CUT_MESSAGE} AS raw_payload
        FROM events WHERE event_id % 10 = 0"""
)
def dead_letters_avro(spark, sf_dir):
    _, bad = split_decoded(decode_avro(kafka_rows(spark, sf_dir), CLICK_SCHEMAS, fields=["event_id"]))
    letters = dlq_messages(bad, "avro", writer_id=DLQ_ID)
    read, _ = split_decoded(decode_avro(letters.select("value"), {DLQ_ID: DLQ_V1}))
    return flatten(read).drop("timestamp")


@query(
    r"""SELECT event_id // 12 AS "offset", 'b''\x00\x00\x00\x00\x07\x'
        || printf('%02x', 2 * strlen('event_' || event_id)) || 'eve''' AS raw_payload
        FROM events WHERE event_id % 10 = 0"""
)
def dead_letters_as_python_text(spark, sf_dir):
    _, bad = split_decoded(decode_avro(kafka_rows(spark, sf_dir), CLICK_SCHEMAS, fields=["event_id"]))
    letters = dlq_messages(bad, "avro", writer_id=DLQ_ID, raw_as="python")
    read = decode_avro(letters.select("value"), {DLQ_ID: DLQ_V1}, fields=["offset", "raw_payload"])
    return flatten(read)


DLQ_JSON = (
    "error string, source string, raw_value string, topic string, partition int, offset bigint, "
    "key string, timestamp array<bigint>"
)


@query(
    f"""SELECT '{CUT_ERROR}' AS error, 'consumer' AS source, {CUT_MESSAGE} AS raw_value,
        'clickstream-topic' AS topic, CAST(event_id % 12 AS INTEGER) AS partition,
        event_id // 12 AS "offset", {SESSION} AS key, CAST(1 AS BIGINT) AS time_type,
        {MILLIS} AS time_ms FROM events WHERE event_id % 10 = 0"""
)
def dead_letters_json(spark, sf_dir):
    _, bad = split_decoded(decode_avro(kafka_rows(spark, sf_dir), CLICK_SCHEMAS, fields=["event_id"]))
    folder = shared_folder(spark, "dead-letters")
    write_dlq(bad, "json", folder=folder)
    letters = read_events(spark, folder, streaming=False)
    letter = F.from_json(F.col("value").cast("string"), DLQ_JSON)
    return letters.select(letter.alias("letter")).select(
        "letter.error",
        "letter.source",
        "letter.raw_value",
        "letter.topic",
        "letter.partition",
        "letter.offset",
        "letter.key",
        F.col("letter.timestamp")[0].alias("time_type"),
        F.col("letter.timestamp")[1].alias("time_ms"),
    )


def _incomplete_clicks(spark, sf_dir) -> DataFrame:
    rows = clicks(spark, sf_dir, "event_id AS number")
    return rows.withColumn("url", F.when(F.col("number") % 25 != 0, F.col("url"))).drop("number")


@query(f"SELECT {EVENT_ID} AS event_id, 'field url is null' AS error FROM events WHERE event_id % 25 = 0")
def unencodable_rows(spark, sf_dir):
    _, bad = split_encodable(_incomplete_clicks(spark, sf_dir), CLICK_STREAM_V1, CLICK_ID)
    return bad.select("event_id", F.col("encode_error").alias("error"))


@query("SELECT TRUE AS stopped, count(*) FILTER (event_id % 25 <> 0) AS records FROM events")
def null_record_stops_the_job(spark, sf_dir):
    """A table with rows of nulls alone is refused; without them, all of it passes."""
    rows = clicks(spark, sf_dir, "event_id AS number")
    some = F.col("number") % 25 != 0
    rows = rows.select(*[F.when(some, F.col(name)).alias(name) for name in rows.columns])
    stopped = False
    try:
        require_record(rows).write.format("noop").mode("overwrite").save()
    except SparkRuntimeException as refused:
        if refused.getCondition() != "USER_RAISED_EXCEPTION":
            raise
        stopped = True
    passed = require_record(rows.filter("number IS NOT NULL"))
    return passed.agg(F.lit(stopped).alias("stopped"), F.count(F.lit(1)).alias("records"))


@query(CLICKS_SQL)
def required_records(spark, sf_dir):
    return require_record(clicks(spark, sf_dir))


@query(f"{CLICKS_SQL} WHERE event_id % 25 <> 0")
def encodable_rows(spark, sf_dir):
    good, _ = split_encodable(_incomplete_clicks(spark, sf_dir), CLICK_STREAM_V1, CLICK_ID)
    return flatten(decode_avro(good.select("value"), CLICK_SCHEMAS))


@query(
    f"""SELECT CAST(json_object('event_id', {EVENT_ID}, 'user_id', 'user_' || user_id,
        'session_id', {SESSION}, 'url', NULL, 'event_type', event_type, 'device', {DEVICE},
        'referrer', {REFERRER}, 'timestamp', {MILLIS}) AS VARCHAR) AS letter
        FROM events WHERE event_id % 25 = 0"""
)
def unencodable_letters(spark, sf_dir):
    """A record that cannot be written goes to the dead-letter topic as plain JSON."""
    _, bad = split_encodable(_incomplete_clicks(spark, sf_dir), CLICK_STREAM_V1, CLICK_ID)
    letters = to_json_value(bad.drop("encode_error"))
    return letters.select(F.col("value").cast("string").alias("letter"))


# --- Tables, streams and topics ---------------------------------------------------------


def _clicks_table(spark, sf_dir) -> str:
    path = shared_folder(spark, "clicks")
    good, _ = bronze(_framed(spark, sf_dir), CLICK_SCHEMAS)
    write_table(good, path, partition_by=["dt"], rebalance=True)
    return path


def _framed(spark, sf_dir) -> DataFrame:
    return encode_avro(clicks(spark, sf_dir), CLICK_STREAM_V1, CLICK_ID).select("value")


@query("SELECT count(*) AS rows FROM events")
def table_rows(spark, sf_dir):
    return row_count(read_table(spark, _clicks_table(spark, sf_dir)))


@query(f"SELECT * FROM ({CLICKS_SQL}) ORDER BY event_id LIMIT 20")
def table_preview(spark, sf_dir):
    table = read_table(spark, _clicks_table(spark, sf_dir)).drop("event_time", "dt")
    return preview(table, order_by="event_id")


@query(f"{CLICKS_SQL} WHERE strftime(ts, '%Y-%m-%d') = '2024-01-15'")
def one_day(spark, sf_dir):
    table = read_table(spark, _clicks_table(spark, sf_dir))
    return table.filter("dt = DATE'2024-01-15'").drop("event_time", "dt")


def _topic(spark, sf_dir) -> str:
    folder = shared_folder(spark, "topic")
    write_kafka(kafka_rows(spark, sf_dir), "clickstream-topic", folder=folder)
    return folder


@query(
    f"""SELECT event_id, user_id, session_id, url, event_type, device, referrer, timestamp,
        dt FROM (SELECT *, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS dt
                 FROM ({CLICKS_SQL} WHERE event_id % 10 <> 0))"""
)
def stream_append(spark, sf_dir):
    messages = read_events(spark, _topic(spark, sf_dir), FILES_PER_TRIGGER)
    good, _ = bronze(messages, CLICK_SCHEMAS)
    path = shared_folder(spark, "stream")
    stream = write_stream(
        with_watermark(good),
        path,
        partition_by=["dt"],
        trigger={"availableNow": True},
    )
    await_end(stream)
    table = read_table(spark, path).drop("event_time")
    return table.withColumn("dt", F.col("dt").cast("string"))


def _ingested(spark, sf_dir, runs: int = 1) -> Ingest:
    topic, base = _topic(spark, sf_dir), shared_folder(spark, "ingest")
    ingest = Ingest(
        schemas=CLICK_SCHEMAS,
        table=f"{base}/clicks",
        dead_letters=f"{base}/dead-letters",
        progress=f"{base}/progress",
    )
    for _ in range(runs):
        messages = read_events(spark, topic, FILES_PER_TRIGGER)
        await_end(ingest.start(messages, f"{base}/checkpoint", {"availableNow": True}))
    return ingest


@query("SELECT count(*) AS rows FROM events WHERE event_id % 10 <> 0")
def stream_restart(spark, sf_dir):
    """The same stream twice over one checkpoint: the second run adds nothing."""
    return row_count(read_table(spark, _ingested(spark, sf_dir, runs=2).table))


@query(f"SELECT event_type, count(*) AS events FROM events WHERE event_id % 10 <> 0 GROUP BY event_type")
def stream_routed(spark, sf_dir):
    table = read_table(spark, _ingested(spark, sf_dir).table)
    return table.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query(
    """SELECT CAST(event_id % 12 AS INTEGER) AS partition, event_id // 12 AS "offset"
       FROM events WHERE event_id % 10 = 0"""
)
def stream_dead_letters(spark, sf_dir):
    folder = _ingested(spark, sf_dir).dead_letters
    letters = read_events(spark, folder, streaming=False)
    letter = F.from_json(F.col("value").cast("string"), DLQ_JSON)
    return letters.select(letter.alias("letter")).select("letter.partition", "letter.offset")


@query(
    """SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(*) AS BIGINT) AS total_events,
       CAST(count_if(event_id % 10 = 0) AS BIGINT) AS bad FROM events"""
)
def stream_totals(spark, sf_dir):
    """Events of all batches, the last running total, and the dead letters among them."""
    progress = read_progress(spark, _ingested(spark, sf_dir).progress)
    totals = ingest_totals(progress).agg(
        F.sum("events").alias("events"), F.max("total_events").alias("total_events")
    )
    return totals.withColumn("bad", progress.agg(F.sum("bad")).scalar())


_GOOD_LIMIT = "(SELECT max(epoch_us(ts)) // 1000000 - 86400 FROM events WHERE event_id % 10 <> 0)"


@query(
    f"""SELECT route, count(*) AS rows FROM (
          SELECT CASE WHEN event_id % 10 = 0 THEN 'bad'
            WHEN epoch_us(ts) // 1000000 < {_GOOD_LIMIT} THEN 'late' ELSE 'good' END AS route FROM events)
        GROUP BY route"""
)
def stream_accounts(spark, sf_dir):
    """Good, failed and late messages as they were written: together they are the input."""
    topic, base = shared_folder(spark, "topic"), shared_folder(spark, "ingest")
    messages = kafka_rows(spark, sf_dir)
    newest = messages.agg(F.max("timestamp")).scalar()
    first = F.col("timestamp") >= newest - F.expr("INTERVAL 12 HOURS")
    ingest = Ingest(
        schemas=CLICK_SCHEMAS,
        table=f"{base}/clicks",
        dead_letters=f"{base}/dead-letters",
        progress=f"{base}/progress",
        late=f"{base}/late",
    )
    for arriving in (first, ~first):
        write_kafka(messages.filter(arriving), "clickstream-topic", folder=topic)
        stream = ingest.start(read_events(spark, topic), f"{base}/checkpoint", {"availableNow": True})
        await_end(stream)
    written = {
        "good": read_table(spark, ingest.table),
        "bad": read_events(spark, ingest.dead_letters, streaming=False),
        "late": read_table(spark, ingest.late),
    }
    routes = [rows.select(F.lit(name).alias("route")) for name, rows in written.items()]
    return routes[0].unionByName(routes[1]).unionByName(routes[2]).groupBy("route").agg(
        F.count(F.lit(1)).alias("rows")
    )


FILES = 4


@query(f"SELECT CAST({FILES} AS BIGINT) AS batches, count(*) AS events FROM events")
def stream_rate_limited(spark, sf_dir):
    """A topic of several files, of which each batch takes one."""
    topic, base = shared_folder(spark, "topic"), shared_folder(spark, "ingest")
    write_kafka(kafka_rows(spark, sf_dir).repartition(FILES), "clickstream-topic", folder=topic)
    ingest = Ingest(CLICK_SCHEMAS, f"{base}/clicks", f"{base}/dead-letters", f"{base}/progress")
    messages = read_events(spark, topic, {"maxFilesPerTrigger": "1"})
    await_end(ingest.start(messages, f"{base}/checkpoint", {"availableNow": True}))
    progress = read_progress(spark, ingest.progress)
    return progress.agg(F.count(F.lit(1)).alias("batches"), F.sum("events").alias("events"))


@query("SELECT event_id FROM events WHERE event_id % 2 = 1")
def messages_from_latest(spark, sf_dir):
    """A start at the latest position: what was there before is left out."""
    topic = shared_folder(spark, "topic")
    framed = encode_avro(clicks(spark, sf_dir, "event_id AS number"), CLICK_STREAM_V1, CLICK_ID)
    odd = F.col("number") % 2 == 1
    write_kafka(to_kafka_rows(framed.filter(~odd)), "clicks", folder=topic)
    mark = mark_latest(spark, topic, shared_folder(spark, "mark"))
    write_kafka(to_kafka_rows(framed.filter(odd)), "clicks", folder=topic)
    later = read_events(spark, topic, streaming=False, after=mark)
    read = flatten(decode_avro(later, CLICK_SCHEMAS, fields=["event_id"]))
    return read.select(F.expr("CAST(substr(event_id, 7) AS BIGINT)").alias("event_id"))


@query(
    """SELECT CAST(event_id % 12 AS INTEGER) AS partition, event_id // 12 AS "offset", TRUE AS timely
       FROM events WHERE event_id % 10 = 0"""
)
def letter_times(spark, sf_dir):
    """Avro letters carry the time of the failure: after the start of the query, before its end."""
    started, folder = time.time() * 1000, shared_folder(spark, "dead-letters")
    _, bad = split_decoded(decode_avro(kafka_rows(spark, sf_dir), CLICK_SCHEMAS, fields=["event_id"]))
    write_dlq(bad, "avro", folder=folder, writer_id=DLQ_ID)
    letters = flatten(decode_avro(read_events(spark, folder, streaming=False), {DLQ_ID: DLQ_V1}))
    timely = F.col("timestamp").between(int(started) - 1, int(time.time() * 1000) + 1)
    return letters.select("partition", "offset", timely.alias("timely"))


@query("SELECT count(*) AS total_events, TRUE AS took_time FROM events")
def run_times(spark, sf_dir):
    summary = run_summary(read_progress(spark, _ingested(spark, sf_dir).progress))
    return summary.select("total_events", (F.col("total_seconds") > 0).alias("took_time"))


@query(
    f"""SELECT {EVENT_ID} AS event_id, 'event_id,session_id' AS without_time,
        'event_id,timestamp,event_time,dt' AS with_time FROM events"""
)
def projection_by_schema(spark, sf_dir):
    """Event time and date come only with a record that has a time."""
    rows = encode_avro(clicks(spark, sf_dir), CLICK_STREAM_V1, CLICK_ID).select("value")
    columns = {}
    for name, fields in (("without_time", ["event_id", "session_id"]), ("with_time", ["event_id", "timestamp"])):
        good = with_event_time(flatten(decode_avro(rows, CLICK_SCHEMAS, fields=fields)))
        columns[name] = with_dt(good) if "event_time" in good.columns else good
    shown = {name: F.lit(",".join(table.columns)) for name, table in columns.items()}
    return columns["without_time"].select("event_id", *[text.alias(name) for name, text in shown.items()])


@query("SELECT count(*) AS total_events FROM events")
def run_events(spark, sf_dir):
    progress = read_progress(spark, _ingested(spark, sf_dir).progress)
    return run_summary(progress.select("seconds", "events")).select("total_events")


@query(f"SELECT {EVENT_ID} AS event_id FROM events WHERE epoch_us(ts) // 1000000 < {_LIMIT}")
def stream_late_rows(spark, sf_dir):
    """The events of the last half day arrive first, then all others, many of them late."""
    topic, base = shared_folder(spark, "topic"), shared_folder(spark, "ingest")
    framed = encode_avro(clicks(spark, sf_dir), CLICK_STREAM_V1, CLICK_ID)
    newest = clicks(spark, sf_dir).agg(F.max("timestamp")).scalar()
    first = F.col("timestamp") >= newest - 12 * 3600 * 1000
    ingest = Ingest(
        schemas=CLICK_SCHEMAS,
        table=f"{base}/clicks",
        dead_letters=f"{base}/dead-letters",
        progress=f"{base}/progress",
        late=f"{base}/late",
    )
    for arriving in (first, ~first):
        write_kafka(to_kafka_rows(framed.filter(arriving)), "clicks", folder=topic)
        messages = read_events(spark, topic)
        await_end(ingest.start(messages, f"{base}/checkpoint", {"availableNow": True}))
    return read_table(spark, ingest.late).select("event_id")


@query(
    f"""SELECT {MILLIS} AS timestamp, user_id, {URL} AS page,
        CASE WHEN event_id % 3 >= 1 THEN 'bypass-process' ELSE 'null' END AS user_process,
        CASE WHEN event_id % 3 = 2 THEN 'bypass' ELSE 'null' END AS route FROM events"""
)
def stream_evolution(spark, sf_dir):
    """A stream of messages in three schema versions, read as the newest."""
    topic, path = shared_folder(spark, "topic"), shared_folder(spark, "user-events")
    write_kafka(user_event_messages(spark, sf_dir).select("value"), "user-events", folder=topic)
    good, _ = bronze(read_events(spark, topic, FILES_PER_TRIGGER), USER_EVENT_SCHEMAS, USER_EVENT_V3)
    await_end(write_stream(good, path, trigger={"availableNow": True}))
    return read_table(spark, path).select("timestamp", "user_id", "page", "user_process", "route")


def _produced(spark, sf_dir) -> tuple[str, str]:
    topic, letters = shared_folder(spark, "topic"), shared_folder(spark, "dead-letters")
    produce(
        _incomplete_clicks(spark, sf_dir),
        CLICK_STREAM_V1,
        CLICK_ID,
        topic="clicks",
        dlq_topic="clicks.dlq",
        folder=topic,
        dlq_folder=letters,
    )
    return topic, letters


@query(f"SELECT {SESSION} AS message_key, {EVENT_ID} AS event_id FROM events WHERE event_id % 25 <> 0")
def produced_messages(spark, sf_dir):
    messages = read_events(spark, _produced(spark, sf_dir)[0], streaming=False)
    decoded = decode_avro(messages, CLICK_SCHEMAS, fields=["event_id"])
    return decoded.select(F.col("key").cast("string").alias("message_key"), "data.event_id")


@query(f"SELECT {EVENT_ID} AS event_id, {SESSION} AS session_id FROM events WHERE event_id % 25 = 0")
def produced_letters(spark, sf_dir):
    letters = read_events(spark, _produced(spark, sf_dir)[1], streaming=False)
    record = F.from_json(F.col("value").cast("string"), "event_id string, session_id string, url string")
    return letters.select(record.alias("record")).filter("record.url IS NULL").select(
        "record.event_id", "record.session_id"
    )


@query(f"SELECT {SESSION} AS session_id, count(*) AS rows, 1 AS partitions FROM events GROUP BY 1")
def keyed_partitions(spark, sf_dir):
    rows = partition_by_key(clicks(spark, sf_dir).select("session_id", "timestamp", "event_id"))
    one = F.when(F.min("partition") == F.max("partition"), 1)
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("rows"), one.alias("partitions")
    )


@query(
    f"""SELECT {EVENT_ID} AS event_id, row_number() OVER (PARTITION BY {SESSION}
        ORDER BY {MILLIS}, {EVENT_ID}) AS place FROM events"""
)
def keyed_order(spark, sf_dir):
    """Where each event comes out among those of its session, task by task."""
    path = shared_folder(spark, "keyed")
    rows = partition_by_key(clicks(spark, sf_dir).select("session_id", "timestamp", "event_id"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(ROWS_OF_TASK))
    rows.withColumns({"task": F.spark_partition_id(), "at": place}).write.parquet(path)
    placed = spark.read.parquet(path)
    # A session's rows stand together in each of its tasks; only their counts are numbered.
    parts = placed.groupBy("session_id", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("session_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    joined = placed.join(parts, ["session_id", "task"])
    return joined.select("event_id", (F.col("before") + F.col("at") - F.col("first") + 1).alias("place"))


@query(f"SELECT {SESSION} AS message_key, {EVENT_ID} AS event_id, 'clicks' AS topic FROM events")
def keyed_messages(spark, sf_dir):
    framed = encode_avro(clicks(spark, sf_dir), CLICK_STREAM_V1, CLICK_ID)
    folder = shared_folder(spark, "clicks-topic")
    write_kafka(to_kafka_rows(framed), "clicks", folder=folder)
    decoded = decode_avro(
        read_events(spark, folder, streaming=False), CLICK_SCHEMAS, fields=["event_id"]
    )
    return decoded.select(F.col("key").cast("string").alias("message_key"), "data.event_id", "topic")


@query(
    f"""SELECT {EVENT_ID} AS event_id, {SESSION} AS message_key, 'clickstream-topic' AS kafka_topic,
        CAST(event_id % 12 AS INTEGER) AS kafka_partition, event_id // 12 AS kafka_offset,
        {MILLIS} AS sent_ms FROM events WHERE event_id % 10 <> 0"""
)
def message_coordinates(spark, sf_dir):
    good, _ = bronze(kafka_rows(spark, sf_dir), CLICK_SCHEMAS, keep_kafka=True)
    return good.select(
        "event_id",
        F.col("kafka_key").cast("string").alias("message_key"),
        "kafka_topic",
        "kafka_partition",
        "kafka_offset",
        F.unix_millis("kafka_timestamp").alias("sent_ms"),
    )


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS events,
       CAST(sum(count(*)) OVER (ORDER BY strftime(ts, '%Y-%m-%d')) AS BIGINT) AS total_events
       FROM events GROUP BY 1"""
)
def flagship(spark, sf_dir):
    """Messages to table, end to end, and the daily totals of the table."""
    totals = daily_totals(read_table(spark, _clicks_table(spark, sf_dir)).select("dt"))
    return totals.withColumn("dt", F.col("dt").cast("string"))
