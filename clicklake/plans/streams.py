"""Registered queries of state, letters, deliveries, catalog tables and run logs, with their SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

from ..functions.records import CLICK_STREAM_V1
from ..operators.codec import decode_avro, encode_avro
from ..operators.keys import TOPIC_PARTITIONS, to_kafka_rows
from ..operators.letters import letters_once
from ..operators.routing import split_decoded
from ..operators.summary import ingest_totals
from ..operators.windows import first_arrivals, window_counts
from ..sources.events import read_events
from ..sources.lake import shared_folder
from ..streaming.delivery import Delivery, read_delivery
from ..streaming.ingest import Ingest, read_progress
from ..streaming.progress import RunLog, dropped_rows, read_runs
from ..streaming.sinks import (
    await_end,
    run_batches,
    stream_to_table,
    write_catalog_table,
    write_dlq,
    write_kafka,
    write_stream,
)
from .bronze import bronze
from .catalogue import DLQ_JSON, EVENT_ID, SESSION, query
from .fixtures import CLICK_ID, CLICK_SCHEMAS, clicks, kafka_rows

ONCE = {"availableNow": True}
# Of the rows of a stream, these are held back and arrive after all others.
HELD = "event_id % 10 = 3"


def _framed(spark, sf_dir, *extra):
    return encode_avro(clicks(spark, sf_dir, *extra), CLICK_STREAM_V1, CLICK_ID)


def _arrived(spark, folder, rows) -> None:
    write_kafka(to_kafka_rows(rows), "clicks", folder=folder)


# --- State under the watermark ----------------------------------------------------------

_TIMED = f"""timed AS (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS s, {HELD} AS held FROM events),
  marks AS (SELECT max(s) FILTER (NOT held) - 86400 AS before, max(s) - 86400 AS after FROM timed)"""


@query(
    f"""WITH {_TIMED}
        SELECT event_type, (s // 3600) * 3600 AS start_s, (s // 3600 + 1) * 3600 AS end_s, count(*) AS events
        FROM timed, marks WHERE CASE WHEN (s // 3600 + 1) * 3600 <= before THEN NOT held
          ELSE (s // 3600 + 1) * 3600 <= after END GROUP BY ALL"""
)
def stream_window_counts(spark, sf_dir):
    """Events per hour and type, each hour given out once, when the watermark has passed it.

    The earlier half of the events arrives, then the later half, then those held back: they
    are only counted in hours that were still open.
    """
    topic, base = shared_folder(spark, "topic"), shared_folder(spark, "windows")
    rows = _framed(spark, sf_dir, "event_id AS number")
    held = F.col("number") % 10 == 3
    middle = rows.agg(F.expr("CAST(avg(timestamp) AS BIGINT)")).scalar()
    early = F.col("timestamp") <= middle
    for arriving in (~held & early, ~held & ~early, held):
        _arrived(spark, topic, rows.filter(arriving))
        good, _ = bronze(read_events(spark, topic), CLICK_SCHEMAS)
        counts = window_counts(good, "1 hour", ["event_type"])
        await_end(write_stream(counts, f"{base}/table", f"{base}/checkpoint", fmt="parquet", trigger=ONCE))
    counts = spark.read.parquet(f"{base}/table")
    edges = {f"{name}_s": F.unix_seconds(name) for name in ("start", "end")}
    return counts.select("event_type", *[column.alias(name) for name, column in edges.items()], "events")


def _sent_again(spark, sf_dir):
    """All events but those held back; then all of them, once more. The table, and what was dropped."""
    topic, base = shared_folder(spark, "topic"), shared_folder(spark, "arrivals")
    rows = _framed(spark, sf_dir, "event_id AS number")
    dropped = 0
    for arriving in (rows.filter("number % 10 <> 3"), rows):
        _arrived(spark, topic, arriving)
        good, _ = bronze(read_events(spark, topic), CLICK_SCHEMAS)
        stream = write_stream(first_arrivals(good), f"{base}/table", f"{base}/checkpoint", fmt="parquet", trigger=ONCE)
        await_end(stream)
        dropped += dropped_rows(stream)
    return spark.read.parquet(f"{base}/table"), dropped


@query(f"WITH {_TIMED} SELECT {EVENT_ID} AS event_id FROM timed, marks WHERE NOT held OR s > before")
def stream_first_arrivals(spark, sf_dir):
    """Each event once: what is sent again is dropped, by its key or as older than the watermark."""
    return _sent_again(spark, sf_dir)[0].select("event_id")


@query(
    f"""WITH {_TIMED}
        SELECT count(*) FILTER (NOT held OR s > before) AS kept, count(*) FILTER (s <= before) AS dropped
        FROM timed, marks"""
)
def stream_dropped_rows(spark, sf_dir):
    """How many rows the watermark dropped, as the stream's own progress tells."""
    table, dropped = _sent_again(spark, sf_dir)
    return table.agg(F.count(F.lit(1)).alias("kept"), F.lit(dropped).cast("long").alias("dropped"))


# --- Letters, partitions, deliveries ----------------------------------------------------

_LETTERS = """SELECT CAST(event_id % 12 AS INTEGER) AS partition, event_id // 12 AS "offset"
    FROM events WHERE event_id % 10 = 0"""


def _letters_sent_twice(spark, sf_dir) -> str:
    """The letters of one batch, sent twice as Kafka would have them after a retry."""
    _, bad = split_decoded(decode_avro(kafka_rows(spark, sf_dir), CLICK_SCHEMAS, fields=["event_id"]))
    folder = shared_folder(spark, "dead-letters")
    for _ in range(2):
        write_dlq(bad, "json", folder=folder)
    return folder


def _coordinates(letters):
    letter = F.from_json(F.col("value").cast("string"), DLQ_JSON)
    return letters.select(letter.alias("letter")).select("letter.partition", "letter.offset")


@query(_LETTERS)
def letters_read_once(spark, sf_dir):
    letters = read_events(spark, _letters_sent_twice(spark, sf_dir), streaming=False, headers=True)
    return _coordinates(letters_once(letters))


@query(_LETTERS)
def stream_letters_once(spark, sf_dir):
    """The same by a stream, which remembers the names of letters under a watermark."""
    letters = read_events(spark, _letters_sent_twice(spark, sf_dir), {"maxFilesPerTrigger": "1000"}, headers=True)
    base = shared_folder(spark, "letters")
    once = _coordinates(letters_once(letters))
    await_end(write_stream(once, f"{base}/table", f"{base}/checkpoint", fmt="parquet", trigger=ONCE))
    return spark.read.parquet(f"{base}/table")


# The CRC-32 of an ASCII text, bit by bit; 3988292384 is the reflected polynomial.
def _crc_sql(text: str) -> str:
    bits = "list_reduce(list_concat([xor(crc, byte)], range(8)), lambda r, i: xor(r >> 1, (r & 1) * 3988292384))"
    bytes_ = f"[CAST(ord(c) AS BIGINT) FOR c IN string_split({text}, '')]"
    start = "list_concat([CAST(4294967295 AS BIGINT)], "
    return f"xor(list_reduce({start}{bytes_}), lambda crc, byte: {bits}), 4294967295)"


_CLIENT_PARTITION = f"CAST({_crc_sql('message_key')} % {TOPIC_PARTITIONS} AS INTEGER)"


@query(
    f"""SELECT event_id, message_key, {_CLIENT_PARTITION} AS partition
        FROM (SELECT {EVENT_ID} AS event_id, {SESSION} AS message_key FROM events)"""
)
def client_partitions(spark, sf_dir):
    """Each message in the topic partition that a client's producer would choose for its key."""
    folder = shared_folder(spark, "topic")
    write_kafka(to_kafka_rows(_framed(spark, sf_dir), partitions=TOPIC_PARTITIONS), "clicks", folder=folder)
    messages = decode_avro(read_events(spark, folder, streaming=False), CLICK_SCHEMAS, fields=["event_id"])
    return messages.select("data.event_id", F.col("key").cast("string").alias("message_key"), "partition")


@query(
    f"""SELECT partition, count(*) AS rows, 1 AS errors
        FROM (SELECT {_CLIENT_PARTITION} AS partition FROM (SELECT {SESSION} AS message_key FROM events))
        GROUP BY partition"""
)
def delivered_rows(spark, sf_dir):
    """What each topic partition took of a stream whose first try fails, and the failed tries."""
    topic, base = shared_folder(spark, "topic"), shared_folder(spark, "delivery")
    _arrived(spark, topic, _framed(spark, sf_dir))
    messages = read_events(spark, topic).select("key", "value")
    # A file system that Spark does not know refuses the first try.
    for folder in ("nowhere://topic", f"{base}/sent"):
        delivery = Delivery("clicks", f"{base}/report", folder=folder)
        try:
            await_end(delivery.start(messages, f"{base}/checkpoint", ONCE))
        except StreamingQueryException:
            if folder != "nowhere://topic":
                raise
    report = read_delivery(spark, f"{base}/report")
    errors = report.filter("error IS NOT NULL").agg(F.count(F.lit(1)).cast("int")).scalar()
    sent = report.filter("error IS NULL").groupBy("partition").agg(F.sum("rows").alias("rows"))
    return sent.withColumn("errors", errors)


# --- Catalog tables ---------------------------------------------------------------------

_DAYS = """SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS events FROM events
    WHERE event_id % 10 <> 0 GROUP BY 1"""


def _days(table):
    return table.groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("events"))


def _table_name(path: str) -> str:
    return "clicks_" + path.rstrip("/").rsplit("-", 1)[-1]


@query(_DAYS)
def catalog_table(spark, sf_dir):
    """Two batches appended to a table that is found by name."""
    good, _ = bronze(kafka_rows(spark, sf_dir), CLICK_SCHEMAS)
    path = shared_folder(spark, "catalog")
    name, half = _table_name(path), F.crc32(F.col("event_id").cast("binary")) % 2
    for rows in (good.filter(half == 0), good.filter(half == 1)):
        write_catalog_table(rows, name, fmt="parquet", path=path, partition_by=["dt"])
    return _days(spark.table(name))


@query(_DAYS)
def stream_to_catalog_table(spark, sf_dir):
    """A stream appended to a table that is found by name, in two runs over one checkpoint."""
    topic, path = shared_folder(spark, "topic"), shared_folder(spark, "catalog")
    name, rows = _table_name(path), kafka_rows(spark, sf_dir)
    for arriving in (F.col("partition") % 2 == 0, F.col("partition") % 2 == 1):
        write_kafka(rows.filter(arriving), "clicks", folder=topic)
        good, _ = bronze(read_events(spark, topic), CLICK_SCHEMAS)
        stream = stream_to_table(
            good, name, f"{path}-checkpoint", fmt="parquet", path=path, partition_by=["dt"], trigger=ONCE
        )
        await_end(stream)
    return _days(spark.table(name))


# --- Bounds, totals and run logs --------------------------------------------------------

FILES = 8


def _ingest(base: str) -> Ingest:
    return Ingest(CLICK_SCHEMAS, f"{base}/clicks", f"{base}/dead-letters", f"{base}/progress")


@query(f"SELECT CAST({FILES} AS BIGINT) AS small_batches, CAST(1 AS BIGINT) AS large_batches, count(*) AS events FROM events")
def stream_bounded_by_bytes(spark, sf_dir):
    """A topic of several files, read in batches of a byte (a file at least) and in one of all bytes."""
    topic = shared_folder(spark, "topic")
    write_kafka(kafka_rows(spark, sf_dir).repartition(FILES), "clicks", folder=topic)
    batches = {}
    for name, most in (("small", "1"), ("large", str(2**40))):
        base = shared_folder(spark, f"ingest-{name}")
        ingest = _ingest(base)
        await_end(ingest.start(read_events(spark, topic, {"maxBytesPerTrigger": most}), f"{base}/checkpoint", ONCE))
        batches[name] = read_progress(spark, ingest.progress)
    count = batches["large"].agg(F.count(F.lit(1))).scalar()
    return batches["small"].agg(
        F.count(F.lit(1)).alias("small_batches"), count.alias("large_batches"), F.sum("events").alias("events")
    )


@query(
    f"""SELECT CAST({2 * FILES} AS BIGINT) AS batches, count(*) AS events, count(*) AS last_total,
        TRUE AS grows FROM events"""
)
def total_over_streams(spark, sf_dir):
    """Two streams side by side, one total: after the last batch of either it is all events."""
    base = shared_folder(spark, "parallel")
    rows = kafka_rows(spark, sf_dir)
    ingest = _ingest(base)

    def run(number: int) -> None:
        topic = f"{base}/topic-{number}"
        write_kafka(rows.filter(F.col("partition") % 2 == number).repartition(FILES), "clicks", folder=topic)
        messages = read_events(spark, topic, {"maxFilesPerTrigger": "1"})
        await_end(ingest.start(messages, f"{base}/checkpoint-{number}", ONCE))

    with ThreadPoolExecutor(2) as both:
        list(both.map(run, range(2)))
    totals = ingest_totals(read_progress(spark, ingest.progress), over_streams=True)
    return totals.agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("events").alias("events"),
        F.max_by("total_events", "committed").alias("last_total"),
        (F.count_distinct("total_events") == F.count(F.lit(1))).alias("grows"),
    )


@query(
    """SELECT 'clean' AS run, count(*) AS events, CAST(2 AS BIGINT) AS batches, FALSE AS failed FROM events
       UNION ALL
       SELECT 'failed', count(*) FILTER (event_id % 12 % 2 = 0), 1, TRUE FROM events"""
)
def run_log(spark, sf_dir):
    """A row for every run when it has ended: one that went through, and one whose second batch fails."""
    base = shared_folder(spark, "runs")
    rows = kafka_rows(spark, sf_dir)
    for number in range(2):
        write_kafka(rows.filter(F.col("partition") % 2 == number).coalesce(1), "clicks", folder=f"{base}/topic")

    def fails(batch, batch_id):
        if batch_id == 1:
            raise ValueError("the second batch is refused")
        batch.write.format("noop").mode("overwrite").save()

    def passes(batch, batch_id):
        batch.write.format("noop").mode("overwrite").save()

    log = RunLog(spark, f"{base}/log")
    names = {}
    spark.streams.addListener(log)
    try:
        for name, process in (("clean", passes), ("failed", fails)):
            messages = read_events(spark, f"{base}/topic", {"maxFilesPerTrigger": "1"})
            stream = run_batches(messages, process, f"{base}/checkpoint-{name}", ONCE)
            names[str(stream.runId)] = name
            try:
                await_end(stream)
            except StreamingQueryException:
                if name == "clean":
                    raise
            log.wait(stream)
    finally:
        spark.streams.removeListener(log)
    name = F.create_map(*[F.lit(text) for pair in names.items() for text in pair])[F.col("run_id")]
    return read_runs(spark, f"{base}/log").select(
        name.alias("run"), "events", "batches", F.col("error").isNotNull().alias("failed")
    )
