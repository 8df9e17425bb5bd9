import shutil
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clicklake.functions.records import CLICK_STREAM_V1, DLQ_V1, USER_EVENT_V1, USER_EVENT_V3
from clicklake.operators.codec import decode_avro, encode_avro, flatten
from clicklake.operators.late import split_late, with_watermark
from clicklake.plans.bronze import bronze
from clicklake.sources.events import KAFKA_SCHEMA, mark_latest, read_events
from clicklake.sources.lake import as_stream, read_table, stream_id
from clicklake.streaming import ingest as ingest_module
from clicklake.streaming.ingest import Ingest, RowsLost, newest_before, read_progress
from clicklake.streaming.progress import EventTotal, counted, progress_table
from clicklake.streaming.sinks import await_end, compact, read_compacted, remove_compacted, topic_rows, write_dlq, write_kafka, write_stream, write_table

from . import samples

ONCE = {"availableNow": True}
ONE_FILE = {"maxFilesPerTrigger": "1"}
SCHEMAS = {7: CLICK_STREAM_V1}
DDL = ", ".join(f"{n} {'long' if n == 'timestamp' else 'string'}" for n in samples.CLICK)


def millis(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1000)


def add_file(spark, folder, records, broken=0):
    """Append one file with a message per (event_id, time), and broken messages."""
    rows = [tuple((samples.CLICK | {"event_id": name, "timestamp": millis(at)}).values()) for name, at in records]
    good = encode_avro(spark.createDataFrame(rows, DDL), CLICK_STREAM_V1, 7).select("session_id", "value")
    bad = spark.createDataFrame([(f"bad{i}", b"broken") for i in range(broken)], "session_id string, value binary")
    messages = good.union(bad).select(F.col("session_id").cast("binary").alias("key"), "value")
    write_kafka(messages.coalesce(1), "clicks", folder=folder)


@pytest.fixture
def topic(spark, tmp_path):
    folder = str(tmp_path / "topic")
    for day in range(1, 5):
        add_file(spark, folder, [(f"e{day}", f"2024-01-0{day}T00:00:00")] * 3, broken=day % 2)
    return folder


def make(tmp_path, **options):
    base = str(tmp_path)
    return Ingest(SCHEMAS, f"{base}/table", f"{base}/dead", f"{base}/progress", **options)


def run(spark, ingest, topic, tmp_path, options=ONE_FILE):
    stream = ingest.start(read_events(spark, topic, options), f"{tmp_path}/checkpoint", ONCE)
    await_end(stream, 120)
    return stream


def test_append_stream_is_rate_limited_partitioned_and_restartable(spark, topic, tmp_path, plan_of):
    path = str(tmp_path / "table")

    def once():
        good, _ = bronze(read_events(spark, topic, ONE_FILE), SCHEMAS)
        stream = write_stream(with_watermark(good), path, partition_by=["dt"], trigger=ONCE, name="append")
        await_end(stream, 120)
        return stream

    first = once()
    progress = progress_table(spark, first)
    assert progress.filter("events > 0").count() == 4
    assert progress.agg(F.sum("events")).first()[0] == 14
    table = read_table(spark, path)
    assert table.count() == 12 and table.columns == [*samples.CLICK, "event_time", "dt"]
    once()
    assert read_table(spark, path).count() == 12
    add_file(spark, topic, [("new", "2024-01-09T00:00:00")])
    once()
    assert read_table(spark, path).count() == 13
    day = read_table(spark, path).filter("dt = DATE'2024-01-02'")
    assert day.count() == 3
    assert "PartitionFilters: [isnotnull(dt" in plan_of(day, "simple")


def test_ingest_routes_each_message_once(spark, topic, tmp_path):
    ingest = make(tmp_path)
    stream = run(spark, ingest, topic, tmp_path)
    told = progress_table(spark, stream, read_progress(spark, ingest.progress)).filter("events > 0")
    assert [tuple(r) for r in told.orderBy("batch_id").select("events", "delivered").collect()] == [(4, 3), (3, 3)] * 2
    run(spark, ingest, topic, tmp_path)
    table = read_table(spark, ingest.table)
    assert table.count() == 12 and set(table.columns) == {*samples.CLICK, "event_time", "dt"}
    assert read_events(spark, ingest.dead_letters, streaming=False).count() == 2
    progress = read_progress(spark, ingest.progress).orderBy("batch_id").collect()
    assert [(r.events, r.good, r.bad, r.late) for r in progress] == [(4, 3, 1, 0), (3, 3, 0, 0)] * 2
    assert str(progress[-1].max_seen) == "2024-01-04 00:00:00"


def test_failure_between_the_two_writes_loses_and_doubles_nothing(spark, topic, tmp_path, monkeypatch):
    ingest = make(tmp_path, dlq_form="avro", keep_kafka=True)
    calls = []

    def fails_once(*arguments, **options):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("no space")
        write_dlq(*arguments, **options)

    monkeypatch.setattr(ingest_module, "write_dlq", fails_once)
    with pytest.raises(Exception, match="no space"):
        run(spark, ingest, topic, tmp_path)
    assert len(calls) == 2
    run(spark, ingest, topic, tmp_path)
    table = read_table(spark, ingest.table)
    assert table.count() == 12 and "kafka_topic" in table.columns
    letters = read_events(spark, ingest.dead_letters, streaming=False)
    read = flatten(decode_avro(letters, {1: DLQ_V1}))
    assert read.count() == 2
    assert {r.error for r in read.collect()} == {"unknown magic byte"}


def test_second_try_replaces_letters_whose_schema_came_in_between(spark, tmp_path):
    ingest = make(tmp_path)
    batch = topic_rows(spark.createDataFrame([(samples.framed(samples.CLICK_BODY),)], "value binary"), "t")
    ingest.schemas = {8: CLICK_STREAM_V1}
    with as_stream(spark, "own"):
        ingest.process(batch, 0)
    assert read_events(spark, ingest.dead_letters, streaming=False).count() == 1
    ingest.schemas = SCHEMAS
    with as_stream(spark, "own"):
        ingest.process(batch, 0)
    assert read_events(spark, ingest.dead_letters, streaming=False).count() == 0
    assert read_table(spark, ingest.table).count() == 1


def test_streams_that_share_their_outputs_do_not_replace_each_other(spark, topic, tmp_path):
    ingest = make(tmp_path)
    for name in ("one", "two"):
        messages = read_events(spark, topic, ONE_FILE)
        await_end(ingest.start(messages, f"{tmp_path}/checkpoint-{name}", ONCE), 120)
    assert read_table(spark, ingest.table).count() == 24
    assert read_events(spark, ingest.dead_letters, streaming=False).count() == 4
    assert read_progress(spark, ingest.progress).select("query_id").distinct().count() == 2
    copy = str(tmp_path / "copy")
    for name in ("three", "four"):
        stream = write_kafka(
            read_events(spark, topic), "t", folder=copy, checkpoint=f"{tmp_path}/checkpoint-{name}", trigger=ONCE
        )
        await_end(stream, 120)
    write_kafka(read_events(spark, topic, streaming=False), "t", folder=copy)
    assert read_events(spark, copy, streaming=False).count() == 3 * 14


LATE = ["2024-01-10T00:00:00", "2024-01-10T01:00:00", "2024-01-10T02:00:00", "2024-01-01T00:00:00", "2024-01-10T03:00:00"]


def test_late_rows_are_split_off_only_on_request(spark, tmp_path):
    folder = str(tmp_path / "topic")
    for i, at in enumerate(LATE):
        add_file(spark, folder, [(f"e{i}", at)])
    plain, split = tmp_path / "plain", tmp_path / "split"
    everything = make(plain)
    run(spark, everything, folder, plain)
    assert read_table(spark, everything.table).count() == 5
    ingest = make(split, late=str(split / "late"), delay="24 hours")
    run(spark, ingest, folder, split)
    assert [r.event_id for r in read_table(spark, ingest.late).collect()] == ["e3"]
    assert read_table(spark, ingest.table).count() == 4
    rows, _ = bronze(read_events(spark, folder, streaming=False), SCHEMAS)
    on_time, late = split_late(rows)
    assert [r.event_id for r in late.collect()] == ["e3"] and on_time.count() == 4


def test_newest_time_survives_a_missing_progress_row(spark, tmp_path):
    base = str(tmp_path / "progress")
    assert newest_before(spark, base, 0) is None
    with as_stream(spark, "own"):
        assert newest_before(spark, base, 3) is None
    counts = {"events": 1, "bad": 0, "late": 0, "newest": 1704067200000000}
    with as_stream(spark, "own"):
        make(tmp_path)._record(spark, 1, counts, None, 0.1)
        assert str(read_progress(spark, base).first().max_seen) == "2024-01-01 00:00:00"
        assert newest_before(spark, base, 2) == 1704067200000000
        assert newest_before(spark, base, 7) == 1704067200000000
        assert newest_before(spark, base, 1) is None


def test_a_batch_whose_rows_the_source_loses_is_not_committed(spark, tmp_path, monkeypatch):
    ingest, count = make(tmp_path), Ingest._count
    values = [(b"x",), (b"y",), (samples.framed(samples.CLICK_BODY),)]
    batch = spark.createDataFrame(values, "value binary").transform(full_rows)
    calls = []

    def shorter(self, routed, timed):
        calls.append(1)
        return count(self, routed.limit(2) if len(calls) == 4 else routed, timed)

    monkeypatch.setattr(Ingest, "_count", shorter)
    with as_stream(spark, "own"):
        ingest.process(batch, 0)
        with pytest.raises(RowsLost):
            ingest.process(batch, 1)
        progress = read_progress(spark, ingest.progress)
        assert [(r.batch_id, r.good, r.bad) for r in progress.collect()] == [(0, 1, 2)]
        ingest.process(batch, 1)
    assert read_table(spark, ingest.table).count() == 2
    assert read_events(spark, ingest.dead_letters, streaming=False).count() == 4
    assert [(r.good, r.bad) for r in read_progress(spark, ingest.progress).collect()] == [(1, 2)] * 2


def test_a_batch_is_read_and_decoded_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for rows in batches:
            read.add(rows.num_rows)
            yield rows

    values = [(b"x",), (samples.framed(samples.CLICK_BODY),)] * 3
    batch = spark.createDataFrame(values, "value binary").coalesce(1).mapInArrow(seen, "value binary")
    with as_stream(spark, "own"):
        make(tmp_path, late=f"{tmp_path}/late").process(full_rows(batch), 0)
    assert read.value == 6


def test_a_write_that_a_transaction_log_skips_does_not_block(spark, tmp_path, monkeypatch):
    ingest = make(tmp_path)
    write = ingest_module.write_batch
    skips = lambda df, path, *a, **k: None if path == ingest.table else write(df, path, *a, **k)
    monkeypatch.setattr(ingest_module, "write_batch", skips)
    batch = full_rows(spark.createDataFrame([(b"x",), (samples.framed(samples.CLICK_BODY),)], "value binary"))
    with as_stream(spark, "own"):
        ingest.process(batch, 0)
    assert [(r.events, r.good, r.bad) for r in read_progress(spark, ingest.progress).collect()] == [(2, 1, 1)]


def test_a_batch_without_a_stream_id_is_refused(spark, tmp_path):
    batch = full_rows(spark.createDataFrame([(b"x",)], "value binary"))
    with pytest.raises(ValueError, match="no stream id"):
        make(tmp_path).process(batch, 0)
    with as_stream(spark, "one"):
        assert stream_id(spark) == "one"
    with pytest.raises(ValueError, match="PYSPARK_PIN_THREAD"):
        stream_id(spark)


def test_closed_days_are_compacted_and_later_rows_are_not_lost(spark, tmp_path, plan_of):
    folder, ingest = str(tmp_path / "topic"), make(tmp_path)
    for n in range(6):
        add_file(spark, folder, [(f"e{n}{d}", f"2024-01-0{d}T00:00:00") for d in range(1, 5)])
    run(spark, ingest, folder, tmp_path)
    target = str(tmp_path / "days")
    files = lambda path: len(list(Path(path).rglob("*.parquet")))
    expected = {f"e{n}{d}" for n in range(6) for d in range(1, 5)}

    def whole():
        rows = read_compacted(spark, ingest.table, target)
        assert sorted(r.event_id for r in rows.collect()) == sorted(expected)
        return rows

    assert read_compacted(spark, ingest.table, target).count() == 24
    for _ in range(2):
        compact(spark, ingest.table, target, "2024-01-04")
    assert files(ingest.table) == 24 and files(f"{target}/rows") == 3
    day = whole().filter("dt = DATE'2024-01-02'")
    assert day.count() == 6 and "PartitionFilters: [isnotnull(dt" in plan_of(day, "simple")
    # Rows of a closed day that come later are read from their batch, and taken by the next run.
    add_file(spark, folder, [("late", "2024-01-02T12:00:00"), ("new", "2024-01-05T00:00:00")])
    run(spark, ingest, folder, tmp_path)
    expected |= {"late", "new"}
    whole()
    assert remove_compacted(spark, ingest.table, target) == 18 and files(ingest.table) == 8
    assert remove_compacted(spark, ingest.table, target) == 0
    whole()
    compact(spark, ingest.table, target, "2024-01-05")
    whole()
    assert remove_compacted(spark, ingest.table, target) == 7 and files(ingest.table) == 1
    assert whole().columns == [*samples.CLICK, "event_time", "dt"]


def test_a_compaction_that_did_not_finish_does_not_count(spark, topic, tmp_path):
    ingest, target = make(tmp_path), str(tmp_path / "days")
    run(spark, ingest, topic, tmp_path)
    compact(spark, ingest.table, target, "2024-01-03")
    lost = next((tmp_path / "days" / "folders").iterdir())
    shutil.rmtree(lost)
    assert read_compacted(spark, ingest.table, target).count() == 12
    compact(spark, ingest.table, target, "2024-01-03")
    assert read_compacted(spark, ingest.table, target).count() == 12


def full_rows(df):
    return topic_rows(df, "t")


def test_newest_time_is_kept_by_streams_that_split_nothing(spark, tmp_path):
    folder = str(tmp_path / "topic")
    for i, at in enumerate(LATE):
        add_file(spark, folder, [(f"e{i}", at)])
    ingest = make(tmp_path)
    run(spark, ingest, folder, tmp_path)
    progress = read_progress(spark, ingest.progress).orderBy("batch_id").collect()
    assert [str(r.max_seen)[8:13] for r in progress] == ["10 00", "10 01", "10 02", "10 02", "10 03"]


def test_schemas_can_be_looked_up_per_batch(spark, topic, tmp_path):
    looked_up = []

    def lookup():
        looked_up.append(1)
        return SCHEMAS

    ingest = make(tmp_path)
    ingest.schemas = lookup
    run(spark, ingest, topic, tmp_path)
    assert len(looked_up) == 4


def test_table_of_a_grown_record_shows_all_columns(spark, tmp_path):
    ingest = make(tmp_path)
    versions = {101: USER_EVENT_V1, 103: USER_EVENT_V3}
    for batch_id, (writer_id, body) in enumerate(
        [(101, samples.USER_EVENT_BODY), (103, samples.USER_EVENT_V3_BODY)]
    ):
        ingest.schemas, ingest.reader = versions, versions[writer_id]
        rows = spark.createDataFrame([(samples.framed(body, writer_id),)], "value binary")
        with as_stream(spark, "own"):
            ingest.process(topic_rows(rows, "t"), batch_id)
    table = read_table(spark, ingest.table, merge_schema=True)
    assert {r.user_process for r in table.collect()} == {None, "bypass-process"}


def test_record_without_a_time_field(spark, tmp_path):
    folder = str(tmp_path / "topic")
    schema = '{"type": "record", "name": "R", "fields": [{"name": "a", "type": "string"}]}'
    rows = encode_avro(spark.createDataFrame([("x",)], "a string"), schema, 7).select("value")
    write_kafka(rows, "t", folder=folder)
    ingest = make(tmp_path)
    ingest.schemas = {7: schema}
    run(spark, ingest, folder, tmp_path)
    assert [tuple(r) for r in read_table(spark, ingest.table).collect()] == [("x",)]


def test_event_total_of_running_streams(spark, topic, tmp_path):
    total = EventTotal()
    spark.streams.addListener(total)
    try:
        good, _ = bronze(counted(read_events(spark, topic, ONE_FILE)), SCHEMAS)
        await_end(write_stream(good, str(tmp_path / "table"), trigger=ONCE), 120)
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(total)
    assert total.total == 14


def test_latest_start_leaves_out_the_files_already_there(spark, topic, tmp_path):
    since = datetime.now() + timedelta(hours=1)
    assert read_events(spark, topic, streaming=False, latest_since=since).count() == 0
    early = datetime(2000, 1, 1)
    assert read_events(spark, topic, streaming=False, latest_since=early).count() == 14
    stream = write_kafka(
        read_events(spark, topic, ONE_FILE, latest_since=early), "copy",
        folder=str(tmp_path / "copy"), checkpoint=str(tmp_path / "c"), trigger=ONCE,
    )
    await_end(stream, 120)
    assert read_events(spark, str(tmp_path / "copy"), streaming=False).count() == 14
    with pytest.raises(ValueError, match="checkpoint"):
        write_kafka(read_events(spark, topic), "copy", folder="x")


def test_topic_folder_rows_have_the_kafka_form(spark):
    rows = spark.createDataFrame([(b"k", b"v")], "key binary, value binary")
    row = topic_rows(rows, "t")
    assert row.schema.names == KAFKA_SCHEMA.names
    first = row.first()
    assert first.topic == "t" and 0 <= first.partition < 12 and first.offset is None
    assert first.timestampType == 0 and first.timestamp is not None


def test_a_stream_that_does_not_end_is_stopped(spark, topic, tmp_path):
    stream = write_stream(
        read_events(spark, topic), str(tmp_path / "t"), str(tmp_path / "c"), trigger={"processingTime": "1 hour"}
    )
    with pytest.raises(TimeoutError):
        await_end(stream, 3)
    assert not stream.isActive


def test_rebalanced_table_has_few_files_and_all_rows(spark, tmp_path):
    rows = spark.range(0, 900, numPartitions=9).selectExpr("id", "id % 3 AS dt")
    for name, rebalance in (("plain", False), ("even", True)):
        write_table(rows, str(tmp_path / name), partition_by=["dt"], rebalance=rebalance)
        assert read_table(spark, str(tmp_path / name)).count() == 900
    files = {name: len(list((tmp_path / name).rglob("*.parquet"))) for name in ("plain", "even")}
    assert files["plain"] == 27 and files["even"] <= 9


def test_a_stream_starts_after_its_mark(spark, topic, tmp_path):
    mark = mark_latest(spark, topic, str(tmp_path / "mark"))
    out = str(tmp_path / "out")

    def run_on():
        stream = write_stream(read_events(spark, topic, ONE_FILE, after=mark), out, fmt="parquet", trigger=ONCE)
        await_end(stream, 120)
        return spark.read.schema(KAFKA_SCHEMA).parquet(out).count()

    assert run_on() == 0
    add_file(spark, topic, [("new", "2024-01-09T00:00:00")])
    assert mark_latest(spark, topic, mark) == mark
    assert run_on() == 1 and read_events(spark, topic, streaming=False, after=mark).count() == 1
    empty = tmp_path / "empty"
    empty.mkdir()
    nothing = mark_latest(spark, str(empty), str(tmp_path / "nothing"))
    assert read_events(spark, topic, streaming=False, after=nothing).count() == 15
