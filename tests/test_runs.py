from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

from clicklake.functions.records import CLICK_STREAM_V1
from clicklake.operators.summary import ingest_totals, run_summary
from clicklake.sources.events import read_events
from clicklake.sources.settings import kafka_options
from clicklake.streaming.ingest import Ingest, read_progress
from clicklake.streaming import produce as produce_module
from clicklake.streaming.produce import produce
from clicklake.streaming.progress import RunLog, read_runs
from clicklake.streaming.sinks import await_end, run_batches, write_kafka

from . import samples

ONCE, ONE_FILE = {"availableNow": True}, {"maxFilesPerTrigger": "1"}
DDL = ", ".join(f"{n} {'long' if n == 'timestamp' else 'string'}" for n in samples.CLICK)


def send(spark, folder, *counts):
    for count in counts:
        value = F.lit(samples.framed(samples.CLICK_BODY))
        write_kafka(spark.range(count).coalesce(1).select(F.lit(b"k").alias("key"), value.alias("value")), "t", folder=folder)


@pytest.fixture
def log(spark, tmp_path):
    listener = RunLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(listener)
    yield listener
    spark.streams.removeListener(listener)


def test_each_run_leaves_a_row_when_it_ends(spark, tmp_path, log):
    topic = str(tmp_path / "topic")
    send(spark, topic, 3, 4, 5)
    bad = []

    def process(batch, batch_id):
        assert batch.count() > 0
        if batch_id == 2 and not bad:
            bad.append(1)
            raise OSError("disk is full")

    def run(name):
        stream = run_batches(read_events(spark, topic, ONE_FILE), process, str(tmp_path / "checkpoint"), ONCE, name)
        try:
            await_end(stream, 120)
        except StreamingQueryException:
            assert name == "first"
        log.wait(stream)
        return stream

    first, second = run("first"), run("second")
    rows = {r.name: r for r in read_runs(spark, str(tmp_path / "log")).collect()}
    assert (rows["first"].batches, rows["first"].events, rows["second"].batches, rows["second"].events) == (2, 7, 1, 5)
    assert "disk is full" in rows["first"].error and rows["second"].error is None
    assert rows["first"].run_id == str(first.runId) != rows["second"].run_id
    assert rows["first"].query_id == rows["second"].query_id == str(second.id)
    assert all(r.ended is not None and r.started and r.seconds > 0 for r in rows.values())
    assert run_summary(read_runs(spark, str(tmp_path / "log"))).first().total_events == 12


def test_a_run_that_cannot_be_logged_is_told(spark, tmp_path):
    listener = RunLog(spark, "nowhere://log")
    spark.streams.addListener(listener)
    try:
        send(spark, str(tmp_path / "topic"), 1)
        noop = lambda batch, batch_id: None
        stream = run_batches(read_events(spark, str(tmp_path / "topic")), noop, str(tmp_path / "checkpoint"), ONCE)
        await_end(stream, 120)
        with pytest.raises(Exception, match="nowhere"):
            listener.wait(stream)
    finally:
        spark.streams.removeListener(listener)


def test_one_total_over_streams_side_by_side(spark, tmp_path):
    ingest = Ingest({7: CLICK_STREAM_V1}, f"{tmp_path}/table", f"{tmp_path}/dead", f"{tmp_path}/progress")
    for number in range(2):
        send(spark, f"{tmp_path}/topic{number}", 2, 3, 4)

    def run(number):
        messages = read_events(spark, f"{tmp_path}/topic{number}", ONE_FILE)
        await_end(ingest.start(messages, f"{tmp_path}/checkpoint{number}", ONCE), 120)

    with ThreadPoolExecutor(2) as both:
        list(both.map(run, range(2)))
    totals = ingest_totals(read_progress(spark, ingest.progress), over_streams=True).orderBy("committed").collect()
    assert len(totals) == 6 and len({r.query_id for r in totals}) == 2 and totals[-1].total_events == 18
    so_far = 0
    for row in totals:
        so_far += row.events
        assert row.total_events == so_far


def test_batches_may_wait_for_offsets():
    waits = {"MIN_OFFSETS_PER_TRIGGER": "500", "MAX_TRIGGER_DELAY": "30s"}
    options = kafka_options(waits)
    assert (options["minOffsetsPerTrigger"], options["maxTriggerDelay"]) == ("500", "30s")
    assert not {"minOffsetsPerTrigger", "maxTriggerDelay"} & kafka_options({}).keys()


def test_bytes_bound_a_batch_of_a_folder(spark, tmp_path):
    topic, counts = str(tmp_path / "topic"), []
    send(spark, topic, 1, 1, 1)
    for number, most in enumerate(("1", str(2**40))):
        messages = read_events(spark, topic, {"maxBytesPerTrigger": most})
        batches = []
        await_end(run_batches(messages, lambda batch, _: batches.append(batch.count()), f"{tmp_path}/c{number}", ONCE), 120)
        counts.append(batches)
    assert counts == [[1, 1, 1], [3]]


def test_produce_uses_the_connection_and_the_clients_partitions(spark, tmp_path, monkeypatch):
    used = []
    monkeypatch.setattr(produce_module, "write_kafka", lambda df, topic, **options: used.append((topic, df.columns, options)))
    rows = [tuple(samples.CLICK.values()), tuple((samples.CLICK | {"url": None}).values())]
    env = {"BOOTSTRAP_SERVERS": "elsewhere:9092"}
    counts = produce(spark.createDataFrame(rows, DDL), CLICK_STREAM_V1, 7, topic="t", dlq_topic="d", partitions=3, env=env)
    assert counts == {"written": 1, "dead_letters": 1}
    assert used == [("t", ["key", "value", "partition"], {"folder": None, "env": env}), ("d", ["key", "value"], {"folder": None, "env": env})]


def test_produce_fails_if_records_change_while_they_are_written(spark, tmp_path, monkeypatch):
    counts = iter([{"records": 2, "misfits": 0}, {"records": 1, "misfits": 0}])
    monkeypatch.setattr(produce_module, "_counts", lambda encoded: next(counts))
    rows = spark.createDataFrame([tuple(samples.CLICK.values())], DDL)
    with pytest.raises(produce_module.RowsLost):
        produce(rows, CLICK_STREAM_V1, 7, topic="t", dlq_topic="d", folder=f"{tmp_path}/t", dlq_folder=f"{tmp_path}/d")
