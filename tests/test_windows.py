from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clicklake.operators.late import split_late
from clicklake.operators.windows import first_arrivals, window_counts
from clicklake.streaming.progress import dropped_rows
from clicklake.streaming.sinks import await_end, write_stream

ONCE = {"availableNow": True}
START = datetime(2024, 1, 1)


def rows(spark, *hours, name="e"):
    made = [(f"{name}{n}", None if h is None else START + timedelta(hours=h)) for n, h in enumerate(hours)]
    return spark.createDataFrame(made, "event_id string, event_time timestamp")


@pytest.fixture
def arrive(spark, tmp_path):
    """Adds a file of rows and runs the stream made of them to its end; gives the stream."""
    folder = str(tmp_path / "in")

    def run(frame, made):
        frame.coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(frame.schema).parquet(folder)
        stream = write_stream(made(source), f"{tmp_path}/out", f"{tmp_path}/checkpoint", fmt="parquet", trigger=ONCE)
        await_end(stream, 120)
        return stream

    return run


def test_windows_come_out_when_the_watermark_has_passed(spark, tmp_path, arrive):
    counts = lambda df: window_counts(df, "1 hour", delay="2 hours")

    def out():
        return sorted((int(r.start.hour), r.events) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    arrive(rows(spark, 0.1, 0.5, 1.2, None), counts)
    assert out() == []
    arrive(rows(spark, 0.2, 4.0), counts)
    assert out() == [(0, 3), (1, 1)]
    late = arrive(rows(spark, 0.9, 2.5, 7.5), counts)
    assert out() == [(0, 3), (1, 1), (2, 1), (4, 1)]
    assert dropped_rows(late) == 1


def test_windows_of_a_batch(spark):
    found = window_counts(rows(spark, 0.1, 0.5, 25, None), "1 day").orderBy("start").collect()
    assert [(r.start, r.end, r.events) for r in found] == [
        (START, START + timedelta(days=1), 2),
        (START + timedelta(days=1), START + timedelta(days=2), 1),
    ]


def test_a_window_of_most_rows_is_counted_before_the_shuffle(spark, plan_of):
    plan = plan_of(window_counts(rows(spark, 1, 1, 2), by=["event_id"]), "simple")
    assert plan.count("HashAggregate") == 2 and plan.index("Exchange") < plan.rindex("HashAggregate")


def test_what_is_sent_again_is_dropped(spark, tmp_path, arrive):
    once = lambda df: first_arrivals(df, delay="2 hours")
    first = rows(spark, 0, 1, 2, 10, 10)
    assert dropped_rows(arrive(first, once)) == 0
    again = first.unionByName(rows(spark, 7.9, 8.0, 8.1, 9, name="new"))
    stream = arrive(again, once)
    # The late rows are those that split_late finds, and the one on the limit itself.
    newest = again.agg(F.max("event_time")).first()[0]
    late = split_late(again, "2 hours")[1].count()
    assert dropped_rows(stream) == late + again.filter(F.col("event_time") == newest - timedelta(hours=2)).count()
    table = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.event_id for r in table.collect()) == ["e0", "e1", "e2", "e3", "e4", "new2", "new3"]


def test_first_arrivals_of_a_batch(spark):
    frame = rows(spark, 1, 2, None)
    assert first_arrivals(frame.union(frame)).count() == 3
    assert first_arrivals(frame.limit(0)).count() == 0
