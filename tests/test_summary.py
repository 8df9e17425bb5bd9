from datetime import date, timedelta

from clicklake.operators.summary import (
    daily_totals,
    event_totals,
    ingest_totals,
    preview,
    row_count,
    run_summary,
)


def test_running_totals_over_months_and_unknown_dates(spark):
    days = [date(2023, 11, 20) + timedelta(days=d) for d in range(0, 100, 3)]
    rows = [(d,) for i, d in enumerate(days) for _ in range(i + 1)] + [(None,)] * 2
    totals = daily_totals(spark.createDataFrame(rows, "dt date")).orderBy("dt").collect()
    assert [r.dt for r in totals] == [None, *days]
    expected, so_far = [], 0
    for events in [2, *range(1, len(days) + 1)]:
        so_far += events
        expected.append((events, so_far))
    assert [(r.events, r.total_events) for r in totals] == expected


def test_totals_of_batches(spark):
    streams = [("a", 0, 2), ("a", 1, 3), ("b", 0, 10), ("b", 1, 1)]
    apart = ingest_totals(spark.createDataFrame(streams, "query_id string, batch_id long, events long"))
    assert sorted((r.query_id, r.batch_id, r.total_events) for r in apart.collect()) == [
        ("a", 0, 2), ("a", 1, 5), ("b", 0, 10), ("b", 1, 11)
    ]
    progress = spark.createDataFrame([(0, 2, 1.0), (0, 3, 0.5), (2, 4, 1.0), (1, 0, 0.5)], "batch_id long, events long, seconds double")
    totals = ingest_totals(progress).orderBy("batch_id").collect()
    assert [r.total_events for r in totals] == [5, 5, 9]
    assert tuple(run_summary(progress).first()) == (3.0, 9)
    assert tuple(run_summary(progress.limit(0)).first()) == (0.0, 0)


def test_count_and_preview(spark):
    rows = spark.range(100)
    assert row_count(rows).first().rows == 100
    assert preview(rows).count() == 20
    assert [r.id for r in preview(rows, 3, "id").collect()] == [0, 1, 2]


def test_running_total_of_each_event_over_all_tasks(spark, tmp_path):
    rows = spark.range(0, 5000, numPartitions=7).selectExpr("(id * 7919) % 5003 AS at", "'hot' AS key")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        totals = event_totals(rows, ["at"], f"{tmp_path}/placed")
        assert [r.total_events for r in totals.orderBy("at").collect()] == list(range(1, 5001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{tmp_path}/placed").select("_task").distinct().count() == 4
    assert totals.columns == ["at", "key", "total_events"]
