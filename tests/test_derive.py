import pytest
from pyspark.sql import functions as F

from clicklake.functions.derive import with_dt, with_event_time


def times(spark, values, **options):
    rows = with_event_time(spark.createDataFrame([(v,) for v in values], "timestamp long"), **options)
    return [r.ms for r in rows.select(F.unix_millis("event_time").alias("ms")).collect()]


@pytest.fixture
def zone(spark):
    def use(name):
        spark.conf.set("spark.sql.session.timeZone", name)

    yield use
    use("UTC")


def test_whole_seconds_are_cut_toward_zero(spark):
    assert times(spark, [1704067207179, -1500, 0, None]) == [1704067207000, -1000, 0, None]


def test_milliseconds_can_be_kept(spark):
    assert times(spark, [1704067207179, -1500, None], precision="ms") == [1704067207179, -1500, None]
    with pytest.raises(ValueError, match="precision"):
        times(spark, [0], precision="us")


def test_two_instants_of_the_repeated_hour_stay_apart(spark, zone):
    zone("America/New_York")
    assert times(spark, [1730611800123, 1730615400999]) == [1730611800000, 1730615400000]


def test_numbers_beyond_the_calendar_give_null(spark):
    beyond = [2**63 - 1, -(2**63), 253402300800000, -62135596801000]
    for precision in ("s", "ms"):
        assert times(spark, beyond, precision=precision) == [None] * 4
        assert times(spark, [253402300799000], precision=precision) == [253402300799000]


def test_date_is_in_the_session_zone(spark, zone):
    rows = with_event_time(spark.createDataFrame([(1704067207179,)], "timestamp long"))
    assert str(with_dt(rows).first().dt) == "2024-01-01"
    zone("America/New_York")
    assert str(with_dt(rows).first().dt) == "2023-12-31"


def test_event_time_depends_on_the_record(spark):
    rows = spark.createDataFrame([(1,)], "other long")
    assert with_event_time(rows).columns == ["other"]
    assert "event_time" in with_event_time(rows, "other").columns
    with pytest.raises(ValueError, match="event_time"):
        with_dt(rows)
