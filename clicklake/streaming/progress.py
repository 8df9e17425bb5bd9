"""Progress of running streams as DataFrames, and a live event total."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS_SCHEMA = "batch_id long, events long, delivered long, seconds double"
TOTAL = "clicklake_events"


def progress_table(
    spark: SparkSession, query: StreamingQuery, counts: DataFrame | None = None
) -> DataFrame:
    """One row per recent batch of a query: rows read, rows delivered, seconds.

    Spark keeps the last ``spark.sql.streaming.numRecentProgressUpdates`` batches. A sink
    that does not count its rows reports -1 delivered, which is NULL here; with ``counts``,
    the progress table of an ``Ingest``, its good rows stand there instead.
    """
    rows = []
    for update in query.recentProgress:
        delivered = update.sink.numOutputRows
        rows.append(
            (
                update.batchId,
                update.numInputRows,
                None if delivered is None or delivered < 0 else delivered,
                update.batchDuration / 1000.0,
            )
        )
    recent = spark.createDataFrame(rows, PROGRESS_SCHEMA)
    if counts is None:
        return recent
    own = counts.filter(F.col("query_id") == str(query.id)).select("batch_id", "good")
    delivered = F.coalesce("delivered", "good").alias("delivered")
    return recent.join(own, "batch_id", "left").select("batch_id", "events", delivered, "seconds")


def dropped_rows(query: StreamingQuery) -> int:
    """The rows that the stateful operators of a query dropped, in its recent batches, as older than the watermark.

    An aggregation counts groups here, after its partial counts; operators that remember keys
    count rows.
    """
    return sum(state.numRowsDroppedByWatermark for update in query.recentProgress for state in update.stateOperators)


def counted(df: DataFrame) -> DataFrame:
    """Count the rows that pass this point of a stream, for :class:`EventTotal`."""
    return df.observe(TOTAL, F.count(F.lit(1)).alias("events"))


class EventTotal(StreamingQueryListener):
    """The total of events over all :func:`counted` streams of a session."""

    def __init__(self):
        super().__init__()
        self.total = 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        metrics = event.progress.observedMetrics.get(TOTAL)
        if metrics is not None:
            self.total += metrics["events"]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


RUNS = "query_id string, run_id string, name string, started string, ended timestamp, batches long, events long, seconds double, error string"


class RunLog(StreamingQueryListener):
    """Writes a row for every run of a stream when the run ends, also when it failed.

    Add it to ``spark.streams`` before the streams start. The row has the events and seconds
    of the run's batches that took rows, and the error of a failed run. It is written in a
    folder named after the run; :meth:`wait` waits for it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self._spark, self._folder = spark, folder
        self._runs: dict[str, dict] = {}
        self._changed = threading.Condition()

    def _run(self, run_id) -> dict:
        with self._changed:
            empty = {"name": None, "started": None, "batches": 0, "events": 0, "seconds": 0.0, "ended": False, "fault": None}
            return self._runs.setdefault(str(run_id), empty)

    def onQueryStarted(self, event):
        self._run(event.runId).update(name=event.name, started=event.timestamp)

    def onQueryProgress(self, event):
        run, told = self._run(event.progress.runId), event.progress
        run["batches"] += told.numInputRows > 0
        run["events"] += told.numInputRows
        run["seconds"] += told.batchDuration / 1000.0

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        run = self._run(event.runId)
        try:
            row = (str(event.id), str(event.runId), run["name"], run["started"], run["batches"], run["events"], run["seconds"], event.exception)
            made = self._spark.createDataFrame([row], RUNS.replace("ended timestamp, ", ""))
            line = made.withColumn("ended", F.current_timestamp()).coalesce(1)
            line.write.mode("overwrite").parquet(f"{self._folder}/{event.runId}")
        except Exception as fault:  # Spark would only log it; wait() raises it
            run["fault"] = fault
        with self._changed:
            run["ended"] = True
            self._changed.notify_all()

    def wait(self, query: StreamingQuery, timeout: float = 60) -> None:
        """Wait until the run of a query that has ended is logged; raise what kept it from being."""
        run = self._run(query.runId)
        with self._changed:
            if not self._changed.wait_for(lambda: run["ended"], timeout):
                raise TimeoutError(f"run {query.runId} was not logged within {timeout} seconds")
        if run["fault"] is not None:
            raise run["fault"]


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all runs that have ended."""
    return spark.read.schema(RUNS).option("recursiveFileLookup", "true").parquet(folder)
