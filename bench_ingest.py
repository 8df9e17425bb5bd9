"""Row rates of the ingest path, on the click messages of ``BENCH_SF_DIR``.

Python UDF, the Avro decoder, the encoder, a one-day read with and without partitions,
and the whole ingest stream with and without failed messages. ``BENCH_COPIES`` repeats the
events to get a measurable number of rows. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicklake.functions import wire
from clicklake.functions.records import CLICK_STREAM_V1
from clicklake.operators.codec import decode_avro, encode_avro, flatten
from clicklake.plans.bronze import bronze
from clicklake.plans.fixtures import CLICK_ID, CLICK_SCHEMAS, clicks, kafka_rows
from clicklake.sources.events import read_events
from clicklake.sources.lake import read_table, shared_folder
from clicklake.sources.settings import session_conf
from clicklake.streaming.ingest import Ingest
from clicklake.streaming.sinks import await_end, write_kafka, write_table

RUNS = 5
TIMEOUT = 3600


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    copies = int(os.environ.get("BENCH_COPIES", "20"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("clicklake-bench-ingest")
    for name, value in session_conf().items():
        builder = builder.config(name, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def repeated(df):
        copy = F.explode(F.sequence(F.lit(1), F.lit(copies)))
        return df.withColumn("_copy", copy).drop("_copy").repartition(2 * int(cpus))

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    def median(run) -> float:
        times = []
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            run()
            times.append(time.perf_counter() - started)
        return statistics.median(times[1:])

    records, topic = shared_folder(spark, "records"), shared_folder(spark, "topic")
    write_table(repeated(clicks(spark, sf_dir)), records)
    write_kafka(repeated(kafka_rows(spark, sf_dir)), "clicks", folder=topic)
    whole = shared_folder(spark, "topic")
    table = read_table(spark, records)
    write_kafka(encode_avro(table, CLICK_STREAM_V1, CLICK_ID).select("value"), "clicks", folder=whole)
    rows = table.count()
    messages = read_events(spark, whole, streaming=False)

    strip_in_python = F.udf(lambda b: b[5:] if b and len(b) > 5 else None, T.BinaryType())
    decoded = decode_avro(messages.select("value"), CLICK_SCHEMAS)
    seconds = {
        "scan": median(lambda: noop(messages.select("value"))),
        "strip_expression": median(lambda: noop(messages.select(wire.strip_header(F.col("value"))))),
        "strip_python_udf": median(lambda: noop(messages.select(strip_in_python("value")))),
        "encode": median(lambda: noop(encode_avro(table, CLICK_STREAM_V1, CLICK_ID).select("value"))),
        "decode": median(lambda: noop(flatten(decoded))),
    }

    good, _ = bronze(messages, CLICK_SCHEMAS)
    plain, by_day = shared_folder(spark, "plain"), shared_folder(spark, "by-day")
    write_table(good, plain)
    write_table(good, by_day, partition_by=["dt"])
    for name, path in (("day_unpartitioned", plain), ("day_partitioned", by_day)):
        day = read_table(spark, path).filter("dt = DATE'2024-01-15'")
        seconds[name] = median(lambda day=day: noop(day))

    def ingest(folder):
        base = shared_folder(spark, "ingest")
        job = Ingest(CLICK_SCHEMAS, f"{base}/table", f"{base}/dead", f"{base}/progress")
        stream = job.start(read_events(spark, folder), f"{base}/checkpoint", {"availableNow": True})
        await_end(stream, TIMEOUT)

    seconds["ingest_clean"] = median(lambda: ingest(whole))
    seconds["ingest_tenth_failed"] = median(lambda: ingest(topic))
    spark.stop()
    print(
        json.dumps(
            {
                "rows": rows,
                "cpus": int(cpus),
                "seconds": {name: round(value, 3) for name, value in seconds.items()},
                "rows_per_second": {
                    name: round(rows / value)
                    for name, value in seconds.items()
                    if not name.startswith("day")
                },
            }
        )
    )


if __name__ == "__main__":
    main()
