"""Session and connector settings, read from an environment mapping."""

from __future__ import annotations

import glob
import os
from collections.abc import Mapping

from pyspark.sql import SparkSession

# --- Fixed values: source defaults ------------------------------------------------------
DEFAULT_TOPIC = "clickstream-topic"
DEFAULT_BROKERS = "localhost:9092"
DEFAULT_CLIENT_ID = "clickstream-consumer"
DEFAULT_MAX_OFFSETS = "10000"
DEFAULT_STARTING_OFFSETS = "latest"
# ----------------------------------------------------------------------------------------

DELTA_EXTENSION = "io.delta.sql.DeltaSparkSessionExtension"


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def kafka_options(env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options of the Kafka source.

    Security options appear only when they are set: the protocol when it is not
    PLAINTEXT, the login line only with both a user and a password.
    """
    env = os.environ if env is None else env
    options = {
        "kafka.bootstrap.servers": env.get("BOOTSTRAP_SERVERS", DEFAULT_BROKERS),
        "subscribe": env.get("TOPIC_NAME", DEFAULT_TOPIC),
        "startingOffsets": env.get("STARTING_OFFSETS", DEFAULT_STARTING_OFFSETS),
        "maxOffsetsPerTrigger": env.get("MAX_OFFSETS_PER_TRIGGER", DEFAULT_MAX_OFFSETS),
        "failOnDataLoss": "false",
        "kafka.client.id": env.get("CLIENT_ID", DEFAULT_CLIENT_ID),
    }
    # A batch waits until there are so many offsets, but no longer than the delay.
    for name, key in (("MIN_OFFSETS_PER_TRIGGER", "minOffsetsPerTrigger"), ("MAX_TRIGGER_DELAY", "maxTriggerDelay")):
        if env.get(name):
            options[key] = env[name]
    return options | kafka_security(env)


def kafka_security(env: Mapping[str, str]) -> dict[str, str]:
    """The security options alone, for the source and the sink."""
    options = {}
    protocol = env.get("SECURITY_PROTOCOL", "PLAINTEXT")
    if protocol and protocol != "PLAINTEXT":
        options["kafka.security.protocol"] = protocol
    if env.get("SASL_MECHANISMS"):
        options["kafka.sasl.mechanism"] = env["SASL_MECHANISMS"]
    user, password = env.get("SASL_USERNAME"), env.get("SASL_PASSWORD")
    if user and password:
        options["kafka.sasl.jaas.config"] = (
            "org.apache.kafka.common.security.plain.PlainLoginModule required "
            f"username={_quoted(user)} password={_quoted(password)};"
        )
    return options


def session_conf(env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings for ``SparkSession.builder``: time zone, object store, table format.

    Object-store keys come from the environment only. ``JARS_GLOB`` names jars to load;
    with a Delta jar among them, or ``TABLE_FORMAT=delta``, Delta is set up.
    """
    env = os.environ if env is None else env
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if env.get("S3_ENDPOINT"):
        conf |= {
            "spark.hadoop.fs.s3a.endpoint": env["S3_ENDPOINT"],
            "spark.hadoop.fs.s3a.path.style.access": "true",
            "spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
        }
    if env.get("AWS_ACCESS_KEY_ID") and env.get("AWS_SECRET_ACCESS_KEY"):
        conf["spark.hadoop.fs.s3a.access.key"] = env["AWS_ACCESS_KEY_ID"]
        conf["spark.hadoop.fs.s3a.secret.key"] = env["AWS_SECRET_ACCESS_KEY"]
    if env.get("WAREHOUSE_DIR"):
        conf["spark.sql.warehouse.dir"] = env["WAREHOUSE_DIR"]
    jars = sorted(glob.glob(env["JARS_GLOB"])) if env.get("JARS_GLOB") else []
    if jars:
        conf["spark.jars"] = ",".join(jars)
    if env.get("TABLE_FORMAT") == "delta" or any("delta" in os.path.basename(jar) for jar in jars):
        conf |= {
            "spark.sql.extensions": DELTA_EXTENSION,
            "spark.sql.catalog.spark_catalog": "org.apache.spark.sql.delta.catalog.DeltaCatalog",
        }
        # The default log store is safe for several writers; another one is a choice of the operator.
        if env.get("DELTA_LOG_STORE"):
            conf["spark.delta.logStore.class"] = env["DELTA_LOG_STORE"]
    return conf


def table_format(spark: SparkSession) -> str:
    """``delta`` when the session has the Delta extension, else ``parquet``."""
    return "delta" if DELTA_EXTENSION in spark.conf.get("spark.sql.extensions", "") else "parquet"
