from pathlib import Path
from types import SimpleNamespace
from unittest import mock

import pytest

from clicklake.sources.events import read_events
from clicklake.sources import lake
from clicklake.sources.lake import shared_base, shared_folder
from clicklake.streaming.sinks import sink_options
from clicklake.sources.settings import kafka_options, session_conf, table_format


def test_kafka_defaults():
    assert kafka_options({}) == {
        "kafka.bootstrap.servers": "localhost:9092",
        "subscribe": "clickstream-topic",
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": "10000",
        "failOnDataLoss": "false",
        "kafka.client.id": "clickstream-consumer",
    }


def test_kafka_options_follow_the_environment():
    options = kafka_options({"TOPIC_NAME": "t", "STARTING_OFFSETS": "earliest", "MAX_OFFSETS_PER_TRIGGER": "5"})
    assert (options["subscribe"], options["startingOffsets"], options["maxOffsetsPerTrigger"]) == ("t", "earliest", "5")


def test_security_options_only_when_set():
    plain = kafka_options({"SECURITY_PROTOCOL": "PLAINTEXT", "SASL_USERNAME": "u"})
    assert not [name for name in plain if "security" in name or "sasl" in name]
    secure = kafka_options(
        {"SECURITY_PROTOCOL": "SASL_SSL", "SASL_MECHANISMS": "PLAIN", "SASL_USERNAME": "u", "SASL_PASSWORD": 'p"\\'}
    )
    assert secure["kafka.security.protocol"] == "SASL_SSL"
    assert secure["kafka.sasl.mechanism"] == "PLAIN"
    assert secure["kafka.sasl.jaas.config"].endswith('username="u" password="p\\"\\\\";')


def test_session_conf(tmp_path):
    plain = session_conf({})
    assert plain["spark.sql.session.timeZone"] == "UTC"
    assert not [name for name in plain if "s3a" in name or "delta" in name]
    for name in ("b-delta-1.jar", "a.jar"):
        (tmp_path / name).touch()
    full = session_conf(
        {
            "S3_ENDPOINT": "http://store:9000",
            "AWS_ACCESS_KEY_ID": "k",
            "AWS_SECRET_ACCESS_KEY": "s",
            "WAREHOUSE_DIR": "s3a://w/",
            "JARS_GLOB": f"{tmp_path}/*.jar",
        }
    )
    assert full["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000"
    assert full["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert full["spark.hadoop.fs.s3a.secret.key"] == "s"
    assert full["spark.sql.warehouse.dir"] == "s3a://w/"
    assert full["spark.jars"] == f"{tmp_path}/a.jar,{tmp_path}/b-delta-1.jar"
    assert full["spark.sql.extensions"].startswith("io.delta")


def test_table_format_without_delta(spark):
    assert table_format(spark) == "parquet"


def test_kafka_without_its_connector_is_a_clear_error(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        read_events(spark)


def session(setting, master="yarn", context_dir=None):
    """As much of a session as the folder is taken from; the setting is fixed at start."""
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: setting or default),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: context_dir),
    )


def test_shared_folder_comes_from_the_session(spark):
    assert shared_base(session("hdfs://shared/dir/")) == "hdfs://shared/dir/"
    assert shared_base(session(None, context_dir="hdfs://c")) == "hdfs://c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_base(session(None))
    with pytest.raises(ValueError, match="local file system"):
        shared_base(session("file:///tmp/shared"))
    assert shared_base(session("file:///tmp/shared", master="local-cluster[2,1,1024]")) == "file:///tmp/shared"
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert "/clicklake/" in first and first != second and Path(first).parent == Path(second).parent
    assert Path(first).parent.is_dir()


def kept_in(spark, folder):
    """A new path of the shared folder, with this as the session's setting."""
    kind, told = type(spark.conf), type(spark.conf).get
    setting = lambda self, name, *more: str(folder) if name == "spark.checkpoint.dir" else told(self, name, *more)
    with mock.patch.object(kind, "get", setting):
        return Path(shared_folder(spark, "table"))


def test_shared_folder_next_to_one_of_another_user(spark, tmp_path):
    (tmp_path / "clicklake").write_text("not mine")
    found = kept_in(spark, tmp_path)
    spark.range(3).write.parquet(str(found))
    assert found.is_relative_to(tmp_path) and spark.read.parquet(str(found)).count() == 3


def test_a_base_that_cannot_be_written_is_passed_over(spark, tmp_path):
    (tmp_path / "file").write_text("no folder")
    found = kept_in(spark, tmp_path / "file")
    spark.range(3).write.parquet(str(found))
    assert not found.is_relative_to(tmp_path) and spark.read.parquet(str(found)).count() == 3


def test_standalone_cluster_may_have_a_local_looking_folder():
    assert shared_base(session("file:///tmp/shared", master="spark://host:7077")) == "file:///tmp/shared"


def test_cluster_without_the_setting_uses_the_warehouse():
    only = SimpleNamespace(get=lambda name, default: {"spark.sql.warehouse.dir": "file:///w"}.get(name, default))
    cluster = session(None, master="local-cluster[2,1,1024]")
    cluster.conf = only
    assert shared_base(cluster) == "file:///w"


def test_folder_that_tasks_do_not_write_to_is_refused(spark, tmp_path):
    with mock.patch.object(lake, "_is_local", lambda _: False):
        assert lake._usable(spark, str(tmp_path / "seen"))
        with mock.patch.object(lake, "_all_write_to", lambda *_: False), pytest.raises(ValueError, match="one folder"):
            lake._session_folder((str(tmp_path),), "unseen", spark)


def test_log_store_is_a_choice():
    assert "spark.delta.logStore.class" not in session_conf({"TABLE_FORMAT": "delta"})
    assert session_conf({"TABLE_FORMAT": "delta", "DELTA_LOG_STORE": "x.Y"})["spark.delta.logStore.class"] == "x.Y"


def test_sinks_use_the_connection_of_their_job():
    options = sink_options("dead", {"kafka.acks": "all"}, {"BOOTSTRAP_SERVERS": "broker:1", "SECURITY_PROTOCOL": "SSL"})
    assert options == {"kafka.bootstrap.servers": "broker:1", "kafka.security.protocol": "SSL", "topic": "dead", "kafka.acks": "all"}
