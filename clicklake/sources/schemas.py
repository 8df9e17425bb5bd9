"""Schema tables: the text of every record version, by subject, version and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_TABLE = "subject string, version int, schema_id bigint, schema_json string"


def schemas_table(
    spark: SparkSession, directory: str, ids: dict[str, int] | None = None
) -> DataFrame:
    """The ``<subject>-v<version>.avsc`` files of a directory as a schema table.

    ``ids`` maps file names to schema ids; a file it does not name has a NULL id.
    """
    files = spark.read.text(directory, wholetext=True, pathGlobFilter="*.avsc").select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"),
        F.col("value").alias("schema_json"),
    )
    known = spark.createDataFrame(list((ids or {}).items()), "file string, schema_id bigint")
    pattern = r"^(.+)-v(\d+)\.avsc$"
    return files.join(known, "file", "left").select(
        F.regexp_extract("file", pattern, 1).alias("subject"),
        F.nullif(F.regexp_extract("file", pattern, 2), F.lit("")).cast("int").alias("version"),
        "schema_id",
        "schema_json",
    )


def schema_text(schemas: DataFrame, subject: str, version: int, *, required=False) -> str | None:
    """The text of one version; None, or an error when ``required``, if it is absent."""
    found = schemas.filter((F.col("subject") == subject) & (F.col("version") == version)).first()
    if found is None and required:
        raise FileNotFoundError(f"no schema for {subject} version {version}")
    return found["schema_json"] if found else None


def latest_schemas(schemas: DataFrame) -> DataFrame:
    """The highest version of every subject."""
    newest = F.max_by(F.struct("version", "schema_id", "schema_json"), "version")
    return schemas.groupBy("subject").agg(newest.alias("newest")).select("subject", "newest.*")


def latest_schema(schemas: DataFrame, subject: str) -> DataFrame:
    """The highest version of one subject."""
    return latest_schemas(schemas.filter(F.col("subject") == subject))


def newest_reader(schemas: DataFrame, check_subject: bool = True) -> str | None:
    """The text of the highest version that has an id; the table must have one subject only."""
    version = F.struct("version", "schema_id")
    row = (
        schemas.filter("schema_id IS NOT NULL")
        .agg(F.max_by("schema_json", version).alias("newest"), F.min("subject").alias("a"), F.max("subject").alias("z"))
        .first()
    )
    if check_subject and row["a"] != row["z"]:
        raise ValueError("the schema table has several subjects; filter it or give a reader")
    return row["newest"]


def texts_by_id(schemas: DataFrame) -> DataFrame:
    """One text per schema id, of its highest version: ``schema_id``, ``schema_json``."""
    known = schemas.filter("schema_id IS NOT NULL").groupBy("schema_id")
    return known.agg(F.max_by("schema_json", F.struct("version", "subject")).alias("schema_json"))


def subject_name(
    topic: Column,
    record: Column | None = None,
    strategy: str = "TopicNameStrategy",
    is_key: bool = False,
) -> Column:
    """The subject a topic's schema is kept under.

    ``TopicNameStrategy`` gives ``<topic>-value``, ``RecordNameStrategy`` the full record
    name, ``TopicRecordNameStrategy`` ``<topic>-<record>-value`` (registry clients leave
    out the suffix there). The last two need a record name on every row.
    """
    suffix = F.lit("key" if is_key else "value")
    if strategy == "TopicNameStrategy":
        return F.concat_ws("-", topic, suffix)
    if strategy not in ("RecordNameStrategy", "TopicRecordNameStrategy"):
        raise ValueError(f"unknown subject strategy {strategy!r}")
    if record is None:
        raise ValueError(f"{strategy} needs a record name")
    missing = F.raise_error(f"{strategy} needs a record name").cast("string")
    named = F.when(record.isNull() | (record == ""), missing).otherwise(record)
    if strategy == "RecordNameStrategy":
        return named
    return F.concat_ws("-", topic, named, suffix)
