"""Session folders: records and status as Parquet, dimensions as JSON, sealed by checksums.

Tables are read and written by Spark, so a session may lie in any store that Spark reads. Only the
small JSON files pass through the driver. Record order is never that of files: sort by source_ordinal.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources.schemas import RECORDS, STATUS

SESSION_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def read_records(spark: SparkSession, directory: str) -> DataFrame:
    """The records of one session folder, or of all under a glob, with session_id from the path."""
    return spark.read.schema(RECORDS).parquet(f"{directory}/records.parquet").withColumn("session_id", _session())


def _session():
    return F.regexp_extract(F.input_file_name(), r"([^/]+)/(?:records|status)\.parquet", 1)


def read_status(spark: SparkSession, directory: str, instrument_id: int | None = None) -> DataFrame:
    """Status rows; one of another instrument, or with impossible times, raises an error when read."""
    rows = spark.read.schema(STATUS).parquet(f"{directory}/status.parquet").withColumn("session_id", _session())
    bad = (F.col("event_time_ns") < 0) | (F.col("capture_time_ns") < F.col("event_time_ns"))
    if instrument_id is not None:
        bad = bad | (F.col("instrument_id") != instrument_id)
    return rows.withColumn("status", F.when(bad, F.raise_error(F.lit("invalid status row"))).otherwise(F.col("status")))


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def read_instrument(spark: SparkSession, directory: str) -> dict:
    found = read_json(spark, f"{directory}/instrument.json")
    if not (isinstance(found["instrument_id"], int) and found["tick_size_fixed"] > 0 and found["multiplier"] > 0 and found["effective_time_ns"] >= 0):
        raise ValueError("instrument.json is out of range")
    return found


def read_meta(spark: SparkSession, directory: str) -> dict:
    import re

    found = read_json(spark, f"{directory}/session.json")
    if not re.match(SESSION_ID, found["session_id"]) or found["end_ns"] < found["start_ns"]:
        raise ValueError("session.json is out of range")
    return found


def checksums(spark: SparkSession, directory: str) -> dict[str, str]:
    """SHA-256 of each sealed file, computed where the bytes are. Part files of a table count together,
    in the order of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    own = files.select(F.regexp_extract("path", r"/(records\.parquet|status\.parquet|instrument\.json|session\.json)(/|$)", 1).alias("name"), F.col("path"), F.sha2("content", 256).alias("sha"))
    parts = own.filter("name <> '' and not path rlike '/[_.][^/]*$'").groupBy("name").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "sha"))), lambda x: x["sha"]), ","), 256).alias("sha"))
    return {r.name: r.sha for r in parts.collect()}


def write_session(directory: str, meta: dict, instrument: dict, records: DataFrame, status: DataFrame) -> None:
    """Writes a new session folder; one that exists is an error."""
    spark = records.sparkSession
    records.select(*RECORDS.names).write.mode("errorifexists").parquet(f"{directory}/records.parquet")
    status.select(*STATUS.names).write.mode("errorifexists").parquet(f"{directory}/status.parquet")
    for name, value in (("session.json", meta), ("instrument.json", instrument)):
        _write_text(spark, f"{directory}/{name}", json.dumps(value, sort_keys=True))
    _write_text(spark, f"{directory}/checksums.json", json.dumps(checksums(spark, directory), sort_keys=True))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def verify_session(spark: SparkSession, directory: str) -> dict[str, str]:
    """The sealed checksums, which must name the four files and match."""
    sealed = read_json(spark, f"{directory}/checksums.json")
    found = checksums(spark, directory)
    if set(sealed) != {"records.parquet", "status.parquet", "session.json", "instrument.json"} or sealed != found:
        raise ValueError(f"{directory} does not match its checksums")
    return sealed


def write_table_csv(df: DataFrame, path: str) -> None:
    """One CSV folder with a header; an empty table keeps its header line."""
    df.coalesce(1).write.mode("errorifexists").csv(path, header=True)
