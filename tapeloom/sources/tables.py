"""Tables that a query writes once and reads often, in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the context's checkpoint folder. Where neither is set, one
    machine gets a temporary folder; a cluster gets an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        path = _LOCAL.setdefault(sc.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-tables-')}")
    return f"{path.rstrip('/')}/tape-{sc.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet and read back: its lineage ends there, a lost executor costs nothing that was
    written, and readers know its size and take the columns that they need."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
