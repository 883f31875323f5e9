"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application's tables, in one that the driver and all executors see.

    A cluster names that in ``spark.checkpoint.dir``. Only where it is unset and all runs on one
    machine, as in tests, a temporary folder is made; a cluster without it is an error.
    """
    path, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        path = kept(f"checkpoints:{app}", lambda: f"file://{tempfile.mkdtemp(prefix='spark-checkpoints-')}")
    return f"{path.rstrip('/')}/tables-{app}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in ``shared_dir`` that nothing else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete the tables that ``cut`` has written for this application. Results that read them, which
    are lazy, have to be written before."""
    delete(spark, shared_dir(spark))


#: Lets Spark delete a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and a lost
    executor costs nothing that was already written. What it shuffled is deleted at once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def uncompiled(spark: SparkSession, small: bool) -> Iterator[None]:
    """Jobs in here that read ``small`` tables run without code of their own, which the driver would compile and hold
    for each of many."""
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false" if small else before)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows and bytes of a batch of texts that goes to a Python worker, so that a worker's memory stays
#: far below an executor's.
TEXT_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "16777216")}


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends small batches to Python from now on, unless the user chose a size."""
    conf = df.sparkSession.conf
    for name, (default, ours) in TEXT_BATCH.items():
        if conf.get(name, default) in (default, "64MB"):
            conf.set(name, ours)
    return df


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores put before them until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list:
    """Its columns, dots in their names and all."""
    return [F.col(f"`{c}`") for c in df.columns]


def kept(name: str, make):
    """What this Python process makes once and keeps for its later tasks. Functions come to workers by
    value, with fresh globals, so it is kept in a module of its own."""
    state = vars(sys.modules.setdefault("_tapeloom_kept", types.ModuleType("_tapeloom_kept")))
    if name not in state:
        state[name] = make()
    return state[name]


def forget(name: str) -> None:
    """Drop what ``kept`` made, if this process has it."""
    vars(sys.modules.get("_tapeloom_kept", types.ModuleType(""))).pop(name, None)


def as_unsigned(i: int) -> int:
    return i & 0xFFFFFFFFFFFFFFFF


def as_signed(i: int) -> int:
    return i - (1 << 64) if i >= 1 << 63 else i


def hex_sha256(col):
    return F.sha2(col, 256)


#: Folds of labelled rows: a row is held out where this remainder is 0.
HELD_OUT_FOLDS = 5


def held_out(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % HELD_OUT_FOLDS == 0


#: Characters of all texts of a labelled sample together, as they come to the driver.
SAMPLE_TOTAL = 24_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int, chars: int, total: int = SAMPLE_TOTAL) -> DataFrame:
    """Rows of ``docs`` with their ``label``, for at most ``limit`` of the documents in ``labels``
    (doc_id, label), texts of at most ``chars`` characters and ``total`` characters of all.

    The same tables give the same sample: those with the smallest hash of doc_id. Only ids are
    sorted, and the few chosen go to the documents. Null labels are left out; of a repeated doc_id
    one row counts, that of the smallest text hash.
    """
    usable = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    rank = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = usable.orderBy(*rank).limit(limit)
    fit = docs.join(F.broadcast(ids), "doc_id").filter(F.length(F.coalesce("text", F.lit(""))) <= chars)
    rest = [c for c in fit.columns if c != "doc_id"]
    one = fit.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("_h"), *rest)).alias("_r")).select("doc_id", *(F.col(f"_r.{c}") for c in rest))
    # A running sum over the few chosen rows.
    upto = F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0))
    return one.withColumn("_upto", upto).filter(F.col("_upto") <= total).drop("_upto").orderBy("doc_id")


#: Sides of at most so many rows and bytes are broadcast; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 32 << 20


def small_side(df: DataFrame, *texts: str) -> DataFrame:
    """``df``, with a broadcast hint if its rows and the bytes of its columns ``texts`` are counted to
    be few. For tables that are written already, as it counts them."""
    size = df.agg(F.count("*"), *(F.coalesce(F.sum(F.octet_length(t)), F.lit(0)) for t in texts)).first()
    return F.broadcast(df) if size[0] <= BROADCAST_ROWS and sum(size[1:]) <= BROADCAST_BYTES else df
