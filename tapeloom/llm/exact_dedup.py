"""Exact duplicates by a stateful stream whose state is kept on disk and never expires.

A catalogue names every row by its text's digest, its doc_id and a content locator, the file and the row
of the file that hold the text; texts themselves are not moved. The catalogue is read as a stream. Its keyed
state, in RocksDB under the shared folder, holds for each digest the stable identifier (the largest doc_id so
far), the locator of that row and the number of rows. Counts are summed in each task before they meet the
state, so a digest that a third of all rows share reaches its state as one row a task.

A digest only claims that texts are equal. For every digest that was hit again, the bytes at the locator are
fetched and compared with the bytes of all rows that claim them; a digest of different texts is
grouped by the texts themselves.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, delete, shared_path, small_side

STATE = "spark.sql.streaming.stateStore"
#: State on disk; a batch uploads what it changed, and small stores don't reserve disk ahead.
STATE_CONF = {
    f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{STATE}.rocksdb.allowFAllocate": "false",
}
#: Bytes of the catalogue that a micro-batch takes; a row has some 60.
BATCH_BYTES = 1 << 30


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame, digest=sha256) -> DataFrame:
    """(digest, doc_id, file, row, text) of ``docs`` (doc_id, text), which has to read files; null texts
    are empty ones. Any column called _metadata is none of the locator's."""
    at, text = docs.metadataColumn("_metadata"), F.coalesce("text", F.lit(""))
    return docs.select(digest(text).alias("digest"), "doc_id", at["file_path"].alias("file"), at["row_index"].alias("row"), text.alias("text"))


def _readable(docs: DataFrame) -> DataFrame:
    """``docs``, written first if it does not come from Parquet files, whose rows can be located."""
    try:
        located(docs)
    except AnalysisException:
        return cut(docs.select("doc_id", "text"), "located")
    return docs


def seen(catalogue: DataFrame) -> DataFrame:
    """(digest, keeper, n) of a catalogue (digest, doc_id, file, row), streaming or not: keeper is the row
    of the largest doc_id, then of the largest locator; rows without doc_id come last."""
    return catalogue.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keeper"), F.count("*").alias("n"))


def absorb(spark: SparkSession, catalogue: str, state: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Takes the files of the folder ``catalogue`` that the state in the folder ``state`` has not seen, and gives
    (digest, keeper, n) of all digests ever seen. A call that failed is repeated and goes on where
    it was; a later call with more files goes on from the same state.
    """
    schema = "digest binary, doc_id long, file string, row long"
    own = spark.newSession()  # so that the user's session keeps its settings
    for name, value in STATE_CONF.items():
        own.conf.set(name, value)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    rows = own.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(catalogue)
    updates = f"{state}/updates"

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{updates}/batch={batch}")  # a repeated batch replaces itself

    run = seen(rows).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    told = spark.read.schema("digest binary, keeper struct<doc_id: long, file: string, row: long>, n long").parquet(f"{updates}/batch=*")
    # The state only grows, so a digest's last word is the one of the most rows.
    return told.groupBy("digest").agg(F.max_by("keeper", "n").alias("keeper"), F.max("n").alias("n"))


def _at_keeper() -> Column:
    return (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))


def refuted(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The digests in ``hits`` (digest, keeper) that rows of other bytes than the keeper's have. ``rows`` are
    ``located`` ones, ``hits`` is written."""
    contents = cut(rows.join(small_side(hits), "digest").filter(_at_keeper()).select("digest", F.col("text").alias("kept_text")), "contents")
    claims = rows.join(small_side(hits.select("digest")), "digest", "left_semi")  # so that no other text is moved
    return claims.join(small_side(contents, "kept_text"), "digest").filter("text <> kept_text").select("digest").distinct()


def exact_duplicates(docs: DataFrame, digest=sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row for each row of ``docs`` (doc_id, text).

    Rows of the same text, to the byte, are a group; of each the row of the largest doc_id stays, of repeated
    rows the one last in file order. A null text is an empty one and equal to it. Rows without
    doc_id are kept where no row of their text has one; then keep_id is null. Texts of any length
    are read whole. An empty table gives no rows. Other columns are ignored. ``digest`` makes a
    binary column of the text; a weak one costs time and changes nothing but that column.
    """
    spark, docs = docs.sparkSession, _readable(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    folder = shared_path(spark, "exact-duplicates")
    rows = located(docs, digest)
    rows.drop("text").write.parquet(f"{folder}/catalogue")
    catalogue = spark.read.parquet(f"{folder}/catalogue")
    hits = cut(absorb(spark, f"{folder}/catalogue", f"{folder}/state", batch_bytes).filter("n > 1"), "hits")
    delete(spark, f"{folder}/state")
    wrong = cut(refuted(rows, hits.select("digest", "keeper")), "refuted")
    found = catalogue.join(small_side(hits), "digest", "left")
    if not wrong.isEmpty():
        found = found.join(wrong, "digest", "left_anti")
        apart = cut(rows.join(small_side(wrong), "digest"), "apart")
        by_text = apart.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keeper"), F.count("*").alias("n"))
        found = found.unionByName(apart.join(by_text, ["digest", "text"]).drop("text").select(*found.columns))
    return found.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | _at_keeper()).alias("kept"),
        "digest",
    )
