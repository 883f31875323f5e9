"""The corpus pipeline: documents to packed training sequences, in five stages.

A stage is a function of (spark, docs, sf_dir); ``run`` writes each one's result as Parquet in the
shared folder and gives it to the next as its ``docs``. All stages but the last return the columns of
documents, whatever these are besides doc_id, text and n_chars (a dot in a name aside). An empty table stays empty. A null text
counts as an empty one; a null doc_id is a value like others, but in the classifier's sample. A doc_id is a
whole number, or a text of one. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import decontaminate, near_copies, packing, quality, secret_scan
from tapeloom.llm.common import cut, held_out, load, own_columns, small_side, unused
from tapeloom.llm.queries import tokenizer_path

#: Documents that score less go.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the factorisation machine does not reject. Repeated rows share their fate;
    columns of any other name stay as they are."""
    labels = load(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    machine = quality.train(docs, labels)
    (score,) = unused(docs, "score")
    return quality.score(docs, machine, score).filter(F.col(score) >= LEAST_QUALITY).select(*own_columns(docs))


def _same(docs: DataFrame, rows: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """``rows`` (doc_id, h), written, and the condition that joins them to ``docs``, h being the text's hash:
    rows of one doc_id are told apart, and repeated rows share their fate."""
    d, h = unused(docs, "row_id", "row_hash")
    rows = cut(rows.select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct(), name)
    return small_side(rows), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (near_copies.text_hash() == F.col(h))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows in ``gone`` (doc_id, h)."""
    gone, same = _same(docs, gone, "gone")
    return docs.join(gone, same, "left_anti").select(*own_columns(docs))


def _once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with one row of each (doc_id, h) in ``repeated``; other rows are not shuffled."""
    again, same = _same(docs, repeated, "repeated")
    (h,) = unused(docs, "row_hash")
    one = docs.join(again, same, "left_semi").withColumn(h, near_copies.text_hash()).dropDuplicates(["doc_id", h])
    return docs.join(again, same, "left_anti").unionByName(one.select(*own_columns(docs)))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest doc_id, of each group of near copies: texts whose
    five-word shingles have a similarity of 0.8 or more link, found by operator 7's fingerprints and ring.

    Rows are told apart by doc_id and text, so two texts of one doc_id are decided alone; of repeated
    rows one stays. Rows without doc_id come last in a group.
    """
    found = cut(near_copies.near_copies(docs), "near-copies")
    kept = F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("h") == F.col("kept_h"))
    repeated = found.filter(kept).groupBy("doc_id", "h").agg(F.count("*").alias("n")).filter("n > 1")
    return _once(_without(docs, found.filter(~kept)), repeated)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows without a window of a benchmark item. Rows are told apart by doc_id and text, so a
    clean text stays where another of its doc_id goes; repeated rows all stay or all go."""
    return _without(docs, decontaminate.hit_rows(docs, load(spark, sf_dir, "benchmark")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, their secrets masked; n_chars follows the text. Repeated rows stay, null and empty
    texts too."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*own_columns(docs))


def bm25_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4,096 tokens, with their ids. Repeated rows are packed as
    often as they come; null and empty texts are the end's id alone; other columns are left out."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", bm25_packing),
]

#: SQL expresses neither the classifier nor the fingerprints; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
