"""Stages on tables with the operators' own names as columns, without rows, with nulls and repeated rows."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES = ["score", "_score", "_fm_score", "row_id", "row_hash", "_row_hash", "_h", "h", "_doc_id", "t", "bands", "term", "ids", "node"]


@pytest.fixture
def docs(spark, make, edge_texts):
    table = make([*edge_texts, (None, edge_texts[0][1]), (None, "m n o"), (None, "m n o")])
    return table.select("*", *(F.lit(f"own {c}").alias(c) for c in NAMES if c not in table.columns)).withColumn("score", F.lit(7.5))


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES[:4]], ids=lambda f: f.__name__)
def test_other_columns_keep_their_values(spark, docs, stage):
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    assert rows and all(r["score"] == 7.5 and all(r[c] == f"own {c}" for c in NAMES if c not in ("score", "h", "term") and r[c] != "h") for r in rows)
    if stage is pipeline.secret_scans:
        assert len(rows) == docs.count()


def test_packing_leaves_other_columns_out(spark, docs):
    got = pipeline.bm25_packing(spark, docs, SF)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=lambda f: f.__name__)
def test_an_empty_table_stays_empty(spark, docs, stage):
    assert stage(spark, docs.filter("doc_id > 99"), SF).count() == 0


def test_text_ids(spark, make, edge_texts):
    docs = make(edge_texts).withColumn("doc_id", F.col("doc_id").cast("string"))
    got = pipeline.simhash_near_dedup(spark, docs, SF)
    assert dict(got.dtypes)["doc_id"] == "string" and {r.doc_id for r in got.collect()} == {"1", "2", "5", "6", "8", "9"}
