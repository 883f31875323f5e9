"""Stages on repeated rows and on two texts of one doc_id."""

import corpus_pipeline as pipeline
from tapeloom.llm import near_copies


def texts_by_id(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_dedup_decides_each_row(spark, make, edge_texts):
    got = texts_by_id(pipeline.simhash_near_dedup(spark, make(edge_texts), ""))
    kept = {1, 2, 5, 6, 9}  # only A-Z are lower-cased, so 9 differs
    want = [(d, t) for d, t in edge_texts if d in kept] + [(8, "other text\nother text\nlast")]
    assert got == sorted(want, key=str)


def test_one_of_repeated_rows_stays(spark, make):
    docs = [(4, "a b c d e f")] * 3 + [(5, "g h i j k l"), (None, "m n o"), (None, "m n o"), (None, "a b c d e f")]
    got = texts_by_id(pipeline.simhash_near_dedup(spark, make(docs), ""))
    assert got == sorted([(4, "a b c d e f"), (5, "g h i j k l"), (None, "m n o")], key=str)


def test_decontamination_leaves_a_clean_text_of_the_same_doc_id(spark, make, edge_texts, monkeypatch):
    passage = " ".join(edge_texts[0][1].split()[20:40])
    bench = spark.createDataFrame([("b1", passage)], "item_id string, text string")
    monkeypatch.setattr(pipeline, "load", lambda *a: bench)
    got = texts_by_id(pipeline.benchmark_decontamination(spark, make(edge_texts), ""))
    body = edge_texts[0][1]
    want = [(d, t) for d, t in edge_texts if t is None or body not in t]
    assert got == sorted(want, key=str) and (8, "other text\nother text\nlast") in got


def test_hash_of_null_text_is_that_of_the_empty_one(make):
    assert len({r.h for r in near_copies.near_copies(make([(1, None), (2, "")])).collect()}) == 1
