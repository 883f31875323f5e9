"""The scores of the queries of the two classifiers, document by document, by their formulas alone."""

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import quality, toxicity
from tapeloom.llm.common import held_out, labelled_sample, load
from tapeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels.filter(~held_out(F.col("doc_id")))


def test_every_toxicity_score_is_a_noisy_or_of_its_sentences(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    got = {r.doc_id: r for r in QUERIES["op2_toxicity_mil"](spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(got) == set(texts)
    some = 0
    for d, text in texts.items():
        clean, found = 1.0, []
        for m in re.finditer(toxicity._SENTENCE, text):
            words = set(re.findall(toxicity._WORD, m[0].lower()))
            if words:
                z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w))
                p = 1 / (1 + math.exp(-z))
                clean *= 1 - p
                found += [(m.start(), m.end())] if p >= 0.5 else []
        r = got[d]
        assert math.isclose(r.score, 1 - clean, rel_tol=1e-6, abs_tol=1e-9) and r.predicted == (r.score >= 0.5)
        assert [(s.start, s.end) for s in r.sentences] == found
        some += len(found)
    assert some


def test_every_quality_score_is_the_sum_over_all_pairs(spark, tables):
    docs, labels = tables
    m = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    got = {r.doc_id: r for r in QUERIES["op6_quality_fm"](spark, SF).collect()}
    rows = docs.collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        i, x = m.inputs(r.text or "", r.n_chars)
        dots = (m.v[i].astype(float) @ m.v[i].astype(float).T) * np.outer(x, x)
        z = m.w0 + float(m.w[i] @ x) + float(np.triu(dots, 1).sum())
        own = got[r.doc_id]
        assert math.isclose(own.score, 1 / (1 + math.exp(-z)), rel_tol=1e-3, abs_tol=1e-6) and own.predicted == (own.score >= 0.3)


def test_the_machine_is_fitted_in_a_task_as_in_the_driver(spark, monkeypatch):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = labelled_sample(docs.select("doc_id", "text", "n_chars"), labels, 100, quality.SAMPLE_CHARS).collect()
    want = quality.fit([(r.text or "", r.n_chars, r.label) for r in rows])
    driver, fit = os.getpid(), quality.fit

    def elsewhere(rows):
        assert os.getpid() != driver
        return fit(rows)

    monkeypatch.setattr(quality, "fit", elsewhere)
    got = quality.train(docs, labels, 100)
    assert got.w0 == want.w0 and np.array_equal(got.w, want.w) and np.array_equal(got.v, want.v)
    assert quality.train(docs.limit(0), labels).edges is None
