import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import quality, toxicity
from tapeloom.llm.common import held_out

DATA = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    pos = label == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def test_fold_is_crc32_of_text(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, -3, 123456789)], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("name, label, least", [("op2_toxicity_mil", "toxic", 0.95), ("op6_quality_fm", "quality", 0.98)])
def test_held_out_accuracy(spark, name, label, least):
    from tapeloom.llm.queries import QUERIES

    rows = QUERIES[name](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", label).toPandas()
    assert auc(rows["score"].to_numpy(), rows[label].to_numpy()) > least
    assert (rows["predicted"] == rows[label]).mean() > 0.97
    assert rows["score"].between(0, 1).all()


def test_noisy_or_finds_the_sentence():
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed".split()) for _ in range(8))
    texts, labels = [], []
    for i in range(120):
        s = [clean() for _ in range(5)]
        if i % 3 == 0:
            s[rng.randrange(5)] += " vilest" + rng.choice("abc") + " " + clean()
        texts.append(". ".join(s))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts, labels)
    for t, y in zip(texts, labels):
        score, spans = model.score(t)
        assert (score >= 0.5) == y
        assert len(spans) == y and all("vilest" in t[s:e] for s, e, _ in spans)
    score, _ = model.score(texts[0])
    z = [x for x, _, _ in model.logits(texts[0])]
    assert score == pytest.approx(1 - np.prod(1 - 1 / (1 + np.exp(-np.array(z)))))


def test_factorisation_identity():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = [(" ".join(rng.choice(words) for _ in range(30)) + ("***" if i % 2 else ""), 90, 1 - i % 2) for i in range(60)]
    m = quality.fit(rows)
    i, x = m.inputs(rows[0][0], 90)
    pairs = sum(float(m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
    z = m.w0 + float(m.w[i] @ x) + pairs
    assert m.score(rows[0][0], 90) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)
    assert all((m.score(t, n) >= 0.5) == y for t, n, y in rows)


def test_edges(spark, make, edge_texts):
    docs = make(edge_texts)
    labels = spark.createDataFrame([(1, 1), (8, 0), (9, 0), (7, 1), (2, 0), (99, 1), (5, None), (None, 1)], "doc_id long, label int")
    model, machine = toxicity.train(docs, labels), quality.train(docs, labels)
    tox = {(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()}
    assert {0.0} == {s for d, s in tox if d in (2, 3, 4)}
    scored = quality.score(docs, machine)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert scored.filter("score between 0 and 1").count() == docs.count()
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {1.0}
    assert toxicity.score(make([]), model).count() == quality.score(make([]), machine).count() == 0
