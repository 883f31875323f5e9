"""The pipeline's stages on the smallest tables, each against a plain version of its decision."""

import importlib.util
import re
import zlib

import numpy as np
import pytest

from tapeloom.llm import packing, secret_scan
from tapeloom.llm.common import cut
from tapeloom.llm.queries import QUERIES, tokenizer_path

from .test_decontaminate import brute as benchmark_hits
from .test_near_copies import brute as near_groups

SF = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(pipeline.STAGES):
        out.append(cut(f(spark, out[-1], SF), f"test-stage-{k}"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:5]) and pipeline.ORACLE_SQL is None


def test_quality_keeps_what_the_query_predicts(spark, stages):
    good = {r.doc_id for r in QUERIES["op6_quality_fm"](spark, SF).filter("predicted = 1").collect()}
    assert set(rows(stages[1])) == good


def test_one_of_each_group_of_near_copies_stays(stages):
    """Five-word shingles, similarity 0.8 or more, against all pairs."""
    groups = near_groups([(d, r.text) for d, r in rows(stages[1]).items()])
    assert set(rows(stages[2])) == {d for d, least in groups.items() if d == least} and len(set(groups.values())) < len(groups)


def test_no_benchmark_passage_stays(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [(d, r.text) for d, r in rows(stages[2]).items()]
    clean = {d for d, _, n_hit, _, _ in benchmark_hits(texts, items) if not n_hit}
    assert set(rows(stages[3])) == clean


def test_secrets_are_masked_and_nothing_else_changes(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for d, r in after.items():
        spans = sorted((m.start(), m.end()) for rule in secret_scan.RULES for m in re.finditer(rule.pattern, before[d].text, re.ASCII) if m.end(rule.group) - m.start(rule.group) >= rule.least)
        want, last = "", 0
        for s, e in spans:
            if s >= last:
                want += before[d].text[last:s] + "[SECRET]"
            last = max(last, e)
        assert r.text == want + before[d].text[last:] and r.n_chars == len(r.text)


def test_all_tokens_are_packed(spark, stages):
    encoder, docs = packing.Encoder(tokenizer_path()), rows(stages[4])
    pieces = stages[5].collect()
    assert {p.doc_id for p in pieces} == set(docs)
    for d, r in docs.items():
        ids = np.append(np.frombuffer(encoder._ids(r.text), "<u4"), np.uint32(2)).astype("<u4")
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
        assert np.array_equal(np.concatenate([p.ids for p in own]), ids)
    assert pipeline.run(spark, SF).count() == len(pieces)
