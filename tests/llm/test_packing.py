import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeloom.llm import packing
from tapeloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_path())


@pytest.mark.parametrize("text", ["It's <|endoftext|> A", "é́ é", "tab\tb\x1cX y's 'S 12a  ÀÉß!! Straße.", " a　b İK ſ ", "don't ''s 's. ", "x" * 500, "a-b(c)\"d", "Σας ΑΣ. ﬁ ½ ²", "", "\n \n", "́a ́"])
def test_word_memory_gives_the_tokenizers_ids(encoder, text):
    assert encoder.encode(text) == encoder._ids(text)


def test_texts_together_give_the_same_ids(encoder, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PIECES", 50)
    rng = np.random.default_rng(9)
    pool = [chr(c) for c in range(256)] + list("abcdefghij  ''stmrev.,!?0123ÀÉßµªº²½ \n\tΣς́ﬁK你" * 4)
    for _ in range(20):
        texts = ["".join(rng.choice(pool, rng.integers(0, 60))) for _ in range(100)] + ["a <|endoftext|> b", ""]
        assert [x.tobytes() for x in encoder.encode_all(texts)] == [encoder._ids(t) for t in texts] == [encoder.encode(t) for t in texts]


def check(rows, docs, encoder):
    ids = {k: np.append(np.frombuffer(encoder._ids(t or ""), "<u4"), np.uint32(2)).astype("<u4") for k, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
    for k, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[k])
    assert set(by_doc) == set(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0 and at < 4096


def test_every_id_is_in_one_piece(make, edge_texts, encoder, monkeypatch):
    docs = [(d, t) for k, (d, t) in enumerate(edge_texts) if k not in (7, 9)] + [(100 + i, edge_texts[0][1] + f" {i} " * i) for i in range(60)]
    for shard in (1024, 7):
        monkeypatch.setattr(packing, "SHARD_DOCS", shard)
        check(packing.pack(make(docs).repartition(3), tokenizer_path()).collect(), docs, encoder)


def test_repeated_rows_and_ids(make, edge_texts):
    rows = packing.pack(make(edge_texts), tokenizer_path(), with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert sum(r.length for r in rows if r.doc_id == 7) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 7)
    assert packing.pack(make([]), tokenizer_path()).collect() == []


def scores(query, docs, stats):
    """BM25 by its formula, a document at a time."""
    out = []
    for ids in docs:
        tf, size = Counter(ids), len(ids)
        out.append(sum(stats.idf[t] * tf[t] * (packing.K1 + 1) / (tf[t] + packing.K1 * (1 - packing.B + packing.B * size / stats.mean)) for t in sorted(set(query)) if t in tf))
    return out


def statistics_of(docs, terms):
    df = np.zeros(terms)
    for ids in docs:
        df[list(set(ids))] += 1
    return packing.count_statistics(df, len(docs), sum(map(len, docs)))


def test_neighbours_are_those_of_the_formula():
    rng = np.random.default_rng(3)
    docs = [np.minimum(rng.pareto(0.8, rng.integers(1, 90)) * 9, 299).astype("<u2") for _ in range(120)]
    stats = statistics_of([d.tolist() for d in docs], 300)
    shard = packing._Shard([packing.Unit(i, v, 0, len(v)) for i, v in enumerate(docs)], stats)
    shard.free[[3, 50]] = False
    for seed in (3, 50):
        want = scores(docs[seed].tolist(), [d.tolist() for d in docs], stats)
        found = shard.neighbours(seed).tolist()
        assert set(found) == {k for k, x in enumerate(want) if x > 0} - {3, 50}
        assert np.allclose(sorted((want[k] for k in found), reverse=True), [want[k] for k in found], rtol=1e-5)


def topical(seed):
    """Documents of 24 topics and some near copies, in mixed order."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) for _ in range(rng.integers(2, 5)))
    common, topics = [word() for _ in range(300)], [[word() for _ in range(40)] for _ in range(24)]
    texts = [" ".join(rng.choice(topics[k % 24] if rng.random() < 0.4 else common) for _ in range(120)) for k in range(1440)]
    texts += [t.replace(" ", " again ", 1) for t in texts[:60]]
    return [texts[k] for k in rng.permutation(len(texts))]


def test_shards_hold_the_neighbours_of_the_whole_corpus(make, encoder, monkeypatch):
    """Of each document's five best neighbours by BM25 over all documents, 0.9 lie in its shard. What is lost
    lies at the shards' ends: shards of 240, so that every fourth topic is cut, hold 0.892."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 400)
    docs = list(enumerate(topical(5)))
    tokens = packing.encode_documents(make(docs).repartition(7), tokenizer_path(), packing.fit_router(make(docs), encoder)).cache()
    stats = packing.corpus_statistics(tokens, encoder.terms)
    ids = [np.append(x, packing.END_ID) for x in encoder.encode_all([t for _, t in docs])]
    want = statistics_of([x.tolist() for x in ids], encoder.terms)
    assert np.allclose(stats.idf, want.idf) and stats.mean == want.mean
    order = [r.doc_id for r in packing.shards(tokens).coalesce(1).collect()]
    shard_of = {d: k // packing.SHARD_DOCS for k, d in enumerate(order)}
    all_docs = packing._Shard([packing.Unit(i, v.astype("<u2"), 0, len(v)) for i, v in enumerate(ids)], stats)
    best = {d: [k for k in all_docs.neighbours(d).tolist() if k != d][:5] for d in range(0, len(docs), 5)}
    held = [shard_of[k] == shard_of[d] for d, found in best.items() for k in found]
    assert len(set(shard_of.values())) == 4 and sum(held) >= 0.9 * len(held)


def test_a_window_is_filled_by_its_seeds_neighbours():
    rng = np.random.default_rng(1)
    topic = lambda k: (rng.integers(0, 60, 700) + 3 + 60 * (k % 5)).astype("<u2")
    units = [packing.Unit(k, v, 0, len(v)) for k, v in enumerate(topic(k) for k in range(60))]
    packer = packing._Packer(0, statistics_of([u.ids.tolist() for u in units], 400))
    rows = list(packer.shard(units))
    windows = defaultdict(list)
    for r in rows:
        windows[r[4]].append(r[0] % 5)
    pure = [len(set(w)) == 1 for w in windows.values()]
    assert sum(pure) >= 0.8 * len(pure) and sum(len(r[2]) for r in rows) == 4096 * len(windows)
