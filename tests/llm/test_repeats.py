import hashlib
import random
from collections import Counter

import pytest

from tapeloom.llm import repeats


def brute(texts, length):
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(b[i : i + length] for (d, _), b in zip(texts, data) if d is not None for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(texts, data):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if d is not None and seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other, line = text(60), text(45), text(33) + "\n"
    texts = [(i, text(rng.randrange(10, 90))) for i in range(12)]
    texts += [(20 + i, text(rng.randrange(0, 30)) + passage + text(rng.randrange(0, 30))) for i in range(6)]
    texts += [(40 + i, passage[rng.randrange(90) :] + text(8) + other[: rng.randrange(150, 260)]) for i in range(8)]
    near = list(text(200))
    for i in range(6):
        near[rng.randrange(len(near))] = "#"
        texts.append((60 + i, "".join(near)))
    return texts + [(80, line * 9), (81, "a" * 700), (82, "ab" * 300), (83, "x" + "a" * 250), (84, "ab" * 130 + "q" + "ab" * 130)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(make, seed):
    texts = corpus(seed)
    assert result(repeats.remove_repeats(make(texts))) == brute(texts, 200)


def test_edges(make, edge_texts):
    texts = [x if x[0] != 6 else (6, x[1][:6000]) for x in edge_texts]
    assert result(repeats.remove_repeats(make(texts))) == brute(texts, 200)


def test_empty_table(make):
    assert repeats.remove_repeats(make([])).collect() == []


def test_long_text_and_spans(make, edge_texts):
    long = edge_texts[5][1]
    found = {r.doc_id: r for r in repeats.remove_repeats(make([(1, long), (2, long[1000:2000]), (3, "tail")])).collect()}
    assert (found[1].n_removed, [tuple(s) for s in found[1].spans]) == (len(long[1000:2000].encode()), [(len(long[:1000].encode()), len(long[:2000].encode()))])
    assert found[2].n_removed == found[2].n_bytes and found[3].n_removed == 0


@pytest.mark.parametrize("period", [1, 2, 6, 37, 150, 170, 400])
def test_periodic_text_is_not_a_phrase_a_period(make, period):
    rng = random.Random(period)
    text = "".join(rng.choice("abcdefgh") for _ in range(period)) * (12_000 // period)
    _, _, lo, hi, _, _, n, end = repeats.phrases([text.encode()])
    assert len(lo) <= 60 or period >= 150  # short periods have one trigger each, longer ones few
    assert len(lo) <= len(text) / 40 and lo[0] == 0 and end[-1] == len(text) - 200 and (end >= hi).all() and (lo[1:] == end[:-1] + 1).all()
    texts = [(1, text), (2, text[: 150 + period] + "#" + text[:300]), (3, "x" * 199)]
    assert result(repeats.remove_repeats(make(texts))) == brute(texts, 200)
