import random
import re
from collections import Counter

import pytest

from tapeloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items):
    out = []
    for d, t in texts:
        w, hit, own = words(t), set(), set()
        for i, it in items:
            v = words(it)
            n = min(10, len(v))
            windows = {tuple(v[k : k + n]) for k in range(max(1, len(v) - 9))} if v and i is not None else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p : p + n]) in windows and d is not None:
                    hit.update(range(p, p + n))
                    own.add(str(i))
        out.append((d, len(w), len(hit), len(own), tuple(sorted(own))))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in df.collect()), key=str)


@pytest.fixture
def bench(spark):
    return lambda items: spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, wid long, n long")


def test_against_brute_force(make, bench, edge_texts):
    rng = random.Random(2)
    vocab = ["the", "of", "Été", "ΑΣ", "x9", "İn", "ß", "rare1", "rare2", "a"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", ".\n", " - "]) for _ in range(n))
    items = [(i, text(rng.randrange(8, 25))) for i in range(8)] + [(20, "one two three"), (21, "two Three"), (22, ""), (23, None), (None, text(12)), (10, "the of the of the of the of the of")]
    texts = list(edge_texts) + [(30, "The one, two THREE!"), (None, "one two three"), (31, "...one two three"), (32, "the of " * 30)]
    for i, (_, t) in enumerate(items[:8]):
        v = t.split()
        texts += [(40 + i, text(9) + " " + t.upper() + " " + text(5)), (50 + i, " ".join(v[:12]) + " " + text(4) + " ".join(v[3:])), (60 + i, " ".join(v[:9]))]
    assert result(decontaminate.exact_matches(make(texts), bench(items))) == brute(texts, items)


def test_no_items_and_no_documents(make, bench, edge_texts):
    assert result(decontaminate.exact_matches(make(edge_texts), bench([]))) == brute(edge_texts, [])
    assert result(decontaminate.exact_matches(make([]), bench([(1, "a b c")]))) == []


def test_main_path_is_native(make, bench, edge_texts):
    plan = decontaminate.exact_matches(make(edge_texts), bench([(1, "alpha beta gamma")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def near_brute(texts, items, span=20, rarest=3):
    """(doc_id, item_id, pos) by looking around each place."""
    corpus = Counter(w.lower() for _, t in texts for w in words(t))
    out = set()
    for i, it in items:
        own = sorted((corpus[w], w) for w in {w.lower() for w in words(it)} if corpus[w])[:rarest]
        for d, t in texts:
            w = [x.lower() for x in words(t)]
            for p, x in enumerate(w):
                if own and i is not None and d is not None and x == own[0][1] and {y for _, y in own} <= set(w[max(0, p - span) : p + span + 1]):
                    out.add((d, str(i), p))
    return sorted(out)


def test_proximity(make, bench, edge_texts):
    texts = [(1, "zeta filler words then kappa and some more until omega ends"), (2, "zeta " + "pad " * 50 + "kappa omega"), (3, "kappa zeta omega"), (4, None)]
    found = decontaminate.proximity_matches(make(texts), bench([(5, "omega kappa zeta")]), span=12).collect()
    assert {r.doc_id for r in found} == {1, 3} and {r.item_id for r in found} == {"5"}


@pytest.mark.parametrize("span", [3, 20])
def test_proximity_against_looking_around(make, bench, edge_texts, span):
    rng = random.Random(4)
    vocab = ["alpha", "Beta", "gamma", "delta", "ETA", "iota", "kappa", "nu", "xi", "pi"]
    text = lambda n: " ".join(rng.choice(vocab[: rng.randrange(2, 11)]) for _ in range(n))
    texts = [x for x in edge_texts if x[0] not in (6,)] + [(20 + i, text(rng.randrange(0, 90))) for i in range(30)] + [(None, "pi xi nu"), (60, "xi pi nu nu pi xi")]
    items = [(i, text(rng.randrange(1, 6))) for i in range(12)] + [(50, "pi"), (51, "none such"), (52, "xi none"), (53, ""), (54, None), (None, "pi")]
    found = decontaminate.proximity_matches(make(texts), bench(items), span=span).collect()
    want = near_brute(texts, items, span)
    assert sorted((r.doc_id, r.item_id, r.pos) for r in found) == want and want
    near = {}
    for d, i, _ in want:
        near.setdefault(d, set()).add(i)
    assert all(r.near_items == sorted(near.get(r.doc_id, ())) for r in decontaminate.matches(make(texts), bench(items), span=span).collect())


def test_proximity_of_nothing(make, bench, edge_texts):
    assert decontaminate.proximity_matches(make([]), bench([(1, "a b")])).collect() == []
    assert decontaminate.proximity_matches(make(edge_texts), bench([])).collect() == []
