import random

from tapeloom.llm import near_copies, simhash


def brute_sets(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """doc_id to the smallest doc_id that pairs of similarity 0.8 reach."""
    sets, at = [brute_sets(t) for _, t in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                at = [at[j] if c == at[i] else c for c in at]
    return {d: min(e for (e, _), k in zip(docs, at) if k == at[i]) for i, (d, _) in enumerate(docs)}


def edited():
    rng, docs = random.Random(11), []
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        docs.append((1000 + g, " ".join(base)))
        for e in range(3):
            own = list(base)
            for k in rng.sample(range(300), rng.choice([1, 2, 4, 6, 20])):
                own[k] = f"x{rng.randrange(3000)}"
            docs.append((2000 + 10 * g + e, " ".join(own)))
    return docs


def test_near_copies_with_edited_words_link(make):
    docs = edited() + [(1, None), (2, " "), (3, "one"), (4, "One"), (5, "a b c d e f")]
    got = {r.doc_id: r.kept_doc_id for r in near_copies.near_copies(make(docs)).collect()}
    want = brute(docs)
    assert got == want
    three_bits = {r.doc_id: r.component_id for r in simhash.near_duplicates(make(docs)).collect()}
    assert sum(want[d] != d for d in want) > 1.5 * sum(three_bits[d] != d for d in want)


def test_empty_table(make):
    assert near_copies.near_copies(make([])).collect() == []


def test_a_bucket_of_hundreds_of_near_copies_loses_no_pair(make, monkeypatch):
    """Copies edited so far that most pairs are below 0.8, and those above form many groups."""
    rng = random.Random(4)
    base, docs = [f"w{k}" for k in range(120)], []
    for g in range(60):
        root = list(base)
        for k in rng.sample(range(120), 5):
            root[k] = f"g{rng.randrange(4000)}"
        for e in range(6):
            own = list(root)
            own[rng.randrange(120)] = f"x{rng.randrange(4000)}"
            docs.append((10 * g + e, " ".join(own)))
    monkeypatch.setattr(near_copies, "SMALL_BUCKET", 8)
    got = {r.doc_id: r.kept_doc_id for r in near_copies.near_copies(make(docs)).collect()}
    want = brute(docs)
    assert got == want and len(set(want.values())) > 20
