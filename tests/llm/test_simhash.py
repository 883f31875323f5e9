import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tapeloom.llm import simhash
from tapeloom.llm.components import connected_components


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Union-find over all pairs of (doc_id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j][1]).count("1") <= 3:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, min(x for x in groups[find(i)] if x is not None)) for i, (d, _) in enumerate(prints))


def test_hash_is_sparks_xxhash64(spark):
    text = "a café b"
    own = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert own & (2**64 - 1) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_against_brute_force(make, edge_texts):
    rng = random.Random(3)
    texts = list(edge_texts)
    for i in range(20, 60):
        base = [f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 40))]
        texts += [(i, " ".join(base)), (i + 100, " ".join(base[:-1] + ["x"]))]
    found = simhash.near_duplicates(make(texts)).collect()
    prints = [(d, brute(t)) for d, t in texts]
    assert sorted((r.doc_id, r.fp & (2**64 - 1)) for r in found) == sorted(prints)
    assert sorted((r.doc_id, r.component_id) for r in found) == components(prints)


def test_links_of_dense_fingerprints(spark):
    """Every pair within three bits is connected, in a ball where all share buckets, and no other."""
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in prints]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"))
    got = {r.node & (2**64 - 1): r.component for r in connected_components(links).collect()}
    want = dict(components([(x, x) for x in prints]))
    for x in prints:
        for y in prints:
            if x < y:
                same = x in got and y in got and got[x] == got[y]
                assert same == (want[x] == want[y])


def test_empty_table(make):
    assert simhash.near_duplicates(make([])).collect() == []


def test_components_of_chains_hubs_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 5), (7, None)] + [(300, 301)] * 3
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 300, 301: 300}
