"""The driver plans near-dedup's many small jobs: what it plans stays small, and gives the same rows."""

import random

from pyspark.sql import functions as F

from tapeloom.llm.components import _large_star, _small_star
from tapeloom.llm.simhash import ring_holds


def chains_hold(a, b, max_bits=20, segments=8):
    bits = 64 // segments
    near = [((a ^ b) >> bits * i & (1 << bits) - 1).bit_count() for i in range(segments)]
    return (a ^ b).bit_count() <= max_bits and any(
        all(segments * sum(near[(i + j) % segments] for j in range(n)) <= max_bits * n for n in range(1, segments + 1)) for i in range(segments)
    )


def test_ring_is_planned_small_and_holds_for_the_same_pairs(spark):
    rng, signed = random.Random(3), lambda x: x - (1 << 64) if x >> 63 else x
    pairs = []
    for k in range(400):
        a, b = rng.getrandbits(64), 0
        for bit in rng.sample(range(64), k % 41):
            b |= 1 << bit
        pairs.append((a, a ^ b))
    pairs += [(5, 5), (0, (1 << 20) - 1), (0, (1 << 21) - 1), (0, (1 << 64) - 1), (1 << 63, 0)]
    rows = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
    got = rows.select("a", "b", ring_holds(F.col("a"), F.col("b"), 20, 8).alias("near"))
    assert [r.near for r in got.collect()] == [chains_hold(a, b) for a, b in pairs]
    assert 100 < sum(chains_hold(a, b) for a, b in pairs) < 300
    # Written out, the chains were 288 counts of bits.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("bit_count") < 40


def test_a_round_of_stars_reads_its_edges_four_times(spark, tmp_path):
    rng = random.Random(4)
    edges = {(max(p), min(p)) for p in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if p[0] != p[1]}
    spark.createDataFrame(sorted(edges), "a long, b long").write.parquet(f"{tmp_path}/edges")
    df = spark.read.parquet(f"{tmp_path}/edges")
    large, round_ = _large_star(df, len(edges)), _small_star(_large_star(df, len(edges)), len(edges))
    # A union had planned the edges twelve times, and each read of a table is a broadcast of the driver.
    assert round_._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 4

    near = {v: {v} for e in edges for v in e}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    star = {(v, min(near[u])) for u in near for v in near[u] if v > u}
    assert {tuple(r) for r in large.collect()} == star
    least = {a: min(b for x, b in star if x == a) for a, _ in star}
    moved = {(b, least[a]) for a, b in star if b > least[a]}
    found = [tuple(r) for r in round_.collect()]
    assert len(found) == len(set(found)) and set(found) == moved | set(least.items())
