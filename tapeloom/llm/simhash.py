"""Near-duplicate texts by 64-bit SimHash, with candidates from the pigeonring principle.

A fingerprint is cut into four segments of 16 bits that stand in a ring. If two fingerprints differ
in at most ``max_bits`` = 3 bits, some segment i starts a chain whose first 1, 2, 3 and 4 segments
differ in at most 3/4, 6/4, 9/4 and 12/4 bits in total, that is in 0, 1, 2 and 3. The first two
budgets make the join key: segment i is equal, and of the next segment's two bytes one is equal, as
it differs in one bit at most. The rest of the chain is tested on a candidate before the full
Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import as_signed, cut, text_batches
from tapeloom.llm.components import connected_components

SEGMENTS, SEGMENT_BITS, MAX_BITS = 4, 16, 3


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 for a text without words.

    Words are what stands between ASCII white space, A-Z in lower case. A text of fewer words than
    ``shingle`` has one shingle, the whole sequence.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    return simhash(shingle_hashes(words, shingle, seed))


def shingle_hashes(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, joined by spaces; of the whole sequence if it is shorter."""
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(joined, seed)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return np.array([digest(joined[s : e - 1], seed) for s, e in zip([0, *ends], ends[shingle - 1 :])], "<u8")


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the ``hashes``."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [as_signed(fingerprint(t, shingle, seed)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, i: int, bits: int = SEGMENT_BITS) -> Column:
    return F.shiftrightunsigned(fp, bits * (i % (64 // bits))).bitwiseAND((1 << bits) - 1)


def ring_holds(a: Column, b: Column, max_bits: int, segments: int) -> Column:
    """Some start has a chain around the whole ring that keeps within its budgets, and the distance is at
    most ``max_bits``. The counts are worked out once and the chains are walked as arrays: written out, all chains
    are some thousand expressions, which the driver's planner copies again and again."""
    whole, bits = a.bitwiseXOR(b), 64 // segments
    near = F.array(*(F.bit_count(_segment(whole, i, bits)) for i in range(2 * segments)))
    starts, lengths = F.sequence(F.lit(1), F.lit(segments)), F.sequence(F.lit(1), F.lit(segments))

    def holds(counts: Column) -> Column:
        total = lambda start, length: F.aggregate(F.slice(counts, start, length), F.lit(0), lambda t, x: t + x)
        return F.exists(starts, lambda start: F.forall(lengths, lambda length: total(start, length) * segments <= length * max_bits))

    return (F.bit_count(whole) <= max_bits) & F.exists(F.array(near), holds)


def _keys(fps: DataFrame) -> DataFrame:
    """Eight rows (fp, start, key) for a fingerprint: each segment with each byte of the next."""
    keys = []
    for i in range(SEGMENTS):
        for half in (0, 1):
            byte = F.shiftrightunsigned(_segment(F.col("fp"), i + 1), 8 * half).bitwiseAND(0xFF)
            table = 2 * i + half
            keys.append(F.struct(F.lit(i).alias("start"), (F.lit(table << 24) + F.shiftleft(_segment(F.col("fp"), i), 8) + byte).alias("key")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.start", "k.key")


def _chain_holds(a: Column, b: Column, start: Column) -> Column:
    """Each prefix of the ring's chain from ``start`` keeps within its proportional budget."""
    whole = a.bitwiseXOR(b)
    out = F.lit(False)
    for i in range(SEGMENTS):
        segs = [F.bit_count(_segment(whole, i + j)) for j in range(SEGMENTS)]
        ok, total = F.lit(True), F.lit(0)
        for length, s in enumerate(segs, 1):
            total = total + s
            ok = ok & (total <= MAX_BITS * length // SEGMENTS)
        out = out | ((start == i) & ok)
    return out


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just the distinct fingerprints ``fps`` (fp) that chains of links of
    at most three bits connect.

    In a bucket of equal keys each fingerprint near the smallest one is linked to it; of other pairs
    those are left out whose two ends both are, so a dense bucket does not emit all its pairs.
    """
    keys = _keys(fps)
    busy = keys.groupBy("start", "key").agg(F.count("*").alias("n"), F.min("fp").alias("rep")).filter("n > 1")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("rep"))) <= MAX_BITS
    rows = cut(keys.join(busy, ["start", "key"]).select("start", "key", "fp", "rep", near.alias("star")), "buckets")
    stars = rows.filter("star and fp <> rep").select(F.col("fp").alias("a"), F.col("rep").alias("b"))
    x, y = rows.alias("x"), rows.alias("y")
    a, b = F.col("x.fp"), F.col("y.fp")
    pairs = (
        x.join(y, (F.col("x.start") == F.col("y.start")) & (F.col("x.key") == F.col("y.key")) & (a < b) & ~(F.col("x.star") & F.col("y.star"))
               & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS) & _chain_holds(a, b, F.col("x.start")))
        .select(a.alias("a"), b.alias("b"))
    )
    return stars.unionByName(pairs).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Texts link where their fingerprints differ in at most three bits; component_id is the smallest
    doc_id that links reach, the row's own included. Null, empty and blank texts have fingerprint 0
    and link like others. Repeated rows stay repeated. An empty table gives no rows. Only distinct
    fingerprints are compared, so copies are never expanded into pairs.
    """
    prints = cut(fingerprints(docs, shingle), "fingerprints")
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints")
    links = cut(fingerprint_links(first.select("fp")), "links")
    comps = connected_components(links)
    # Few fingerprints have links; those without are their own component.
    linked = comps.join(first, comps.node == first.fp).select("fp", "component", "first_doc")
    least = linked.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    mapped = linked.join(least, "component").select("fp", "component_id")
    # Written, so that the join below shuffles both sides itself and can split a fingerprint of many copies.
    per_fp = cut(first.join(mapped, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id")), "components")
    return prints.join(per_fp, "fp").select("doc_id", "fp", "component_id")
