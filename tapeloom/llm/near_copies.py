"""SimHash near-duplicates at a similarity of word shingles, each link verified exactly.

A text is the set of its distinct five-word shingles, and has their 64-bit SimHash. Two sets of
similarity 0.8 differ in 9.7 of 64 bits on average (the angle's cosine is 2J / (1 + J)), with a deviation
of 2.9, so links are sought at up to MAX_BITS = 20 bits, 3.6 deviations above. No segment that survives
so many is long enough to be a join's key; the key is a band of MinHash values: sets of similarity 0.8
share one of ``BANDS`` bands of ``ROWS`` values with probability 1 - (1 - 0.8^6)^24 = 0.9993, and more
similar ones more often. The pigeonring over eight segments and the Hamming distance prune these
candidates, unrelated texts differing in 32 bits, before shingles are fetched and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import as_signed, cut, small_side, text_batches
from tapeloom.llm.components import connected_components
from tapeloom.llm.simhash import ring_holds, shingle_hashes, simhash

SHINGLE, ROWS, BANDS = 5, 6, 24
#: The least similarity, as a fraction.
NEAR, OF = 4, 5
#: The pigeonring's bound and segments.
MAX_BITS, SEGMENTS = 20, 8
#: Buckets of up to so many texts compare all that are not connected yet at once; larger ones first compare all
#: with the most central texts of so many slots of components, and then what that has not connected.
SMALL_BUCKET, SLOTS = 64, 4
# Each product has two values of 32 bits.
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, ROWS * BANDS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: bytes | None) -> list[bytes]:
    """What stands between ASCII white space, A-Z in lower case."""
    return (text or b"").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; fewer than ``SHINGLE`` words are one shingle, no
    words none."""
    return shingle_hashes(words, SHINGLE) if words else np.empty(0, "<u8")


def bands(found: np.ndarray) -> list[int]:
    """A hash for each band of the MinHash values of ``found``; none for an empty set."""
    if not len(found):
        return []
    least = np.full(ROWS * BANDS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(found), 1024):
        part = (found[k : k + 1024, None] * _FACTORS).view(np.uint32)
        np.minimum(least, part.min(axis=0), out=least)
    return [as_signed(xxhash.xxh64_intdigest(v.tobytes(), b)) for b, v in enumerate(least.reshape(BANDS, ROWS))]


def text_hash():
    """Tells rows of one doc_id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sketches(rows: DataFrame) -> DataFrame:
    """(doc_id, h, node, n, fp, bands) of ``rows`` (doc_id, h, text): node is the hash of all words, n the
    number of distinct shingles, fp their SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(2).to_pylist():
                words = words_of(t)
                own = np.unique(shingles(words))
                found.append((as_signed(xxhash.xxh64_intdigest(b" ".join(words), 7)), len(own), as_signed(simhash(own)), bands(own)))
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), *columns], ["doc_id", "h", "node", "n", "fp", "bands"])

    return text_batches(rows).mapInArrow(run, "doc_id long, h long, node long, n long, fp long, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """(node, set) of ``rows`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(words_of(t))).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return text_batches(rows).mapInArrow(run, "node long, set array<long>")


def _may_be_near(x: str, y: str):
    """By size, then by the pigeonring: what two near texts (n, fp) cannot miss but by chance."""
    least, most = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (OF * least >= NEAR * most) & ring_holds(F.col(f"{x}.fp"), F.col(f"{y}.fp"), MAX_BITS, SEGMENTS)


def _sets_of(nodes: DataFrame, rows: DataFrame, first: DataFrame) -> DataFrame:
    """(node, set) of the distinct ``nodes`` (node). ``first`` is written; the texts come from ``rows``
    (doc_id, h, text), one for each node."""
    wanted = cut(nodes.join(first, "node").select("node", F.col("least.doc_id").alias("d"), F.col("least.h").alias("g")), "wanted")
    texts = rows.join(small_side(wanted), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("node", "text")
    return cut(_sets(texts.dropDuplicates(["node"])), "shingles")


def _are_near(x: str, y: str):
    """By the shingles themselves."""
    shared = F.size(F.array_intersect(x, y))
    return OF * shared >= NEAR * (F.size(x) + F.size(y) - shared)


def _verified(pairs: DataFrame, rows: DataFrame, first: DataFrame) -> DataFrame:
    """The written ``pairs`` (a, b) of texts that are near."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(nodes, rows, first)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.filter(_are_near("x", "y")).select("a", "b")


def _left_over(many: DataFrame, at: DataFrame, rows: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs (a, b) of near texts that share one of the large buckets ``many`` (band, key, t) and are not
    connected ``at`` (node, component); each pair in the first band that both share. Few texts are left, so they
    bring their shingles, and the join gives links alone."""
    placed = many.select("band", "key", "t", F.col("t.node").alias("node")).join(at, "node", "left").select("band", "key", "t", "node", F.coalesce("component", "node").alias("c"))
    sizes = cut(placed.groupBy("band", "key", "c").agg(F.count("*").alias("m")), "component-sizes")
    largest = sizes.groupBy("band", "key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    open_ = cut(placed.join(largest, ["band", "key"]).select("band", "key", "t", "node", "c", (F.col("c") != F.col("main")).alias("outside")), "open-texts")
    sets = _sets_of(open_.select("node").distinct(), rows, first).join(first.select("node", "bands"), "node")
    open_ = cut(open_.join(sets, "node").select("band", "key", F.struct("t.*", "bands", "set").alias("t"), "c", "outside"), "still-open")
    x = open_.filter("outside").select("band", "key", F.col("t").alias("x"), F.col("c").alias("cx"))
    y = open_.select("band", "key", F.col("t").alias("y"), F.col("c").alias("cy"), "outside")
    earlier = F.expr("exists(sequence(0, band - 1), i -> x.bands[i] = y.bands[i])")
    once = (~F.col("outside") | (F.col("x.node") < F.col("y.node"))) & ((F.col("band") == 0) | ~earlier)
    met = x.join(y, ["band", "key"]).filter((F.col("cx") != F.col("cy")) & _may_be_near("x", "y") & once & _are_near("x.set", "y.set"))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kept_doc_id, kept_h) for each row of ``docs`` (doc_id, text): h is the text's hash,
    kept_* name the row of the smallest (doc_id, h) that links reach, rows without doc_id last.

    Texts link where their shingles have a similarity of 0.8 or more; texts of the same words always
    do, those without words among them. Repeated rows stay repeated. Links are sought from each text to
    the most central one of its bucket, then between what is not connected yet: among all of a small bucket,
    and in one of more than SMALL_BUCKET texts first with its SLOTS most central ones. Last, what is still
    outside a large bucket's largest component meets all others of the bucket. Of two texts that no path
    connects one is outside, so no pair of a bucket is left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), F.encode("text", "UTF-8").alias("text"))
    all_rows = cut(_sketches(rows), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    first = cut(all_rows.groupBy("node").agg(F.min(order).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct-texts")
    keys = cut(first.select(F.struct("node", "n", "fp").alias("t"), F.posexplode("bands").alias("band", "key")), "band-keys")
    sizes = cut(keys.groupBy("band", "key").agg(F.count("*").alias("m")).filter("m > 1"), "band-sizes")
    # A text with many bucket mates is central: of near copies of one text, that text.
    met = keys.join(sizes, ["band", "key"])
    keys = cut(met.join(met.groupBy("t.node").agg(F.sum("m").alias("degree")), F.col("t.node") == F.col("node")).select("band", "key", "m", "t", "degree"), "met-keys")
    busy = keys.groupBy("band", "key").agg(F.max_by("t", F.struct("degree", "t.node")).alias("rep"))
    buckets = cut(keys.join(busy, ["band", "key"]), "buckets")
    # First all to the most central of their bucket; then only texts meet that are not connected yet.
    to_rep = cut(buckets.filter(F.col("t.node") != F.col("rep.node")).filter(_may_be_near("t", "rep")).select(F.col("t.node").alias("a"), F.col("rep.node").alias("b")).distinct(), "star-candidates")
    stars = cut(_verified(to_rep, rows, first), "stars")
    at = connected_components(stars).select("node", F.col("component").alias("c"))
    placed = cut(buckets.withColumn("node", F.col("t.node")).join(at, "node", "left").select("band", "key", "m", "degree", "t", F.coalesce("c", "node").alias("c")), "placed")
    open_ = placed.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("band", "key")
    left = cut(placed.join(open_, ["band", "key"]), "open-buckets")
    few, many = left.filter(f"m <= {SMALL_BUCKET}"), left.filter(f"m > {SMALL_BUCKET}")
    x = left.select("band", "key", F.col("t").alias("x"), F.col("c").alias("cx"))
    central = many.groupBy("band", "key", F.pmod(F.xxhash64("c"), F.lit(SLOTS)).alias("slot")).agg(F.max_by(F.struct("t", "c"), F.struct("degree", "t.node")).alias("r"))
    y = few.select("band", "key", F.col("t").alias("y"), F.col("c").alias("cy"), F.lit(True).alias("few")).unionByName(central.select("band", "key", "r.t", "r.c", F.lit(False).alias("few")).toDF("band", "key", "y", "cy", "few"))
    met = x.join(y, ["band", "key"]).filter(((F.col("x.node") < F.col("y.node")) | ~F.col("few")) & (F.col("cx") != F.col("cy")) & _may_be_near("x", "y"))
    links = _verified(cut(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pair-candidates"), rows, first)
    so_far = cut(stars.unionByName(links), "links-so-far")
    comps = connected_components(so_far)
    if not many.isEmpty():  # else nothing is left over, and no jobs run for it
        rest = cut(_left_over(many, comps, rows, first), "rest-links")
        comps = connected_components(cut(so_far.unionByName(rest), "near-links"))
    linked = comps.join(first, "node").select("node", "component", "least")
    least = linked.groupBy("component").agg(F.min("least").alias("kept"))
    mapped = linked.join(least, "component").select("node", "kept")
    per_text = cut(first.select("node", "least").join(mapped, "node", "left").select("node", F.coalesce("kept", "least").alias("kept")), "kept")
    return all_rows.select("doc_id", "h", "node").join(per_text, "node").select("doc_id", "h", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.h").alias("kept_h"))
