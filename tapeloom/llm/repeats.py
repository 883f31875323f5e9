"""Repeated byte strings of a corpus, by prefix-free parsing.

A rolling hash marks triggers: in each string of LENGTH bytes the trigger is the gram of GRAM bytes with
the least hash, the first of equals. So a string has its trigger at the same place wherever it stands,
and texts are parsed into phrases that are cut alike in every copy: the strings of one trigger form a
phrase, and phrases overlap by what a string needs. Equal phrases are one entry of the dictionary and
have all their strings in common, so copies cost one entry however often they come. In periodic text
equal phrases follow each other; such a run is one row, and all its strings repeat, so that text does
not cost a row for each period.

Three levels find the strings that come twice. Phrases with equal triggers meet; where all of them are
equal, all their strings repeat, and a phrase that meets none has none. Of the dictionary's entries that
meet, blocks of BLOCK strings meet by the bytes that all strings of the block hold; again equal blocks
repeat and lone ones do not. Only the strings of the blocks that are left are compared one by one. Every
level is a grouped count and an equi-join over hashes; no text is compared with another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import as_signed, cut, small_side, text_batches

LENGTH, GRAM, BLOCK = 200, 48, 16
#: Texts are parsed in buffers of about so many bytes, one text at least.
BUFFER = 2 << 20

_P1, _P2, _P3, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def rolling(data: np.ndarray) -> np.ndarray:
    """A polynomial hash of the GRAM = 48 bytes from each place on, by doubling: 8, 16, 32, 48 bytes."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | x[k:] << np.uint64(8 * k)
    x16 = x[:-8] * _P1 + x[8:]
    x32 = x16[:-16] * _P2 + x16[16:]
    x = x32[: len(data) - GRAM + 1] * _P3 + x16[32:]
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def triggers(grams: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place where a string of ``length`` bytes starts, the place of its trigger."""
    need = length - GRAM + 1
    x = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= need:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if need > width:
        x = np.minimum(x[: len(x) - (need - width)], x[need - width :])
    return (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...] | None:
    """(text's number, trigger, first start, last start, gram hash, phrase hash, phrases, run's last start)
    of the phrases of texts, as arrays; places count from their text's begin. Equal phrases of one text that
    follow each other are one row, the first one's, with their number and the last one's end."""
    data, n = b"".join(texts), len(texts)
    if len(data) < length:
        return None
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    grams = rolling(np.frombuffer(data, np.uint8))
    at = triggers(grams, length)
    start = np.arange(len(at))
    text = np.minimum(np.searchsorted(ends, start, side="right"), n - 1)
    start = start[start + length <= ends[text]]
    if not len(start):
        return None
    at, text = at[start], text[start]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(text) != 0)]))
    last = np.append(new[1:], len(start)) - 1
    lo, hi, digest = start[new], start[last], xxhash.xxh3_64_intdigest
    whole = np.array([digest(data[s : e + length]) for s, e in zip(lo.tolist(), hi.tolist())], np.uint64).view(np.int64)
    base, core = (ends - sizes)[text[new]], grams[at[new]].view(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(whole) != 0) | (np.diff(core) != 0) | (np.diff(text[new]) != 0)]))
    n = np.diff(np.append(first, len(whole)))
    end = (hi - base)[first + n - 1]
    return text[new][first], (at[new] - base)[first], (lo - base)[first], (hi - base)[first], core[first], whole[first], n, end


def _buffers(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[bytes]]]:
    texts, first, size = [], 0, 0
    for k, t in enumerate(b.column(at).to_pylist()):
        if texts and size + len(t) > BUFFER:
            yield first, texts
            texts, first, size = [], k, 0
        texts.append(t)
        size += len(t)
    if texts:
        yield first, texts


def _parse(texts: DataFrame, length: int) -> DataFrame:
    schema = "doc_id long, h long, at int, lo int, hi int, core long, phrase long, n long, end int"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs = b.column(0).to_numpy(), b.column(1).to_numpy()
            for first, part in _buffers(b, 2):
                if (found := phrases(part, length)) is not None:
                    t, at, lo, hi, core, whole, n, end = found
                    places = [pa.array(x, pa.int32()) for x in (at, lo, hi)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first + t], pa.int64()), pa.array(hs[first + t], pa.int64()), *places, pa.array(core), pa.array(whole), pa.array(n, pa.int64()), pa.array(end, pa.int32())], names)

    return texts.mapInArrow(run, schema)


def _blocks(texts: DataFrame, length: int) -> DataFrame:
    """The blocks of the phrases in the column ``asked`` [(at, lo, hi, core, once)]: their strings start
    BLOCK k to BLOCK k + BLOCK - 1 bytes before the trigger. inner is a hash of what these have in common,
    whether they are all there or not; whole, of all that those that are there cover."""
    schema = "doc_id long, h long, lo int, hi int, once boolean, core long, k int, inner long, whole long"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            rows = []
            for doc_id, h, text, asked in zip(*(c.to_pylist() for c in b.columns)):
                for x in asked:
                    at, lo, hi = x["at"], x["lo"], x["hi"]
                    for k in range((at - hi) // BLOCK, (at - lo) // BLOCK + 1):
                        far, near = at - BLOCK * k - BLOCK + 1, at - BLOCK * k
                        s, e = max(lo, far), min(hi, near)
                        rows.append((doc_id, h, s, e, x["once"], x["core"], k, as_signed(digest(text[near : far + length])), as_signed(digest(text[s : e + length]))))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return texts.mapInArrow(run, schema)


def _strings(texts: DataFrame, length: int) -> DataFrame:
    """Each string of the blocks in the column ``asked`` [(lo, hi, once)], with its 128-bit hash."""
    schema = "doc_id long, h long, lo int, once boolean, a long, b long"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for doc_id, h, text, asked in zip(*(c.to_pylist() for c in b.columns)):
                starts = [(s, x["once"]) for x in asked for s in range(x["lo"], x["hi"] + 1)]
                for k in range(0, len(starts), 1 << 16):
                    part = starts[k : k + (1 << 16)]
                    found = np.frombuffer(b"".join(digest(text[s : s + length]) for s, _ in part), "<i8")
                    columns = [[doc_id] * len(part), [h] * len(part), [s for s, _ in part], [o for _, o in part], found[::2], found[1::2]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return texts.mapInArrow(run, schema)


def _meeting(rows: DataFrame, keys: list[str], whole: str, n=None) -> DataFrame:
    """Rows that share ``keys`` with another, and whether all that do are ``same`` in ``whole``. A row
    stands for ``n`` equal ones.

    The groups are counted with a partial sum first and written, so that the join shuffles both sides
    itself and Spark can split a key that holds a large share of the rows.
    """
    groups = rows.groupBy(*keys).agg((F.count("*") if n is None else F.sum(n)).alias("m"), F.min(whole).alias("p"), F.max(whole).alias("q")).filter("m > 1")
    return rows.join(cut(groups.select(*keys, (F.col("p") == F.col("q")).alias("same")), "groups"), keys)


def _with_text(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, h, bytes, asked) of the texts that ``asked`` (doc_id, h, asked) names, one each."""
    needed = texts.join(small_side(asked.select("doc_id", "h")), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    return needed.join(asked, ["doc_id", "h"]).select("doc_id", "h", "bytes", "asked")


def repeated_strings(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, h, lo, hi): runs of starts of strings of ``length`` bytes that also start anywhere
    else in ``texts`` (doc_id, h, bytes). Runs cover just these starts; they may lie side by side."""
    run = ["doc_id", "h", "lo", "hi"]
    met = cut(_meeting(cut(_parse(texts, length), "phrases"), ["core"], "phrase", "n"), "meeting-phrases")
    mixed = met.filter("not same")
    entries = cut(mixed.groupBy("core", "phrase").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "h", "at", "lo", "hi")).alias("m")), "dictionary")
    copied = mixed.join(entries.filter("n > 1").select("core", "phrase"), ["core", "phrase"], "left_semi")  # both are written
    whole = [*run[:3], F.col("end").alias("hi")]
    found = cut(met.filter("same").select(*whole).unionByName(copied.select(*whole)), "copied-phrases")
    asked = entries.groupBy("m.doc_id", "m.h").agg(F.collect_list(F.struct("m.at", "m.lo", "m.hi", "core", (F.col("n") == 1).alias("once"))).alias("asked"))
    blocks = cut(_blocks(_with_text(texts, cut(asked, "asked-phrases")), length), "blocks")
    met = cut(_meeting(blocks, ["core", "k", "inner"], "whole"), "meeting-blocks")
    asked = met.filter("not same").groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi", "once")).alias("asked"))
    strings = cut(_strings(_with_text(texts, cut(asked, "asked-blocks")), length), "strings")
    twice = cut(strings.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b"), "repeated-strings")
    single = strings.filter("once").join(twice, ["a", "b"], "left_semi").select("doc_id", "h", "lo", F.col("lo").alias("hi"))
    return found.unionByName(met.filter("same and once").select(*run)).unionByName(single)


CUTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _merged(runs: list[dict], length: int) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row of ``docs`` (doc_id, text).

    Of a text's UTF-8 bytes those go that a string of ``length`` bytes covers which also starts
    anywhere else, in another row or in the same; strings are judged on the whole input. spans are the
    maximal removed runs [start, end). A null text counts as empty. Repeated rows are copies of each
    other. A row without doc_id is kept whole and counts for nobody. Texts shorter than ``length``
    stay. Other columns are ignored.
    """
    texts = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("h"), F.encode("text", "UTF-8").alias("bytes"))
    long = texts.filter((F.octet_length("bytes") >= length) & F.col("doc_id").isNotNull())
    found = repeated_strings(long, length).groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    found = cut(found, "repeated")
    hit = small_side(found.select("doc_id", "h"))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, runs in zip(*(c.to_pylist() for c in b.columns)):
                spans, kept, last = _merged(runs, length), hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(text[last:s])
                    last = e
                kept.update(text[last:])
                rows.append((doc_id, len(text), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    changed = texts.join(hit, ["doc_id", "h"], "left_semi").join(found, ["doc_id", "h"]).select("doc_id", "bytes", "runs").mapInArrow(run, CUTS)
    zero = F.lit(0).cast("long")
    whole = texts.join(hit, ["doc_id", "h"], "left_anti").select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("bytes", 256).alias("kept_sha256"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return changed.unionByName(whole)
