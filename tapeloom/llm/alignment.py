"""Alignment of two tokenizers' tokens by the bytes they stand for, and counts of the id pairs they link.

Tokenizer A is a byte-level BPE of ``tokenizers``, B a piece model of ``sentencepiece``; both see a space and
the text. Their offsets, of characters and of spans of the proto, are the coarse cuts. Where a span is not as
wide as its token's bytes, in a character of several bytes, at bytes of a fallback or at trimmed or added
space, the decoded bytes cut on from the last coarse cut.

Texts are cut into chunks where no token of either may cross: before a space, and between plain letters and
other plain characters. Each distinct chunk is aligned once and remembered, and a text is the sequence of its
chunks. Texts are aligned in one pass, whose links are written. Pairs are counted from these by task and summed;
the table of pairs is no longer than both vocabularies allow. Last, links are looked up in it: from memory where
it is counted to be small, else by a join.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import BROADCAST_ROWS, cut, kept, text_batches

#: Chunks that a Python worker remembers, in each of two generations; pairs that a task holds before it sends them.
CACHE_CHUNKS, PAIRS_HELD = 250_000, 1_000_000
#: Letters, other printed characters, and those but for the apostrophe, which starts a token with letters.
_L, _N, _P = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f", "!-@\\[-`{-~", "!-&(-@\\[-`{-~"
#: Before a space after what is no white space by any table, but for a text's last character; between letters and others.
_CUT = f"(?<=[^\\s\\x00-\\x20\\x7f-\\xa0\\u180e\\u200b\\u2060\\ufeff])(?= (?!\\Z))|(?<=[{_L}])(?=[\\n{_N}])|(?<=[{_P}])(?=[{_L}])|(?<=[{_N}]\\n)(?=[{_L}])"
#: Chunks of the usual kinds first, then whatever stands before the next cut.
_CHUNKS = re.compile(f"(?s) ?[{_L}]+(?=[\\n{_N}]| (?!\\Z)|\\Z)| ?[{_P}]+(?=[{_L}]| (?!\\Z)|\\Z)|[{_P}]+\\n(?=[{_L}])|.+?(?:{_CUT}|\\Z)").findall
#: Pieces that would cross a cut.
_CROSSES = re.compile(f"[^▁]▁|[{_L}][\\n{_N}]|[\\n{_N}][{_L}]")
#: Chunks of a text: tokens of A and B, groups, links, the groups as text, the linked ids as keys.
Chunk = tuple[int, int, int, int, str, bytes]


def pair_shift(a_size: int, b_size: int) -> int:
    """Bits of B's id in a pair's number."""
    return 16 if max(a_size, b_size) <= 1 << 16 else 32


def byte_ends(spans: list[tuple[int, int]], tokens: list[bytes]) -> list[int]:
    """Where tokens end, in bytes: at the end of a span (begin, end) that goes on from the cut before and is as
    wide as its token's bytes, else where the decoded bytes end."""
    out, at = [], 0
    for (begin, end), token in zip(spans, tokens):
        at = end if begin == at and end - begin == len(token) else at + len(token)
        out.append(at)
    return out


def groups_and_links(a_ends: list[int], b_ends: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The places after which tokens of both end together, and all pairs of places of tokens that
    share bytes. Both lists rise and end alike."""
    cuts, links, i, j = [], [], 0, 0
    while i < len(a_ends) and j < len(b_ends):
        links.append((i, j))
        x, y = a_ends[i], b_ends[j]
        i, j = i + (x <= y), j + (y <= x)
        if x == y:
            cuts.append((i, j))
    return cuts, links


class Aligner:
    """Aligns chunks of texts; keeps those it has seen."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # Bytes stand for letters in A's entries: printable ones for themselves, others in order from 256.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [x for x in range(256) if x not in plain]
        letters = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: A pair as one number: A's id above B's.
        self.shift = pair_shift(len(self.a_bytes), len(pieces))
        self.key = np.dtype("<u4" if self.shift == 16 else "<u8")
        #: Whether chunks are encoded alike alone and in a text.
        self.cuts = not any(_CROSSES.search(p) for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        #: What stands before a chunk that has no space of its own, so that B puts none into it, and its pieces.
        self.before = {x: len(self.b.encode(x)) for x in ("", "a", ".")}
        self.a_text, self.b_text = {i: str(i) for i in self.a_bytes}, [str(i) for i in range(len(pieces))]
        self.young: dict[str, Chunk | None] = {}
        self.old: dict[str, Chunk | None] = {}

    def chunks(self, text: str) -> list[str]:
        """Of a space and ``text``."""
        return _CHUNKS(" " + text) if self.cuts else [" " + text]

    def align(self, chunks: list[str]) -> list[Chunk | None]:
        """None for a chunk whose tokens' bytes are others than its own."""
        new = []
        for c in chunks:
            if c not in self.young:
                if c in self.old:
                    self.young[c] = self.old[c]
                else:
                    new.append(c)
        if new:
            a = self.a.encode_batch(new, add_special_tokens=False)
            before = ["" if c[0] == " " else "." if c[0].isalpha() else "a" for c in new]
            b = self.b.encode([c[1:] if not x else x + c for c, x in zip(new, before)], return_type="proto", num_threads=1)
            self.young.update((c, self._one(c, x, y, z)) for c, x, y, z in zip(new, a, b, before))
        out = [self.young[c] for c in chunks]
        if len(self.young) >= CACHE_CHUNKS:  # what comes often stays
            self.young, self.old = {}, self.young
        return out

    def _one(self, chunk: str, a, b, before: str) -> Chunk | None:
        text, a_ids, spans = chunk.encode(), a.ids, a.offsets
        pieces = [(p.id, p.begin, p.end) for p in b.pieces][self.before[before] :]
        b_ids = [i for i, _, _ in pieces]
        a_tokens, b_tokens = [self.a_bytes[i] for i in a_ids], [self.b_bytes[i] for i in b_ids]
        if b"".join(a_tokens) != text or b"".join(b_tokens) != text:
            return None
        if len(text) > len(chunk):  # offsets are of characters
            at = [0, *accumulate([len(c.encode()) for c in chunk])]
            spans = [(at[x], at[y]) for x, y in spans]
        # B's spans are of what it was given: without the chunk's space, or with what was put before it.
        off = 1 if not before else -len(before)
        b_spans = [(x + off, y + off) for _, x, y in pieces]
        if not before and b_spans:
            b_spans[0] = (0, b_spans[0][1])
        cuts, links = groups_and_links(byte_ends(spans, a_tokens), byte_ends(b_spans, b_tokens))
        a_text, b_text, parts, i, j = self.a_text, self.b_text, [], 0, 0
        for x, y in cuts:
            parts.append(",".join([a_text[k] for k in a_ids[i:x]]) + "|" + ",".join([b_text[k] for k in b_ids[j:y]]))
            i, j = x, y
        shift = self.shift
        keys = array("I" if shift == 16 else "Q", [a_ids[i] << shift | b_ids[j] for i, j in links])
        return len(a_ids), len(b_ids), len(cuts), len(links), ";".join(parts), keys.tobytes()


def _aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's, which later tasks find with the chunks that it remembers."""
    return kept(f"aligner:{a_path}:{b_path}", lambda: Aligner(a_path, b_path))


def _aligned(rows: DataFrame, a_path: str, b_path: str, with_groups: bool) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, links): links are the linked pairs as numbers, one
    after another, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for b in batches:
            if b.num_rows:
                yield _batch(aligner, b.column(0), b.column(1).to_pylist(), with_groups)

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary")


def _batch(aligner: Aligner, ids: pa.Array, texts: list[str | None], with_groups: bool) -> pa.RecordBatch:
    """Each distinct chunk is looked up once; a text with a chunk that has no tokens has none."""
    parts = [aligner.chunks(t) if t else [] for t in texts]
    coded = pa.array([c for p in parts for c in p], pa.large_string()).dictionary_encode()
    found = aligner.align(coded.dictionary.to_pylist())
    codes = coded.indices.to_numpy()
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(np.array([x is None for x in found], bool)[codes])])[ends]
    sound = (np.diff(ends) > 0) & (bad[1:] == bad[:-1])
    found = [(0, 0, 0, 0, "", b"") if x is None else x for x in found]
    columns = [ids]
    for k in range(4):
        total = np.concatenate([[0], np.cumsum(np.array([x[k] for x in found], np.int64)[codes])])[ends]
        columns.append(pa.array(np.where(sound, np.diff(total), 0)))
    text, keys, at, lo = [x[4] for x in found], [x[5] for x in found], codes.tolist(), ends.tolist()
    groups = [";".join([text[c] for c in at[i:j]]) if ok else "" for ok, i, j in zip(sound.tolist(), lo, lo[1:])]
    links = [b"".join([keys[c] for c in at[i:j]]) if ok else b"" for ok, i, j in zip(sound.tolist(), lo, lo[1:])]
    columns += [pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()), pa.array(groups if with_groups else [None] * len(groups), pa.string()), pa.array(links, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "links"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _numbers(column: pa.Array, key: str) -> np.ndarray:
    """All links of a batch."""
    return np.frombuffer(b"".join(column.to_pylist()), key)


def pair_counts(aligned: DataFrame, shift: int) -> DataFrame:
    """(a, b, n, best): how many links of ``aligned`` (links) hold the ids linked, and whether no other pair of b
    has more. A task sends each pair that it has once, or once for PAIRS_HELD pairs."""
    key = "<u4" if shift == 16 else "<u8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, key), np.empty(0, np.int64)
        for b in batches:
            own, n = np.unique(_numbers(b.column(0), key), return_counts=True)
            keys, counts = _summed(np.concatenate([keys, own]), np.concatenate([counts, n]))
            if len(keys) >= PAIRS_HELD:
                yield out(keys, counts)
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield out(keys, counts)

    def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        a, b = keys >> shift, keys & ((1 << shift) - 1)
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts)], ["a", "b", "n"])

    parts = aligned.select("links").mapInArrow(run, "a int, b int, n long")
    counts = cut(parts.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return cut(counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"


def _looked_up(aligned: DataFrame, pairs: DataFrame, shift: int) -> DataFrame:
    """With the table of ``pairs``, of checked size, in every worker's memory."""
    key = "<u4" if shift == 16 else "<u8"
    table = pairs.select(F.col("a").cast("long") * (1 << shift) + F.col("b"), "n", "best").toArrow()
    keys, counts, best = (c.to_numpy() for c in table.columns)
    order = np.argsort(keys)
    shared = aligned.sparkSession.sparkContext.broadcast((keys[order].astype(key), counts[order].astype(np.int64), best[order].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            sums = [np.zeros(b.num_rows, np.int64)] * 2
            if len(keys):
                at = np.searchsorted(keys, _numbers(b.column(len(COLUMNS)), key))
                ends = np.cumsum(b.column(4).to_numpy())
                totals = [np.concatenate([[0], np.cumsum(v[at])]) for v in (best, counts)]
                sums = [t[ends] - t[np.concatenate([[0], ends[:-1]])] for t in totals]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(COLUMNS)], *map(pa.array, sums)], [*COLUMNS, "n_best", "count_sum"])

    return aligned.select(*COLUMNS, "links").mapInArrow(run, f"{_ROWS}, n_best long, count_sum long")


def _joined(aligned: DataFrame, pairs: DataFrame, shift: int) -> DataFrame:
    """With a join of each document's distinct pairs and the table of ``pairs``."""
    key = "<u4" if shift == 16 else "<u8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 40
        for b in batches:
            if not b.num_rows:
                continue
            own = []
            for x in b.column(len(COLUMNS)).to_pylist():
                keys, n = np.unique(np.frombuffer(x, key), return_counts=True)
                own.append([{"a": int(i) >> shift, "b": int(i) & ((1 << shift) - 1), "m": int(m)} for i, m in zip(keys, n)])
            ids, k = pa.array(range(k, k + b.num_rows), pa.int64()), k + b.num_rows
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("m", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(COLUMNS)], ids, pa.array(own, kind)], [*COLUMNS, "k", "own"])

    found = cut(aligned.select(*COLUMNS, "links").mapInArrow(run, f"{_ROWS}, k long, own array<struct<a: int, b: int, m: long>>"), "own-pairs")
    links = found.select("k", F.explode("own").alias("o")).select("k", "o.a", "o.b", "o.m").join(pairs, ["a", "b"])
    sums = links.groupBy("k").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    joined = found.drop("own").join(sums, "k", "left")
    return joined.select(*COLUMNS, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")))


def align(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False, most_pairs: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``docs``
    (doc_id, text), and the groups as text (`a1,a2|b1;a3|b2,b3`, decimal ids) if asked for.

    Null and empty texts, and those whose tokens' bytes are others than a space and the text, have no
    tokens: zeros, and '' for groups and digest. Texts of any length are aligned whole. Repeated rows count as
    often as they come; a null doc_id is one like others. An empty table gives no rows. Other
    columns are ignored. A table of more than ``most_pairs`` id pairs is joined, not broadcast.
    """
    rows = text_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    aligned, shift = cut(_aligned(rows, a_path, b_path, with_groups), "aligned", compression="zstd"), Aligner(a_path, b_path).shift
    pairs = pair_counts(aligned, shift)
    found = (_looked_up if pairs.count() <= most_pairs else _joined)(aligned, pairs, shift)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))
