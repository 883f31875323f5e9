"""Packing of documents into token sequences, with neighbours from a sharded BM25 index.

Terms are token ids, so document frequencies are counted over the whole corpus in a table no longer than
the vocabulary. Documents are sharded by content: a document goes to the pivot (of PIVOTS sampled
documents, in an order that puts like beside like) that it scores highest, and within it by terms drawn
from it by weight (weighted MinHash of idf), so that documents of common rare terms lie together
however large a pivot's share is. Range partitions of this order are the shards; a document alone
breaks ties, so a hot group splits. Within a shard the next unpacked document seeds a window and its
unused neighbours, best first and by all its terms, fill it; the last one is cut to close the gap. What
a shard leaves over goes on to the next one of its partition, so a partition pads at its end only, and
there it cuts to powers of two.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, forget, kept, text_batches

WINDOW, END_ID = 4096, 2
#: A shard's index holds so many ids or documents, what was left over aside.
SHARD_TOKENS, SHARD_DOCS = 1 << 20, 1024
K1, B = 1.2, 0.75
#: Routing is fitted on a bounded sample: so many documents of so many characters at most; PIVOTS of them stay.
PIVOTS, PIVOT_SAMPLE, PIVOT_CHARS = 64, 512, 20_000
PARTITION_BYTES = 64 << 20
#: Terms drawn from a document to order it within its pivot.
DRAWS = 3
#: Words that a Python worker remembers, in each of two generations, and pieces.
CACHE_WORDS, CACHE_PIECES = 120_000, 200_000

#: The vocabulary's own split of texts, lower-cased, that have no character above U+00FF.
_PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+").findall


class Encoder:
    """Token ids of texts as little-endian bytes, word by word with a bounded memory of words.

    White space parts tokens of this vocabulary and is dropped, so a text's ids are those of its pieces
    between spaces. A piece of Latin-1 characters is split as the vocabulary splits it; another is
    encoded by the tokenizer. A text that may hold a special token's string is encoded in one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Bytes stand for letters in the vocabulary: printable ones for themselves, others in order from 256.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in plain]
        self.as_letters = {b: chr(256 + k) for k, b in enumerate(rest)}
        self.terms = self.tokenizer.get_vocab_size()
        #: How an id is stored.
        self.width = "<u2" if self.terms <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """The ids of one word, or run of marks, as the vocabulary's model splits it."""
        if not (part.isascii() and part.isprintable()):
            part = part.encode().decode("latin-1").translate(self.as_letters)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _remembered(self, part: str) -> bytes:
        """The ids of a part. Of two generations of parts the older is forgotten when the younger is full,
        so what comes often stays."""
        found = self.parts.get(part)
        if found is None:
            found = self.old_parts.get(part)
            if len(self.parts) >= CACHE_WORDS:
                self.parts, self.old_parts = {}, self.parts
            self.parts[part] = found = self._part(part) if found is None else found
        return found

    def _piece(self, piece: str) -> bytes:
        """The ids of a lower-cased piece of Latin-1 characters without space."""
        if piece.isascii() and piece.isalpha():
            return self._remembered(piece)
        return b"".join([self._remembered(p) for p in _PARTS(piece)])

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Places in the memory of distinct lower-cased pieces of Latin-1 characters; new ones are added."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(at.is_null())
        if not len(new):
            return at.to_numpy()
        found = [self._piece(p) for p in new.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        at[at < 0] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
        return at

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.start, self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def _plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        if self._plain(text):
            return b"".join([self._piece(p) for p in text.lower().replace("\n", " ").split(" ")])
        if any(s in text for s in self.special):
            return self._ids(text)
        return b"".join([self._other(p) for p in text.replace("\n", " ").split(" ")])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """``encode`` of many texts; each distinct piece is looked up once."""
        plain = [k for k, t in enumerate(texts) if self._plain(t)]
        out = [None] * len(texts)
        if plain:
            pieces = pc.split_pattern(pc.replace_substring(pa.array([texts[k].lower() for k in plain], pa.large_string()), "\n", " "), " ")
            coded = pieces.flatten().dictionary_encode()
            if len(self.known) >= CACHE_PIECES:
                self._forget()
            at = self._learn(coded.dictionary)[coded.indices.to_numpy()]
            n = self.size[at]
            ends = np.concatenate([[0], np.cumsum(n)])
            every = self.ids[np.repeat(self.start[at] - ends[:-1], n) + np.arange(ends[-1])]
            ends = ends[pieces.offsets.to_numpy()]
            for k, s, e in zip(plain, ends, ends[1:]):
                out[k] = every[s:e]
        return [np.frombuffer(self.encode(t), "<u4") if x is None else x for t, x in zip(texts, out)]

    def _other(self, piece: str) -> bytes:
        """The ids of a piece between spaces, as it stands, of a text with other characters."""
        try:
            piece.encode("latin-1")
        except UnicodeEncodeError:
            return self._ids(piece)
        return self._piece(piece.lower())


def kept_encoder(path: str) -> Encoder:
    """The worker's encoder, which later tasks find with the words that it remembers."""
    return kept(encoder_name(path), lambda: Encoder(path))


def encoder_name(path: str) -> str:
    return f"encoder:{path}"


@dataclass
class Unit:
    """What is left of a document: its ids from ``start`` on."""

    doc_id: int
    ids: np.ndarray
    start: int
    total: int


@dataclass
class Statistics:
    """Of the whole corpus: each id's weight by document frequency, the mean length and the sum."""

    idf: np.ndarray
    mean: float
    size: int

    def weights(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))).astype(np.float32)


class _Shard:
    """BM25 over the ids of a shard's units, with the corpus's statistics."""

    def __init__(self, units: list[Unit], stats: Statistics):
        self.units, n, terms = units, len(units), len(stats.idf)
        sizes = np.array([len(u.ids) for u in units])
        ids = np.concatenate([u.ids for u in units])
        order = np.argsort(ids, kind="stable")  # so places of one id are in order of units
        term, doc = ids[order], np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]))
        tf = np.diff(np.append(new, len(term)))
        term, self.doc = term[new], doc[new]
        self.first = np.searchsorted(term, np.arange(terms + 1))
        self.weight = stats.weights(term, tf, sizes[self.doc])
        self.free = np.ones(n, bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """All unused units that share a term with the seed, best first."""
        terms = _distinct(self.units[seed].ids)
        start, size = self.first[terms], self.first[terms + 1] - self.first[terms]
        start, size = start[size > 1], size[size > 1]
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        scores = np.bincount(self.doc[at], self.weight[at], len(self.units))
        scores[~self.free] = 0
        best = np.argsort(-scores, kind="stable")
        return best[: np.count_nonzero(scores)]


Row = tuple[int, int, np.ndarray, int, int, int]  # doc_id, start, ids, doc_tokens, sequence, offset


class _Packer:
    def __init__(self, first_sequence: int, stats: Statistics):
        self.sequence, self.stats, self.left = first_sequence, stats, []

    def _window(self, units: list[tuple[Unit, int]]) -> Iterator[Row]:
        """A sequence of the first so many ids of each unit; the units keep the rest."""
        offset = 0
        for u, n in units:
            yield u.doc_id, u.start, u.ids[:n], u.total, self.sequence, offset
            u.ids, u.start, offset = u.ids[n:], u.start + n, offset + n
        self.sequence += 1

    def shard(self, units: list[Unit]) -> Iterator[Row]:
        """Packs full windows; the rest waits in ``left``."""
        units = self.left + units
        for u in units:
            while len(u.ids) >= WINDOW:
                yield from self._window([(u, WINDOW)])
        units = [u for u in units if len(u.ids)]
        total = sum(len(u.ids) for u in units)
        if total < WINDOW:
            self.left = units
            return
        index, order = _Shard(units, self.stats), 0
        while total >= WINDOW:
            while not index.free[order]:
                order += 1
            seed, room = order, WINDOW - len(units[order].ids)
            index.free[seed] = False
            window = [(units[seed], len(units[seed].ids))]
            for k in self._filling(index, seed, order):
                if not room:
                    break
                n = min(room, len(units[k].ids))
                window.append((units[k], n))
                room -= n
                index.free[k] = len(units[k].ids) > n
            yield from self._window(window)
            total -= WINDOW
        self.left = [u for k, u in enumerate(units) if index.free[k] and len(u.ids)]

    def _filling(self, index: _Shard, seed: int, order: int) -> Iterator[int]:
        """The seed's neighbours, then units that share no term with it, in order."""
        ranked = index.neighbours(seed)
        yield from ranked.tolist()
        yield from (k for k in range(order, len(index.units)) if index.free[k])

    def end(self) -> Iterator[Row]:
        """The partition's rest, in sequences of powers of two."""
        while total := sum(len(u.ids) for u in self.left):
            room, window = 1 << (total.bit_length() - 1), []
            for u in self.left:
                n = min(room, len(u.ids))
                window.append((u, n))
                room -= n
                if not room:
                    break
            yield from self._window(window)
            self.left = [u for u in self.left if len(u.ids)]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _distinct(ids: np.ndarray) -> np.ndarray:
    s = np.sort(ids, kind="stable")  # by radix for two bytes
    new = np.empty(len(s), bool)
    new[:1] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new].astype(np.int64)


def count_statistics(df: np.ndarray, n: int, size: int) -> Statistics:
    return Statistics(np.log1p((n - df + 0.5) / (df + 0.5)), max(size, 1) / max(n, 1), size)


class Router:
    """Where a document belongs: its pivot, and terms drawn from it. ``sample`` are the ids of documents."""

    def __init__(self, sample: list[np.ndarray], terms: int):
        df = np.bincount(np.concatenate([np.empty(0, np.int64), *(_distinct(x) for x in sample)]), minlength=terms)
        stats = count_statistics(df, len(sample), sum(map(len, sample)))
        # A term is drawn with a chance in proportion to its weight, and alike in every document.
        clock = np.random.default_rng(42).exponential(size=(terms, DRAWS)) / np.maximum(stats.idf, 1e-9)[:, None]
        self.clock = clock.astype(np.float32)
        distinct = list({x.tobytes(): x for x in sample}.values())[:PIVOTS]
        weights = np.zeros((terms, max(len(distinct), 1)), np.float32)
        for k, ids in enumerate(distinct):
            term, tf = np.unique(ids, return_counts=True)
            weights[term, k] = stats.weights(term, tf, np.full(len(term), len(ids)))
        weights[END_ID] = 0
        self.weights = np.ascontiguousarray(weights[:, self._chain(weights)])

    @staticmethod
    def _chain(weights: np.ndarray) -> list[int]:
        """From pivot to the most similar one not yet taken."""
        norm = weights / np.maximum(np.linalg.norm(weights, axis=0), 1e-9)
        near = norm.T @ norm
        out, left = [0], set(range(1, near.shape[0]))
        while left:
            best = max(left, key=lambda k: (near[out[-1], k], -k))
            out.append(best)
            left.remove(best)
        return out


def route(own: np.ndarray, weights: np.ndarray, clock: np.ndarray) -> list[int]:
    """Where a document of the distinct ids ``own`` goes, by a router's arrays."""
    near = np.ones(len(own), np.float32) @ weights.take(own, axis=0)
    return [int(near.argmax()), *own[clock.take(own, axis=0).argmin(axis=0)].tolist()]


def fit_router(docs: DataFrame, encoder: Encoder) -> Router:
    """From the texts of the PIVOT_SAMPLE smallest hashes of doc_id, those of more than PIVOT_CHARS
    characters aside. Ids alone are ranked; then the few texts come to the driver."""
    named = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), "text").filter("doc_id is not null")
    ranked = named.select("h").distinct().orderBy("h").limit(PIVOT_SAMPLE).agg(F.max("h").alias("h")).first().h
    few = named.filter((F.col("h") <= ranked) & F.length("text").between(1, PIVOT_CHARS)) if ranked is not None else None
    # Of repeated ids the least text counts, so neither partitions nor their order change what is fitted.
    rows = [] if few is None else few.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()
    return Router([x for x in encoder.encode_all([r.text for r in rows]) if len(x)], encoder.terms)


ROUTE = ["pivot", *(f"draw{k}" for k in range(DRAWS))]


def encode_documents(docs: DataFrame, tokenizer_path: str, router: Router) -> DataFrame:
    """(doc_id, ids, pivot, draw0, ...) of ``docs`` (doc_id, text): ids are the text's and END_ID, as
    little-endian bytes. Besides, counts of each task without ids: (term, n), that of a term's documents, of all
    documents as term -1 and of all ids as term -2."""
    schema = "doc_id long, ids binary, " + ", ".join(f"{c} int" for c in ROUTE) + ", term int, n long"
    # Plain arrays, which a worker without this package can read; of fixed size: vocabulary x (PIVOTS + DRAWS).
    kept = docs.sparkSession.sparkContext.broadcast((router.weights, router.clock))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, arrays = kept_encoder(tokenizer_path), kept.value
        df, n, size = np.zeros(encoder.terms, np.int64), 0, 0
        names = ["doc_id", "ids", *ROUTE, "term", "n"]
        for b in batches:
            if not b.num_rows:
                continue
            rows = []
            for x in encoder.encode_all([t or "" for t in b.column(1).to_pylist()]):
                ids = np.append(x, END_ID).astype(encoder.width)
                own = _distinct(ids)
                df[own] += 1
                n, size = n + 1, size + len(ids)
                rows.append((ids.tobytes(), *route(own, *arrays)))
            ids, *routes = zip(*rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), *(pa.array(c, pa.int32()) for c in routes), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int64())], names)
        if n:
            at = np.flatnonzero(df)
            none = [pa.nulls(len(at) + 2, t) for t in (pa.int64(), pa.binary(), *[pa.int32()] * len(ROUTE))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.append(at, [-1, -2]), pa.int32()), pa.array(np.append(df[at], [n, size]))], names)

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def corpus_statistics(tokens: DataFrame, terms: int) -> Statistics:
    """Adds up the tasks' counts; what comes together has no more rows than the vocabulary."""
    counts = {r.term: r.n for r in tokens.filter("ids is null").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, size = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(terms)
    df[list(counts)] = list(counts.values())
    return count_statistics(df, n, size)


def shards(tokens: DataFrame, size: int = 0) -> DataFrame:
    """(doc_id, ids) of ``tokens``, range-partitioned and sorted by content, so that a partition's runs of
    rows are shards. A hash of the row comes last, so equal documents need not stay together.
    ``size`` bytes of ids take so many partitions that each has about PARTITION_BYTES at most."""
    order = [*ROUTE, F.xxhash64("doc_id", "ids")]
    n = -(-size // PARTITION_BYTES)
    more = [n] if n > int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    return tokens.filter("ids is not null").repartitionByRange(*more, *order).sortWithinPartitions(*order).select("doc_id", "ids")


def pack(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """The pieces of all ``docs`` (doc_id, text) as they lie in sequences of at most WINDOW ids:
    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and their ids if asked for.

    A document's ids are its text's and END_ID; null and empty texts have END_ID alone. Every id is
    in one piece. Repeated rows are packed as often as they come, with their doc_id. Sequences have
    WINDOW ids, but for a partition's last ones, of powers of two. Other columns are ignored. An
    empty table gives no rows. Sequence ids are unique, and not gapless.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def out(rows: list[Row]) -> pa.RecordBatch:
        columns = [[r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], *([r[k] for r in rows] for k in (3, 4, 5))]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        if with_ids:
            ends = np.cumsum([0, *columns[2]]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(ends, np.concatenate([r[2] for r in rows]).astype(np.int32)))
        return pa.RecordBatch.from_arrays(arrays, names)

    encoder = Encoder(tokenizer_path)
    width = encoder.width
    tokens = cut(encode_documents(docs, tokenizer_path, fit_router(docs, encoder)), "tokens", compression="zstd")
    stats = corpus_statistics(tokens, encoder.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(encoder_name(tokenizer_path))  # its words take more memory than a shard
        packer, units, size = _Packer(TaskContext.get().partitionId() << 40, stats), [], 0
        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(x.as_buffer(), width)
                units.append(Unit(doc_id, ids, 0, len(ids)))
                size += len(ids)
                if size >= SHARD_TOKENS or len(units) >= SHARD_DOCS:
                    if rows := list(packer.shard(units)):
                        yield out(rows)
                    units, size = [], 0
        if rows := [*packer.shard(units), *packer.end()]:
            yield out(rows)

    return shards(tokens, stats.size * np.dtype(width).itemsize).mapInArrow(run, schema)
