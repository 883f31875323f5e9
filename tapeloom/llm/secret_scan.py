"""Secrets in texts, by regexes behind a trigram index.

A Boolean query over trigrams is derived from each rule's parsed regex. Documents are indexed in
blocks that lie within a partition; a block's postings answer the queries, and a rule's regex runs on
the documents that remain. A rule without mandatory trigrams runs on all. Nothing is shuffled, and a
block is bounded in rows and bytes (one document at least).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import text_batches


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
#: Sets of exact strings are kept while they have at most so many members.
MAX_STRINGS = 32

# A query is True (no demand), a trigram's code, ("and", queries) or ("or", queries).


def _all(queries: list):
    kept = [q for q in queries if q is not True]
    return True if not kept else kept[0] if len(kept) == 1 else ("and", kept)


def _any(queries: list):
    return True if any(q is True for q in queries) else queries[0] if len(queries) == 1 else ("or", queries)


def _of_strings(strings: set[str]):
    """What a text with one of these strings holds, A-Z in lower case."""

    def one(s: str):
        b = s.encode().lower()
        return _all([b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)])

    return _any([one(s) for s in sorted(strings)])


def _options(item) -> set[str] | None:
    """The strings that a part of a pattern matches, if these are few."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()} if arg < 128 else {chr(arg)}
    if op is sre.IN:
        found = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                found.add(chr(x).lower() if x < 128 else chr(x))
            elif kind is sre.RANGE and x[1] - x[0] < MAX_STRINGS:
                found |= {chr(c).lower() if c < 128 else chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])[0]
    if op is sre.BRANCH:
        parts = [_sequence(p)[0] for p in arg[1]]
        return None if any(p is None for p in parts) or len(x := set().union(*parts)) > MAX_STRINGS else x
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1 and (x := _sequence(arg[2])[0]) is not None:
        return x | ({""} if arg[0] == 0 else set())
    return {""} if op is sre.AT else None


def _demand(item):
    """A query that holds for any text with a match of a part that has no few strings."""
    op, arg = item
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])[1]
    if op is sre.BRANCH:
        return _any([_sequence(p)[1] for p in arg[1]])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
        return _sequence(arg[2])[1]
    return True


def _sequence(items) -> tuple[set[str] | None, object]:
    """The strings that a sequence matches, if few; and a query for it."""
    exact, whole, demands = {""}, True, []
    for item in items:
        options = _options(item)
        if options is not None and len(exact) * len(options) <= MAX_STRINGS:
            exact = {a + b for a in exact for b in options}
            continue
        whole = False
        demands.append(_of_strings(exact))
        exact = options if options is not None else {""}
        if options is None:
            demands.append(_demand(item))
    demands.append(_of_strings(exact))
    return (exact if whole else None), _all(demands)


def trigram_query(pattern: str):
    """The Boolean trigram query of a regex: a text that it doesn't fit has no match. True: any may."""
    return _sequence(parser.parse(pattern))[1]


def _trigrams(query) -> set[int]:
    if query is True:
        return set()
    return {query} if isinstance(query, int) else set().union(*(_trigrams(q) for q in query[1]))


class _Index:
    """Postings of the wanted trigrams over a block of texts."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray):
        # Two separators keep trigrams from running over two texts.
        joined = np.frombuffer(b"\xff\xff".join(t.lower() for t in texts), np.uint8).astype(np.int32)
        self.n, self.postings = len(texts), {}
        if len(joined) < 3:
            return
        ends = np.cumsum([len(t) + 2 for t in texts])
        code = joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]
        at = np.flatnonzero(wanted[code])
        pairs = np.unique(code[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
        codes, first = np.unique(pairs >> 32, return_index=True)
        for c, part in zip(codes.tolist(), np.split(pairs & 0xFFFFFFFF, first[1:])):
            self.postings[c] = part

    def ask(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, int):
            return self.postings.get(query, np.empty(0, np.int64))
        parts = sorted((self.ask(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def _blocks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of ``texts`` to index together, with the place of the first; null texts are empty."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        if k > lo and (k - lo == BLOCK_ROWS or size + len(t or b"") > BLOCK_BYTES):
            yield lo, [x or b"" for x in texts[lo:k]]
            lo, size = k, 0
        size += len(t or b"")
    if texts:
        yield lo, [x or b"" for x in texts[lo:]]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) for each row of ``docs`` (doc_id, text): each rule's matches by start, then by
    the rules' order; start and end are code points, end is exclusive.

    Null and empty texts have no spans; repeated rows stay; other columns are ignored; an empty
    table gives no rows. Spans of different rules may overlap.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regexes = [re.compile(r.pattern, re.ASCII) for r in rules]
        wanted = np.zeros(1 << 24, bool)
        wanted[sorted(set().union(*(_trigrams(q) for q in queries)))] = True
        for b in batches:
            all_ids = b.column(0).to_pylist()
            for lo, texts in _blocks(b.column(1).to_pylist()):
                ids = all_ids[lo : lo + len(texts)]
                index, found, strings = _Index(texts, wanted), [[] for _ in ids], {}
                for k, (rule, regex, query) in enumerate(zip(rules, regexes, queries)):
                    for d in index.ask(query).tolist():
                        if d not in strings:
                            strings[d] = texts[d].decode()
                        for m in regex.finditer(strings[d]):
                            s, e = m.span(rule.group)
                            if e - s >= rule.least:
                                found[d].append((m.start(), k, m.end()))
                spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(x)] for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).mapInArrow(run, SPANS)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch of text that matches cover replaced by ``mask``; matches that overlap, of one
    rule or of several, are one stretch with one mask. Other columns, whatever their names, row count, repeated
    rows, null and empty texts stay; an empty table stays empty. Texts of any length are scanned whole."""
    regexes = [(r, trigram_query(r.pattern)) for r in rules]
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        wanted = np.zeros(1 << 24, bool)
        wanted[sorted(set().union(*(_trigrams(q) for _, q in regexes)))] = True
        for b in batches:
            texts = b.column(at).to_pylist()
            for lo, block in _blocks([None if t is None else t.encode() for t in texts]):
                part = texts[lo : lo + len(block)]
                index = _Index(block, wanted)
                found: dict[int, list] = {}
                for (rule, query), regex in zip(regexes, compiled):
                    for d in index.ask(query).tolist():
                        for m in regex.finditer(part[d] or ""):
                            s, e = m.span(rule.group)
                            if e - s >= rule.least:
                                found.setdefault(d, []).append(m.span())
                for d, spans in found.items():
                    out, last = [], 0
                    for s, e in sorted(spans):
                        if s >= last:
                            out += [part[d][last:s], mask]
                        last = max(last, e)
                    texts[lo + d] = "".join([*out, part[d][last:]])
            columns = b.columns
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return text_batches(docs).mapInArrow(run, schema)
