"""Document quality by a factorisation machine.

Inputs are hashed words, statistics of the text's structure and its given length (metadata), the
latter two as one-hot bins. Each input has a weight and a vector of RANK numbers; a pair of inputs
interacts by their vectors' product. The sum over pairs is 1/2 sum_f [(sum v x)^2 - sum (v x)^2], so
a text is scored in time linear in its inputs.
"""

from __future__ import annotations

import math
import pickle
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeloom.llm.common import labelled_sample, text_batches

#: The model is fitted on so many labelled rows at most, with texts of so many characters at most.
SAMPLE_ROWS, SAMPLE_CHARS = 5000, 100_000
BUCKETS, BINS, RANK = 1 << 16, 10, 8
EPOCHS, BATCH, RATE, DECAY, SEED = 25, 256, 0.01, 1e-4, 7
CACHE_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_UPPER, _DIGIT, _SYMBOL, _STOP = (s.encode() for s in (string.ascii_uppercase, string.digits, "#*$%&|<>{}[]^~=+\\/@_", ".,;:!?"))


def statistics(text: str, n_chars: int | None) -> list[float]:
    """The structure of a text and its given length; of an empty text too."""
    raw = text.encode()
    size = max(len(raw), 1)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, distinct = len(words), len(set(words))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    marked = sum(w[-1] in "*#$%&|!" for w in words)
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(n), distinct / max(n, 1), pairs / max(n - 1, 1), sum(map(len, words)) / max(n, 1), max(map(len, words), default=0),
        share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_STOP), share(b"!"), share(b"|"), marked / max(n, 1),
        math.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), math.log1p(n_chars if n_chars is not None else len(text)),
    ]


class _Words:
    """The distinct hash buckets of a text's words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def buckets(self, text: str) -> list[int]:
        known, out = self.known, set()
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(_WORD.findall(text.lower())):
            b = known.get(w)
            if b is None:
                known[w] = b = zlib.crc32(w.encode()) % BUCKETS
            out.add(b)
        return sorted(out)


class Machine:
    """``edges``: per statistic, the bounds of its bins. Without ``edges`` it has learned nothing and
    scores every text 1."""

    def __init__(self, edges=None, w0: float = 0.0, w=None, v=None):
        self.edges, self.w0, self.w, self.v = edges, w0, w, v
        self.words = _Words()

    def state(self) -> tuple:
        return self.edges, self.w0, self.w, self.v

    def inputs(self, text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        own = self.words.buckets(text)
        bins = [BUCKETS + BINS * k + int(np.searchsorted(e, x, side="right")) for k, (e, x) in enumerate(zip(self.edges, statistics(text, n_chars)))]
        return np.array(own + bins), np.array([1 / math.sqrt(max(len(own), 1))] * len(own) + [1.0] * len(bins), np.float32)

    def score(self, text: str | None, n_chars: int | None) -> float:
        if self.edges is None:
            return 1.0
        i, x = self.inputs(text or "", n_chars)
        vx = self.v[i] * x[:, None]
        z = self.w0 + float(self.w[i] @ x) + 0.5 * float((vx.sum(0) ** 2).sum() - (vx * vx).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[str, int | None, int]]) -> Machine:
    """Adam on the log loss of (text, n_chars, label) rows, by shuffled batches; the seed is fixed."""
    if not rows or len({r[2] for r in rows}) < 2:
        return Machine()
    stats = np.array([statistics(t, n) for t, n, _ in rows])
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in stats.T]
    size, rng = BUCKETS + BINS * len(edges), np.random.default_rng(SEED)
    m = Machine(edges, 0.0, np.zeros(size, np.float32), rng.normal(0, 0.01, (size, RANK)).astype(np.float32))
    data, y = [m.inputs(t, n) for t, n, _ in rows], np.array([r[2] for r in rows], float)
    m.w0 = float(np.log(y.mean() / (1 - y.mean())))
    # Column 0 of each is the weight, the rest the vector.
    mean, square, step, b0 = np.zeros((size, RANK + 1), np.float32), np.zeros((size, RANK + 1), np.float32), 0, np.zeros(2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            i = np.concatenate([data[k][0] for k in part])
            x = np.concatenate([data[k][1] for k in part])
            row = np.repeat(np.arange(len(part)), [len(data[k][0]) for k in part])
            starts = np.searchsorted(row, np.arange(len(part)))
            vx = m.v[i] * x[:, None]
            total = np.add.reduceat(vx, starts)
            z = m.w0 + np.add.reduceat(m.w[i] * x, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            gx = (g[row] * x).astype(np.float32)
            used, at = np.unique(i, return_inverse=True)
            grad = np.empty((len(used), RANK + 1), np.float32)
            grad[:, 0] = np.bincount(at, gx, len(used)) + DECAY * m.w[used]
            inner = gx[:, None] * (total[row] - vx)
            for f in range(RANK):
                grad[:, f + 1] = np.bincount(at, inner[:, f], len(used)) + DECAY * m.v[used, f]
            step += 1
            mean[used] = 0.9 * mean[used] + 0.1 * grad
            square[used] = 0.999 * square[used] + 0.001 * grad**2
            move = RATE * (mean[used] / (1 - 0.9**step)) / (np.sqrt(square[used] / (1 - 0.999**step)) + 1e-8)
            m.w[used] -= move[:, 0]
            m.v[used] -= move[:, 1:]
            b0 = 0.9 * b0[0] + 0.1 * g.sum(), 0.999 * b0[1] + 0.001 * g.sum() ** 2
            m.w0 -= RATE * (b0[0] / (1 - 0.9**step)) / (math.sqrt(b0[1] / (1 - 0.999**step)) + 1e-8)
    return m


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Machine:
    """A machine from the rows of ``docs`` (doc_id, text, n_chars) that ``labels`` (doc_id, label)
    names; a bounded sample of them goes to one task, and only the machine comes to the driver."""
    rows = labelled_sample(docs.select("doc_id", "text", "n_chars"), labels, sample_rows, sample_chars)
    one = rows.select("doc_id", "text", "n_chars", "label").repartition(1).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [(t or "", n, y) for b in batches for t, n, y in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample).state())], pa.binary())], names=["machine"])

    found = text_batches(one).mapInArrow(run, "machine binary").collect()
    return Machine(*pickle.loads(found[0].machine)) if found else Machine()


def score(docs: DataFrame, machine: Machine, output: str = "score") -> DataFrame:
    """``docs`` (text, n_chars and any others) with a double ``output`` from 0 to 1, higher for better
    texts; a column of that name is replaced.

    Whole texts are scored. A null text counts as empty, a null n_chars as the text's length; rows
    and other columns stay as they are.
    """
    kept = docs.sparkSession.sparkContext.broadcast(machine.state())  # of fixed size: BUCKETS x (RANK + 1)
    docs = docs.drop(output)
    names = docs.columns
    at, length = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    schema = T.StructType([*docs.schema.fields, T.StructField(output, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*kept.value)
        for b in batches:
            n = b.column(length).to_pylist() if length is not None else [None] * b.num_rows
            scores = [own.score(t, c) for t, c in zip(b.column(at).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*names, output])

    return text_batches(docs).mapInArrow(run, schema)
