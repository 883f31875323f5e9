"""Toxic documents and their offending sentences, by multiple-instance learning.

Only documents have labels. A sentence's score is a logistic function of its words; a document's is
the noisy-or of its sentences, 1 - prod(1 - p). The words' weights are fitted to the documents'
labels through the noisy-or, on a bounded sample, and then find the sentences themselves.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import labelled_sample, text_batches

#: The model is fitted on so many labelled rows at most, with texts of so many characters at most.
SAMPLE_ROWS, SAMPLE_CHARS = 5000, 100_000
STEPS, RATE, DECAY = 250, 0.3, 2e-5
#: A feature needs so many toxic texts, and so many times the base rate of toxic texts among its own.
LEAST_TOXIC, LEAST_LIFT = 4, 2.5
#: Words also count by their first letters, as insults come with many endings.
PREFIXES = (4, 5, 6, 7)
#: Words whose weight a task remembers.
CACHE_WORDS = 200_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word and its beginnings, these with a mark."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


@dataclass
class SentenceModel:
    """A sentence's logit: ``bias`` and the weights of its distinct words' features. ``fitted`` is
    False where there was nothing to learn from; every score is then 0."""

    weights: dict[str, float]
    bias: float = 0.0
    fitted: bool = True
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, word: str) -> float:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        self.known[word] = w = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def logits(self, text: str) -> list[tuple[float, int, int]]:
        known, out = self.known, []
        for m in _SENTENCE.finditer(text):
            words = set(_WORD.findall(m[0].lower()))
            if words:
                out.append((self.bias + sum(known[w] if w in known else self.weight(w) for w in words), m.start(), m.end()))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and its sentences of 0.5 or more, as (start, end, score)."""
        if not self.fitted:
            return 0.0, []
        spread = [(np.logaddexp(0.0, z), z, s, e) for z, s, e in self.logits(text or "")]
        bad = [(s, e, float(1 / (1 + np.exp(-z)))) for _, z, s, e in spread if z >= 0]
        return float(-np.expm1(-sum(x[0] for x in spread))), bad


def fit(texts: list[str], labels: list[int]) -> SentenceModel:
    """Gradient steps (Adam) on the noisy-or's log likelihood, over the features that lift the rate
    of toxic texts."""
    if not texts or len(set(labels)) < 2:
        return SentenceModel({}, fitted=False)
    # Texts are taken apart anew each time: their words, as Python strings, are many times their size.
    split = lambda t: [set(_WORD.findall(x.lower())) for x in _SENTENCE.findall(t or "")]
    toxic: Counter = Counter()
    for t, label in zip(texts, labels):
        if label:
            toxic.update({f for w in set().union(*split(t)) for f in features(w)})
    toxic = Counter({f: n for f, n in toxic.items() if n >= LEAST_TOXIC})
    seen: Counter = Counter()
    for t in texts:
        seen.update({f for w in set().union(*split(t)) for f in features(w) if f in toxic})
    base = sum(labels) / len(labels)
    vocab = {f: i for i, f in enumerate(sorted(f for f, n in toxic.items() if n >= LEAST_LIFT * base * seen[f]))}
    word, sentence, doc, s = array("l"), array("l"), array("l"), 0
    for d, t in enumerate(texts):
        for words in split(t):
            own = {vocab[f] for x in words for f in features(x) if f in vocab}
            word.extend(own)
            sentence.extend([s] * len(own))
            doc.append(d)
            s += 1
    word, sentence, doc = np.array(word, np.int64), np.array(sentence, np.int64), np.array(doc, np.int64)
    y, n, v = np.array(labels, float), len(texts), len(vocab)
    w, b = np.zeros(v), -6.0
    m, u = np.zeros(v + 1), np.zeros(v + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sentence, weights=w[word], minlength=s)
        total = np.bincount(doc, weights=np.logaddexp(0.0, z), minlength=n)
        gain = np.where(y == 1, np.exp(-total) / np.maximum(-np.expm1(-total), 1e-9), -1.0)
        g = gain[doc] / (1 + np.exp(-z)) / n
        grad = np.append(np.bincount(word, weights=g[sentence], minlength=v) - DECAY * w, g.sum())
        m, u = 0.9 * m + 0.1 * grad, 0.999 * u + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-9)
        w, b = w + move[:-1], b + move[-1]
    keep = np.abs(w) > 1e-3
    return SentenceModel({x: float(w[i]) for x, i in vocab.items() if keep[i]}, float(b))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> SentenceModel:
    """A model from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, label) names; a bounded
    sample of them comes to the driver."""
    rows = labelled_sample(docs.select("doc_id", "text"), labels, sample_rows, sample_chars).collect()
    return fit([r.text or "" for r in rows], [r.label for r in rows])


SCORES = "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """(doc_id, score, sentences) for each row of ``docs`` (doc_id, text).

    Texts are scored whole; sentences are the stretches between ``.``, ``!``, ``?`` and line ends,
    and those of 0.5 or more are returned with their code points. A null or empty text has no
    sentence and the score 0. Repeated rows stay, other columns are ignored.
    """
    kept = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.fitted))  # at most the sample's words
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SentenceModel(*kept.value)
        for b in batches:
            found = [own.score(t) for t in b.column(1).to_pylist()]
            spans = [[{"start": s, "end": e, "score": p} for s, e, p in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array(spans, span)], ["doc_id", "score", "sentences"])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, SCORES)
