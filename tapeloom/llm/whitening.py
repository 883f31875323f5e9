"""Whitening of embeddings with the leading components of their covariance, found by spectrum slicing.

Entries are rounded to whole steps, so sums and sums of products are whole numbers that tasks add up exactly,
in any order. Products are of entries less the whole number next to their mean. A matrix of
dimension x dimension comes to the driver, however many vectors there are; nothing is drawn as a sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.spectrum import leading_eigenpairs

STEP, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Eigenvalues below this part of the largest one, times the dimension, are none.
NO_VARIANCE = 1e-15
_SUMS = "i int, j int, v decimal(38,0)"


@dataclass
class Whitening:
    """Of ``n`` vectors: the whole number next to each dimension's mean, what is left of the sum
    beside it, the eigenvalues, the components as columns and the covariance's trace."""

    n: int
    centre: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def real(self) -> np.ndarray:
        """Which components have a variance to divide by."""
        return self.values > NO_VARIANCE * len(self.centre) * self.values.max(initial=0.0)

    def project(self, y: np.ndarray) -> np.ndarray:
        """Vectors less ``centre``, whitened; components without variance are NaN."""
        scale = np.sqrt(np.where(self.real(), self.values, np.nan))
        return (y - np.array([r / self.n for r in self.rest])) @ self.vectors / scale


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """The rows of ``vectors`` whose array in ``column`` has numbers alone."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.filter(F.col(column).isNotNull() & F.forall(F.col(column).cast("array<double>"), finite))


def whole(column: pa.Array) -> np.ndarray:
    """Vectors as rows of whole numbers: floor(STEP * c) + OFFSET."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1:
        raise ValueError("vectors of several dimensions")
    c = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(STEP * c).astype(np.int64).reshape(len(sizes), -1) + OFFSET


def _products(y: np.ndarray) -> np.ndarray:
    """y'y in whole numbers: by floating point where no sum can pass 2^53, else number by number."""
    most = int(abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        z = y.astype(float)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def _column_sums(y: np.ndarray) -> np.ndarray:
    most = int(abs(y).max(initial=0))
    return (y if most * len(y) < 1 << 62 else y.astype(object)).sum(axis=0).astype(object)


def _entries(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    i, j, v = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(x)) for x in v], pa.decimal128(38, 0))], ["i", "j", "v"])


def _total(rows: DataFrame, column: str, measure) -> dict[tuple[int, int], int]:
    """Exact sums over all ``rows`` of what ``measure`` makes of a batch's vectors, a dict by (i, j). A task
    sends one row for each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            if b.num_rows:
                for key, v in measure(whole(b.column(0))).items():
                    total[key] = total.get(key, 0) + v
        if total:
            yield _entries([(i, j, v) for (i, j), v in total.items()])

    parts = rows.select(F.col(column).cast("array<double>")).mapInArrow(run, _SUMS)
    return {(r.i, r.j): int(r.v) for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def fit(vectors: DataFrame, column: str, components: int = COMPONENTS) -> Whitening | None:
    """From all usable rows of ``vectors``; None where there are none. Vectors of several dimensions are an
    error."""
    rows = usable(vectors, column)

    def sums(x: np.ndarray) -> dict:
        return {(-1, x.shape[1]): len(x)} | {(0, k): v for k, v in enumerate(_column_sums(x))}

    first = _total(rows, column, sums)
    counts = {k[1]: v for k, v in first.items() if k[0] == -1}
    if not counts:
        return None
    if len(counts) > 1:
        raise ValueError("vectors of several dimensions")
    (d, n), = counts.items()
    total = [first[0, k] for k in range(d)]
    near = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * c for s, c in zip(total, near)]
    centre = np.array(near, np.int64)
    upper = np.triu_indices(d)

    def products(x: np.ndarray) -> dict:
        return dict(zip(zip(*(u.tolist() for u in upper)), _products(x - centre)[upper]))

    second = _total(rows, column, products)
    cov = np.zeros((d, d))
    for (i, j), v in second.items():
        cov[i, j] = cov[j, i] = (n * v - rest[i] * rest[j]) / (n * n)
    values, axes = leading_eigenpairs(cov, components)
    return Whitening(n, centre, rest, np.maximum(values, 0), axes, float(np.trace(cov)))


def identity_error(vectors: DataFrame, column: str, found: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, over all usable rows and
    the components with variance; 0 without any."""
    real = found.real()
    k = int(real.sum())
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                w = found.project(whole(b.column(0)) - found.centre)[:, real]
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    parts = usable(vectors, column).select(F.col(column).cast("array<double>")).mapInArrow(run, "i int, j int, v double")
    total = np.zeros((k + 1, k))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v
    mean = total[k] / found.n  # of rows that are centred already
    return float(abs(total[:k] / found.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(y: np.ndarray, found: Whitening) -> list[int]:
    """Sums of (n x - S)^2, exact; in whole numbers of any size where 64 bits may not do."""
    most = found.n * int(abs(y).max(initial=0)) + max(map(abs, found.rest), default=0)
    exact = np.int64 if most * most * max(y.shape[1], 1) < 1 << 63 else object
    off = found.n * y.astype(exact) - np.array(found.rest, exact)
    return (off * off).sum(axis=1).tolist()


def whiten(vectors: DataFrame, id_column: str, column: str, components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row for each usable row of
    ``vectors`` and component, numbered from 1, of at most ``components`` and the dimension.

    Rows whose array is null or holds nulls, NaN or infinities are dropped; vectors of several
    dimensions are an error. A repeated or null id is a row like others, other columns are ignored, no
    usable rows give no rows. A component without variance has a null ``whitened`` and explains
    0. ``deviation`` fails where it passes 64 bits.
    """
    found = fit(vectors, column, components)
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(vectors, column, found), len(found.values)
    explained = found.values / found.trace if found.trace else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y, m = whole(b.column(1)) - found.centre, b.num_rows * k
            columns = [
                b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                pa.array(np.full(m, found.n)),
                pa.array(np.repeat(np.array(_deviations(y, found), np.int64), k)),
                pa.array(found.project(y).ravel(), from_pandas=True),
                pa.array(np.tile(explained, b.num_rows)),
                pa.array(np.full(m, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable(vectors, column).select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(run, schema)
