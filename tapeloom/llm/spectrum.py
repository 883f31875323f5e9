"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

By Sylvester's law the positive pivots of an LDL' factorisation of A - sI number the eigenvalues above s. Such
counts isolate the k-th largest eigenvalue in an interval; its middle is nearer to it than to any other, so
inverse iteration there turns to its vector, and Rayleigh quotient iteration ends it with cubic
convergence. At last the counts beside every value found certify its number. Eigenvalues that no
count can tell apart are one cluster, whose vectors are made orthogonal one after another.
"""

from __future__ import annotations

import numpy as np

_ALPHA = (1 + 17**0.5) / 8
_EPS = np.finfo(float).eps


def _swap(m: np.ndarray, i: int, j: int) -> None:
    if i != j:
        m[[i, j]] = m[[j, i]]
        m[:, [i, j]] = m[:, [j, i]]


def count_above(a: np.ndarray, shift: float) -> int:
    """The eigenvalues of ``a`` above ``shift``, from an LDL' factorisation with pivots of one or two rows."""
    m = a - shift * np.eye(len(a))
    n, k, above = len(m), 0, 0
    while k < n:
        pivot, below = abs(m[k, k]), abs(m[k + 1 :, k])
        most = below.max(initial=0.0)
        if pivot == most == 0:  # an eigenvalue at the shift itself
            k += 1
            continue
        size = 1
        if pivot < _ALPHA * most:
            r = k + 1 + int(below.argmax())
            row = abs(m[r, k:])
            row[r - k] = 0
            if pivot * row.max() < _ALPHA * most**2:
                if abs(m[r, r]) >= _ALPHA * row.max():
                    _swap(m, k, r)
                else:
                    _swap(m, k + 1, r)
                    size = 2
        block, rest = m[k : k + size, k : k + size], m[k + size :, k : k + size]
        if size == 1:
            above += int(block[0, 0] > 0)
            m[k + 1 :, k + 1 :] -= np.outer(rest[:, 0], rest[:, 0] / block[0, 0])
        else:
            det = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            above += 1 if det < 0 else 2 * int(block[0, 0] + block[1, 1] > 0)
            inverse = np.array([[block[1, 1], -block[0, 1]], [-block[0, 1], block[0, 0]]]) / det
            m[k + 2 :, k + 2 :] -= rest @ inverse @ rest.T
        k += size
    return above


class _Slices:
    """Counts at shifts, remembered."""

    def __init__(self, a: np.ndarray):
        self.a, radius = a, abs(a).sum(axis=1).max(initial=0.0)
        self.least = 4 * len(a) * _EPS * radius
        self.at = {-1.01 * radius: len(a), 1.01 * radius: 0}

    def count(self, shift: float) -> int:
        if shift not in self.at:
            self.at[shift] = count_above(self.a, shift)
        return self.at[shift]

    def around(self, k: int) -> tuple[float, float]:
        """The tightest known interval of the k-th largest eigenvalue."""
        return max(s for s, c in self.at.items() if c >= k), min(s for s, c in self.at.items() if c < k)

    def isolate(self, k: int) -> tuple[float, float]:
        """An interval of the k-th largest eigenvalue alone, or of a cluster as narrow as counts can tell."""
        lo, hi = self.around(k)
        while hi - lo > self.least and not (self.at[lo] == k and self.at[hi] == k - 1):
            self.count((lo + hi) / 2)
            lo, hi = self.around(k)
        return lo, hi

    def halve(self, k: int) -> None:
        lo, hi = self.around(k)
        self.count((lo + hi) / 2)


def _solve(a: np.ndarray, shift: float, v: np.ndarray, nudge: float) -> np.ndarray:
    """(a - shift I)^-1 v; a singular matrix is shifted on, which only makes the vector better."""
    while True:
        try:
            found = np.linalg.solve(a - shift * np.eye(len(a)), v)
            if np.isfinite(found).all():
                return found
        except np.linalg.LinAlgError:
            pass
        shift, nudge = shift + nudge, 2 * nudge


def _pair(a: np.ndarray, shift: float, found: np.ndarray, least: float, rng) -> tuple[float, np.ndarray]:
    """An eigenpair near ``shift``, orthogonal to the columns of ``found``."""

    def unit(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - found @ (found.T @ v)
            v = v / np.linalg.norm(v)
        return v

    v, nudge = unit(rng.standard_normal(len(a))), max(least, np.finfo(float).tiny)
    for _ in range(4):
        v = unit(_solve(a, shift, v, nudge))
    best = (np.inf, 0.0, v)
    for _ in range(12):
        rho = float(v @ a @ v)
        off = np.linalg.norm(a @ v - rho * v)
        if off >= best[0]:
            break
        best = (off, rho, v)
        v = unit(_solve(a, rho, v, nudge))
    return best[1], best[2]


def leading_eigenpairs(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of the symmetric matrix ``a``, falling, and their unit vectors as
    columns. The same matrix gives the same signs. A zero matrix has zeros and some orthonormal
    vectors. Raises if the counts do not certify the numbering."""
    a = np.asarray(a, float)
    count, slices, rng = min(count, len(a)), _Slices(a), np.random.default_rng(0)
    if not a.any():
        return np.zeros(count), np.eye(len(a))[:, :count]
    values, vectors = np.zeros(count), np.zeros((len(a), 0))
    for k in range(1, count + 1):
        while True:
            lo, hi = slices.isolate(k)
            rho, v = _pair(a, (lo + hi) / 2, vectors, slices.least, rng)
            if lo - slices.least <= rho <= hi + slices.least or hi - lo <= slices.least:
                break
            slices.halve(k)  # the iteration left for a neighbour
        values[k - 1], vectors = rho, np.column_stack([vectors, v * (1 if v[abs(v).argmax()] > 0 else -1)])
    for k, rho in enumerate(values, 1):
        if slices.count(rho - 2 * slices.least) < k or slices.count(rho + 2 * slices.least) > k - 1:
            raise ArithmeticError(f"eigenvalue {k} at {rho} is not certified by the counts beside it")
    return values, vectors
