import math

import numpy as np
import pytest

from tapeloom.llm.spectrum import count_above, leading_eigenpairs
from tapeloom.llm.whitening import fit, whiten


def _symmetric(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("d", [1, 2, 3, 8, 40, 64])
def test_counts_are_those_of_the_spectrum(d):
    rng = np.random.default_rng(d)
    for values in (rng.standard_normal(d), rng.integers(-2, 3, d).astype(float), np.zeros(d)):
        a = _symmetric(rng, values)
        for s in (-1.5, -0.1234, 0.3217, 1.7):
            assert count_above(a, s) == (values > s).sum()
    hollow = np.ones((d, d)) - np.eye(d)  # only pivots of two rows will do
    assert count_above(hollow, 0.0) == (d > 1)


@pytest.mark.parametrize("values", [np.arange(40.0), np.repeat([5.0, 5.0, 2.0, 1e-9], 8), 2.0 ** -np.arange(40.0), 1 + 1e-13 * np.arange(30), np.zeros(6), np.array([3.0])])
def test_pairs_are_the_leading_ones(values):
    a = _symmetric(np.random.default_rng(3), values)
    k = min(32, len(values))
    found, vectors = leading_eigenpairs(a, 32)
    scale = max(abs(values).max(), 1e-300)
    assert np.allclose(found, np.sort(values)[::-1][:k], rtol=0, atol=1e-13 * scale * len(values))
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-10)
    assert abs(a @ vectors - vectors * found).max() <= 1e-12 * scale * len(values)


def _rows(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) @ rng.standard_normal((d, d))).astype(np.float32)


def test_whitened_rows(spark):
    c = _rows(500, 40)
    c[:170] = c[0]  # a third is one vector
    bad = [(1000, None), (1001, [1.0] * 39 + [None]), (1002, [math.nan] * 40), (1003, [math.inf] + [0.0] * 39), (1004, [-math.inf] * 40)]
    rows = [(i, v.tolist()) for i, v in enumerate(c)] + bad + [(7, c[7].tolist()), (None, c[9].tolist())]
    x = np.floor(64 * np.array([v for _, v in rows[:500] + rows[-2:]], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov((x - x.mean(axis=0)).T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, n string").repartition(6)
    got = whiten(table, "vec_id", "embedding").collect()
    assert len(got) == n * 32 and {r.component for r in got} == set(range(1, 33))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    plain = (x - total / n) @ axes / np.sqrt(values)
    sign = np.zeros(33)
    for r in got:
        if r.id == 3:
            sign[r.component] = np.sign(r.whitened * plain[3, r.component - 1])
    for r in got:
        k = 9 if r.id is None else r.id
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], total))
        assert math.isclose(r.whitened * sign[r.component], plain[k, r.component - 1], abs_tol=1e-7)
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(v) * 1e9 for v in r]) for i, r in enumerate(_rows(20, 3))]
    found = fit(spark.createDataFrame(rows, "id long, v array<double>"), "v")
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n = len(x)
    mean = [sum(c) for c in zip(*x)]
    exact = sum(sum((n * a - m) ** 2 for a, m in zip(r, mean)) for r in x) / n**3
    assert math.isclose(found.trace, exact, rel_tol=1e-14)


def test_fewer_components_no_variance_no_rows_and_other_dimensions(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "id long, v array<double>")
    assert [(r.component, r.whitened, r.deviation, r.explained, r.identity_error) for r in whiten(same, "id", "v").collect()] == [(1, None, 0, 0.0, 0.0), (2, None, 0, 0.0, 0.0)] * 3
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "id long, v array<double>")
    got = whiten(line, "id", "v").collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and got[0].identity_error < 1e-12
    assert whiten(line.filter("id < 0"), "id", "v").count() == 0
    assert whiten(spark.createDataFrame([(1, None)], "id long, v array<double>"), "id", "v").count() == 0
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>").repartition(2, "id")
    with pytest.raises(Exception, match="several dimensions"):
        whiten(mixed, "id", "v").collect()
