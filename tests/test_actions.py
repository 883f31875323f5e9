"""Action models from moments against direct fits, feature lists, trailing sums against plain sums."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import features, flow, models, study
from tapeloom.operators.asof import asof, thinned


def _rows(seed=0, sessions=4, n=60):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(sessions):
        for _ in range(n):
            x = rng.normal(size=3) * [1, 5, 0.1] + [0, 100, s]
            out.append((f"s{s}", *map(float, x), 7.0, float(x @ [1, -2, 3] + rng.normal()), int(rng.random() < 1 / (1 + np.exp(-x[0])))))
    return out


NAMES = ["a", "b", "c", "d"]  # d is constant


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_rows() + [("s9", None, 1.0, 1.0, 7.0, 1.0, 0), ("s9", 1.0, 1.0, 1.0, 7.0, None, 1)], ["session_id", *NAMES, "cost", "miss"]).cache()


def _ridge(rows, alpha):
    x, y = np.array([r[1:5] for r in rows]), np.array([r[5] for r in rows])
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-9] = 1
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (y - y.mean())) / std
    return w, y.mean() - w @ mean


@pytest.mark.parametrize("alpha", models.ALPHA_GRID)
def test_every_prefix_has_the_ridge_of_its_rows(frame, alpha):
    rows, found = _rows(), models.moments(frame, NAMES, "cost", ["session_id"])
    assert sorted(found) == [("s0",), ("s1",), ("s2",), ("s3",)]
    total = None
    for s in range(4):
        total = found[f"s{s}",] if total is None else total + found[f"s{s}",]
        w, bias = total.ridge(alpha)
        want, at = _ridge([r for r in rows if r[0] <= f"s{s}"], alpha)
        assert np.allclose(w, want, rtol=1e-7, atol=1e-9) and np.isclose(bias, at)
    own = [r for r in rows if r[0] == "s3"]
    mse = np.mean([(np.dot(r[1:5], w) + bias - r[5]) ** 2 for r in own])
    assert np.isclose(found["s3",].mse(w, bias), mse)


def test_alpha_is_chosen_on_the_last_session_and_refitted(frame):
    rows = _rows()
    found = sorted((k[0], v) for k, v in models.moments(frame, NAMES, "cost", ["session_id"]).items())
    errors = []
    for alpha in models.ALPHA_GRID:
        w, bias = _ridge([r for r in rows if r[0] < "s3"], alpha)
        errors.append(np.mean([(np.dot(r[1:5], w) + bias - r[5]) ** 2 for r in rows if r[0] == "s3"]))
    best = models.ALPHA_GRID[int(np.argmin(errors))]
    assert models.choose_alpha(found) == best and models.choose_alpha(found[:1]) == models.ALPHA_GRID[0]
    trials = [t for t in models.ridge_trials(found) if t[0] == "s3"]
    assert np.allclose([t[2] for t in trials], errors) and {t[3] for t in trials} == {180}
    known = frame.dropna(subset=NAMES)
    model = models.fit_action_by_moments(known, NAMES, "miss", "cost")
    w, bias = _ridge(rows, best)
    got = known.filter("cost is not null").select(*NAMES, model.cost().alias("v"), model.miss().alias("p")).collect()
    assert model.alpha == best and all(np.isclose(r.v, np.dot(r[:4], w) + bias) and 0 < r.p < 1 for r in got)


def test_without_a_cost_to_learn_from_every_checkpoint_falls_back(frame):
    none = frame.filter("cost is null")  # a row with a miss, none with a cost
    model, ok = models.fit_action_by_moments(none, NAMES, "miss", "cost"), models.support_rule(none.limit(0), NAMES, 1, 0.1)
    p, v = model.miss(), model.cost()
    got = frame.select(study.risk_allowance_choice(p, p, v, v, F.lit(0.01), ok).alias("d")).select("d.choice", "d.reason").distinct().collect()
    assert [tuple(r) for r in got] == [("SWITCH", "FALLBACK_NONFINITE")]


def test_support_and_feature_lists(frame):
    rows = frame.filter("cost is not null").dropna(subset=NAMES)
    ok = models.support_rule(rows, NAMES, 100, 0.1)
    assert rows.filter(~ok).count() == 0 and rows.filter(models.support_rule(rows, NAMES, 1000, 0.1)).count() == 0
    assert rows.withColumn("a", rows.a + 50).filter(ok).count() == 0
    assert models.support_rule(rows.filter("a > 1e9"), NAMES, 0, 0.1) is not None
    features.check_allowed(features.MARKET + features.QUEUE, "B3")
    for names, policy, said in ((["true_queue_ahead"], "B3", "cannot know"), (["future_mid"], "B3", "cannot know"), (["q_depleted"], "B3_NO_QUEUE", "no feature"), (["side"], "B9", "no list")):
        with pytest.raises(ValueError, match=said):
            features.check_allowed(names, policy)


@pytest.mark.parametrize("seed", [1, 2])
def test_trailing_sums_and_moves_against_plain_ones(spark, seed):
    rng, rows = random.Random(seed), []
    for s in ("x", "y"):
        t = 0
        for k in range(150):
            t += rng.choice([1, 2, 3, 40, 400]) if rng.random() < 0.8 else 1
            rows.append((s, k, t, rng.randrange(1, 9) * 250_000_000, *[rng.randrange(-5, 9) for _ in range(6)]))
    names = ["session_id", "batch_id", "obs_ns", "mid2", *flow.FLOWS]
    table = spark.createDataFrame(rows, names)
    got = {(r.session_id, r.batch_id): tuple(r)[3:] for r in flow.trailing_flow(table, 60).collect()}
    for r in rows:
        assert got[r[:2]] == tuple(sum(q[4 + k] for q in rows if q[0] == r[0] and r[2] - 60 < q[2] <= r[2]) for k in range(6))
    moves = {(r.session_id, r.batch_id): r for r in flow.mid_moves(table, 100, 30).collect()}
    for r in rows:
        of = lambda w: sorted(q for q in rows if q[0] == r[0] and r[2] - w < q[2] <= r[2])  # noqa: B023, E731
        vol, near = of(100), of(30)
        k = [(b[3] - a[3]) / 500_000_000 for a, b in zip(vol, vol[1:])]
        assert np.isclose(moves[r[:2]].mid_vol, np.std(k) if k else 0.0)
        assert np.isclose(moves[r[:2]].mid_change, (r[3] - near[0][3]) / 500_000_000 if len(near) > 1 else 0.0)


@pytest.mark.parametrize("skip", [None, "v"])
def test_asof_over_ranges_against_a_plain_look_back(spark, skip):
    rng = random.Random(7)
    samples = [(s, rng.randrange(-3000, 9000) // 7 * 7, i, None if rng.random() < 0.3 else i) for s in ("a", "b", "c") for i in range(80)]
    probes = [(s, i, None if i % 11 == 0 else rng.randrange(-4000, 20_000)) for s in ("a", "b", "d") for i in range(150)]
    want = {}
    for s, i, t in probes:
        seen = [x for x in samples if x[0] == s and t is not None and x[1] <= t and (skip is None or x[3] is not None)]
        last = max(seen, key=lambda x: (x[1], x[2]), default=None)
        want[s, i] = (last and last[3], last and last[1])
    p = spark.createDataFrame(probes, "s string, i long, at long")
    q = spark.createDataFrame(samples, "s string, t long, seq long, v long")
    for width in (100, 1000, 10**6):
        got = {(r.s, r.i): (r.v, r.sample_time) for r in asof(p, q, ["s"], "at", "t", "seq", ["v"], skip, width).collect()}
        assert got == want


@pytest.mark.parametrize("skip", [None, "v"])
def test_few_probes_find_the_same_among_the_rows_that_they_can_find(spark, skip):
    rng = random.Random(3)
    samples = spark.createDataFrame([(s, rng.randrange(-3000, 9000) // 7 * 7, i, None if rng.random() < 0.3 else i) for s in ("a", "b", "c") for i in range(300)], "s string, t long, seq long, v long")
    probes = spark.createDataFrame([(s, i, None if i == 3 else rng.randrange(-4000, 20_000)) for s in ("a", "b", "d") for i in range(9)], "s string, i long, at long")
    for width in (100, 10**6):
        few = thinned(samples, probes, ["s"], "at", "t", "seq", ["v"], skip, width)
        found = [{(r.s, r.i): (r.v, r.sample_time) for r in asof(probes, q, ["s"], "at", "t", "seq", ["v"], skip, width).collect()} for q in (samples, few)]
        assert found[0] == found[1] and (width == 100 or few.count() < samples.count() / 10)
