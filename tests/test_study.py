import pytest
from pyspark.sql import functions as F

from tapeloom.functions.metrics import tick_aligned
from tapeloom.operators.tasks import valid_horizons
from tapeloom.operators.worlds import guard_ns, worlds
from tapeloom.sources.schemas import LATENCY
from tapeloom.functions import metrics as M
from tapeloom.operators import study as S
from tapeloom.operators.asof import asof

RESULT = "task_id string, session_id string, policy_id string, scenario_id string, horizon_ns long, side int, status string, is_ticks_net double, passive_filled boolean"


def results(spark, rows):
    return spark.createDataFrame([(t, s, p, "L1", 1, 1, st, v, False) for t, s, p, st, v in rows], RESULT)


def pair(t, s, base, cand, status=S.COMPLETED):
    return [(t, s, "X", status, base), (t, s, "Y", status, cand)]


def test_sessions_weigh_the_same(spark):
    rows = pair("a1", "A", 4.0, 0.0) + pair("a2", "A", 6.0, 0.0) + [r for k in range(100) for r in pair(f"b{k}", "B", 0.0, 1.0)] + [("c1", "C", "X", S.MISS, None), ("c1", "C", "Y", S.MISS, None)]
    e = S.effect(S.session_means(S.validated(results(spark, rows), "X", "Y"), S.cost_diff())).first()
    assert (e.estimate, e.n_sessions_defined, e.n_sessions_undefined, e.n_tasks) == (2.0, 2, 1, 102)


def test_common_completion(spark):
    rows = pair("t1", "A", 1.0, 2.0) + [("t2", "A", "X", S.COMPLETED, 1.0), ("t2", "A", "Y", S.MISS, None), ("t3", "A", "X", S.UNEVALUABLE, None), ("t3", "A", "Y", S.COMPLETED, 1.0)]
    found = S.common_completion(results(spark, rows), "X", "Y").collect()
    assert sorted((r.task_id, r.policy_id) for r in found) == [("t1", "X"), ("t1", "Y")]
    miss = S.effect(S.session_means(S.validated(results(spark, rows), "X", "Y"), S.miss_diff())).first()
    assert miss.estimate == 0.5 and miss.n_tasks == 2


@pytest.mark.parametrize(
    "extra, message",
    [([("t1", "A", "Y", S.COMPLETED, 9.0)], "several rows"), ([("t9", "A", "X", S.COMPLETED, 1.0), ("t9", "B", "Y", S.COMPLETED, 1.0)], "differ in session"), ([("t9", "A", "X", S.COMPLETED, float("inf"))], "infinite")],
)
def test_bad_pairs_raise(spark, extra, message):
    with pytest.raises(Exception, match=message):
        S.effect(S.session_means(S.validated(results(spark, pair("t1", "A", 1.0, 2.0) + extra), "X", "Y"), S.cost_diff())).collect()
    with pytest.raises(ValueError, match="itself"):
        S.validated(results(spark, []), "X", "X")


def test_zero_event_bound(spark):
    row = S.zero_event_bound(results(spark, pair("t", "A", 1.0, 1.0)), "Y").first()
    assert row.candidate_all_zero_miss and row.zero_event_upper_bound == pytest.approx(0.95)
    assert S.zero_event_bound(results(spark, []), "Y").first().zero_event_upper_bound is None


def test_theta_menu(spark):
    rows = [(0.0, "A", 1, 0.0), (0.0, "A", 0, 2.0), (0.0, "B", 1, 1.0)] + [(t, s, 0, 2.0) for t in (0.1, 0.2) for s in "AB"]
    found = {r.theta: r for r in S.select_theta(spark.createDataFrame(rows, "theta double, session_id string, miss int, c_t double"), 0.01).collect()}
    assert (found[0.0].mean_miss_rate, found[0.0].mean_c_t) == (0.75, 1.0)
    assert [t for t, r in found.items() if r.chosen] == [0.1] and not found[0.0].within_allowance


def test_risk_choice(spark):
    nan, inf = float("nan"), float("inf")
    cases = [
        ((0.1, 0.2, 5.0, 1.0), 0.0, True, ("HOLD", "MODEL_CHOICE")), ((0.1, 0.2, 5.0, 1.0), 1.0, True, ("SWITCH", "MODEL_CHOICE")), ((0.2, 0.2, 1.0, 1.0), 0.0, True, ("SWITCH", "MODEL_CHOICE")),
        ((0.2, 0.2, 0.5, 1.0), 0.0, True, ("HOLD", "MODEL_CHOICE")), ((0.1, 0.2, 0.0, 1.0), 0.0, False, ("SWITCH", "FALLBACK_UNSUPPORTED")), ((nan, 0.2, 0.0, 1.0), 0.0, False, ("SWITCH", "FALLBACK_NONFINITE")),
        ((0.1, 0.2, inf, 1.0), 0.0, True, ("SWITCH", "FALLBACK_NONFINITE")),
    ]
    for v, eps, ok, want in cases:
        got = spark.range(1).select(S.risk_allowance_choice(*(F.lit(x) for x in v), F.lit(eps), F.lit(ok)).alias("c")).first().c
        assert (got.choice, got.reason) == want


def test_support_gate(spark):
    rows = [(1, "A", 30, 9), (1, "B", 25, 2), (5, "A", 22, 5), (5, "B", 21, 4), (30, "A", 50, 9)]
    found = {r.horizon_ns: r for r in S.support_gate(spark.createDataFrame(rows, "horizon_ns long, session_id string, eligible long, queue_depletion long"), ["A", "B"], 20, 3).collect()}
    assert {h: (r.passes, r.chosen) for h, r in found.items()} == {1: (False, False), 5: (True, True), 30: (False, False)}


def test_metrics_and_their_identity(spark):
    tick, m0, z0 = 250_000_000, 200_250_000_000, 200_750_000_000
    for side in (1, -1):
        fills = F.array(F.struct(F.lit(100_250_000_000).alias("price"), F.lit(1).alias("qty")))
        c = [F.lit(x) for x in (side, m0, z0)]
        r = spark.range(1).select(
            M.shortfall_gross(c[0], fills, c[1]).alias("g"), M.shortfall_net(c[0], fills, c[1], F.lit(0)).alias("n"), M.shortfall_gross(c[0], fills, c[2]).alias("z"), M.benchmark_offset(c[0], c[2], c[1]).alias("o"),
            M.deadline_value(c[0], F.array().cast("array<struct<price:bigint,qty:int>>"), F.lit(0), c[2], c[1]).alias("d"), M.markout(c[0], F.lit(100_000_000_000), c[1]).alias("m"),
        ).first()
        assert r.g == r.n == side * (2 * 100_250_000_000 - m0) / (2 * tick)
        assert r.g == pytest.approx(r.z + r.o) and r.d == side * (m0 - z0) / (2 * tick) and r.m == side * 0.5


def test_asof_keeps_null_states_and_ties(spark):
    samples = spark.createDataFrame([("s", 10, 0, 5), ("s", 20, 1, 6), ("s", 20, 2, 7), ("s", 30, 3, None)], "k string, t long, seq long, v long")
    probes = spark.createDataFrame([("s", x) for x in (9, 10, 20, 29, 30, 99)] + [("other", 99)], "k string, at long")
    state = {(r.k, r["at"]): r.v for r in asof(probes, samples, ["k"], "at", "t", "seq", ["v"]).collect()}
    valid = {(r.k, r["at"]): (r.v, r.sample_time) for r in asof(probes, samples, ["k"], "at", "t", "seq", ["v"], skip_null="v").collect()}
    assert [state["s", x] for x in (9, 10, 20, 29, 30, 99)] == [None, 5, 7, 7, None, None] and state["other", 99] is None
    assert valid["s", 99] == (7, 20) and valid["s", 9] == (None, None)


def test_valid_horizons_and_tick_alignment(spark):
    guard = guard_ns(*LATENCY["L6"][1:])
    assert valid_horizons([0, 2 * guard, 2 * guard + 1, 10 * guard], ["L1", "L6"]) == [2 * guard + 1, 10 * guard]
    rows = spark.createDataFrame([(0,), (250,), (-500,), (-1,), (251,), (None,)], "p long").select(tick_aligned(F.col("p"), 250)).collect()
    assert [r[0] for r in rows] == [True, True, True, False, False, None]


def test_worlds_know_their_policies():
    """A policy without a rule is refused, and so is a price rule without signals."""
    with pytest.raises(ValueError, match="no rule"):
        worlds(None, None, None, None, None, None, policies=("B0", "B9"))
    with pytest.raises(ValueError, match="signals"):
        worlds(None, None, None, None, None, None, policies=("B0", "B2:0.1"), thetas={"B2:0.1": 0.1})


def test_intervals_of_resampled_sessions(spark):
    import numpy as np

    values = {"x": [1.0, -2.0, 0.5, 4.0, None], "zero": [0.0, 0.0, 0.0], "one": [3.0]}
    rows = [(g, f"s{k}", v) for g, vs in values.items() for k, v in enumerate(vs)]
    got = {r.g: (r.lo, r.hi) for r in S.resampled_intervals(spark.createDataFrame(rows, "g string, session_id string, session_mean double"), ["g"], 300).collect()}
    own = np.array([1.0, -2.0, 0.5, 4.0])
    picks = np.array([[(r * 7919 + k * 104729 + r * k * 31) % 1000003 % 4 for k in range(4)] for r in range(300)])
    lo, hi = np.quantile(own[picks].mean(axis=1), [0.025, 0.975])
    assert np.allclose(got["x"], (lo, hi)) and lo < own.mean() < hi
    assert got["zero"] == (None, None) and got["one"] == (None, None)


def test_pair_records_by_scenario(spark):
    rows = pair("a", "A", 4.0, 1.0) + pair("b", "B", 2.0, 1.0) + pair("c", "B", None, None, S.MISS)
    r = S.pair_records(results(spark, rows), [("X", "Y")], ["scenario_id"], 200).first()
    assert (r.cost_estimate, r.cost_n_sessions_defined, r.cost_n_tasks, r.miss_estimate, r.miss_n_tasks) == (2.0, 2, 2, 0.0, 3)
    assert 1.0 <= r.cost_ci_lo < r.cost_ci_hi <= 3.0 and r.miss_ci_lo is None and not r.candidate_all_zero_miss
