"""Paired, session-weighted statistics of result tables, and decision rules.

Effects have one definition here: a mean over sessions of session means, so a session counts once
however many tasks it has. Undefined stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["task_id", "scenario_id"]
COMPLETED, MISS, UNEVALUABLE = "COMPLETED_ON_TIME", "DEADLINE_MISS", "TECHNICALLY_UNEVALUABLE"


def validated(results: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """One row for each pair key with both policies' values side by side, in one shuffle.

    Repeated policy rows of a key, or policies that differ in session, side or horizon, raise an
    error when the rows are read.
    """
    if baseline == candidate:
        raise ValueError("a policy is not compared with itself")
    rows = results.filter(F.col("policy_id").isin(baseline, candidate))
    of = lambda c, p: F.max(F.when(F.col("policy_id") == p, F.col(c)))
    meta = F.struct("session_id", "side", "horizon_ns")
    pairs = rows.groupBy(*PAIR).agg(
        F.max("session_id").alias("session_id"), (F.min(meta) != F.max(meta)).alias("mixed"),
        F.count_if(F.col("policy_id") == baseline).alias("n_base"), F.count_if(F.col("policy_id") == candidate).alias("n_cand"),
        of("status", baseline).alias("base_status"), of("status", candidate).alias("cand_status"),
        of("is_ticks_net", baseline).alias("base_metric"), of("is_ticks_net", candidate).alias("cand_metric"),
    )
    bad = F.when((F.col("n_base") > 1) | (F.col("n_cand") > 1), "a policy has several rows for one task and scenario").when(F.col("mixed"), "the two policies differ in session, side or horizon of a task")
    finite = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    bad = bad.when(finite(F.col("base_metric")) | finite(F.col("cand_metric")), "a cost is infinite or not a number")
    return pairs.withColumn("session_id", F.when(bad.isNull(), F.col("session_id")).otherwise(F.raise_error(bad)))


def common_completion(results: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """The rows of both policies for the keys that both complete on time."""
    both = results.filter(F.col("policy_id").isin(baseline, candidate) & (F.col("status") == COMPLETED))
    keys = both.groupBy(*PAIR).agg(F.count_distinct("policy_id").alias("n")).filter("n = 2").select(*PAIR)
    return both.join(keys, PAIR, "left_semi")


def session_means(pairs: DataFrame, diff: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, session_id, session_mean, n): of the sessions with a defined difference, and null for others."""
    return pairs.withColumn("d", diff).groupBy(*by, "session_id").agg(F.avg("d").alias("session_mean"), F.count("d").alias("n"))


def effect(means: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Estimate and counts of one paired effect from its session means."""
    agg = [F.round(F.avg("session_mean"), 9).alias("estimate"), F.count("session_mean").alias("n_sessions_defined"), F.count_if(F.col("session_mean").isNull()).alias("n_sessions_undefined"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tasks")]
    return means.groupBy(*by).agg(*agg) if by else means.agg(*agg)


def cost_diff() -> Column:
    """Baseline less candidate where both complete: positive favours the candidate."""
    both = (F.col("base_status") == COMPLETED) & (F.col("cand_status") == COMPLETED)
    return F.when(both, F.col("base_metric") - F.col("cand_metric"))


def miss_diff() -> Column:
    """Candidate's miss less the baseline's where both are evaluable: positive is worse."""
    evaluable = F.col("base_status").isNotNull() & F.col("cand_status").isNotNull() & (F.col("base_status") != UNEVALUABLE) & (F.col("cand_status") != UNEVALUABLE)
    return F.when(evaluable, (F.col("cand_status") == MISS).cast("double") - (F.col("base_status") == MISS).cast("double"))


def zero_event_bound(results: DataFrame, candidate: str) -> DataFrame:
    """One row: 1 - 0.05^(1/D) if no evaluable row of the candidate in D sessions misses, else null."""
    rows = results.filter((F.col("policy_id") == candidate) & (F.col("status") != UNEVALUABLE))
    d = rows.agg(F.count_distinct("session_id").alias("d"), F.count_if(F.col("status") == MISS).alias("m"), F.count("*").alias("n"))
    none = (F.col("n") > 0) & (F.col("m") == 0)
    return d.select(none.alias("candidate_all_zero_miss"), F.when(none, F.round(1 - F.pow(F.lit(0.05), 1 / F.col("d")), 9)).alias("zero_event_upper_bound"))


def stacked_means(results: DataFrame, pairs: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """(baseline, candidate, by, effect, session_id, session_mean, n) of the cost and the miss effect of every pair:
    each pair's rows meet once for both."""
    out = None
    for base, cand in pairs:
        rows = validated(results, base, cand).withColumns({"cost": cost_diff(), "miss": miss_diff()})
        part = rows.groupBy(*by, "session_id").agg(*(f(c).alias(f"{c}_{n}") for c in ("cost", "miss") for n, f in (("mean", F.avg), ("n", F.count))))
        part = part.select(F.lit(base).alias("baseline"), F.lit(cand).alias("candidate"), "*")
        out = part if out is None else out.unionByName(part)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("effect"), F.col(f"{c}_mean").alias("session_mean"), F.col(f"{c}_n").alias("n")) for c in ("cost", "miss"))))
    return out.withColumn("e", each).select("baseline", "candidate", *by, "session_id", "e.*")


def resampled(sizes: DataFrame, replicates: int) -> DataFrame:
    """(n_defined, replicate, pick, weight): for each number of sessions in ``sizes`` (n_defined) how often a replicate
    draws each session, with replacement. A draw is an arithmetic hash of (replicate, place), so any engine repeats
    it; one table serves all effects."""
    reps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")))
    places = sizes.select("n_defined").distinct().filter("n_defined > 0").withColumn("r", reps).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_defined") - 1)))
    pick = (F.col("r") * 7919 + F.col("k") * 104729 + F.col("r") * F.col("k") * 31) % 1000003 % F.col("n_defined")
    return places.groupBy("n_defined", F.col("r").alias("replicate"), pick.alias("pick")).agg(F.count("*").alias("weight"))


def resampled_intervals(means: DataFrame, by: list[str], replicates: int, alpha: float = 0.05) -> DataFrame:
    """(by, lo, hi): percentile intervals of the mean of session means, whole sessions drawn. Null for fewer than two
    defined sessions, or where all values are zero. Sessions are few beside tasks."""
    w = Window.partitionBy(*by)
    rows = means.filter("session_mean is not null").withColumns({"n_defined": F.count("*").over(w), "pick": (F.row_number().over(w.orderBy("session_id")) - 1).cast("long"), "most": F.max(F.abs("session_mean")).over(w)})
    drawn = rows.join(resampled(rows, replicates), ["n_defined", "pick"])
    stats = drawn.groupBy(*by, "n_defined", "most", "replicate").agg((F.sum(F.col("session_mean") * F.col("weight")) / F.col("n_defined")).alias("stat"))
    band = stats.groupBy(*by, "n_defined", "most").agg(F.expr(f"percentile(stat, {alpha / 2})").alias("lo"), F.expr(f"percentile(stat, {1 - alpha / 2})").alias("hi"))
    known = (F.col("n_defined") >= 2) & (F.col("most") > 0)
    return band.select(*by, *(F.when(known, F.round(c, 9)).alias(c) for c in ("lo", "hi")))


def zero_event_bounds(results: DataFrame, by: list[str]) -> DataFrame:
    """(candidate, by, candidate_all_zero_miss, zero_event_upper_bound) of every policy: 1 - 0.05^(1/D) if no evaluable
    row in D sessions misses, else null."""
    rows = results.filter(F.col("status") != UNEVALUABLE).groupBy(F.col("policy_id").alias("candidate"), *by)
    found = rows.agg(F.count_distinct("session_id").alias("d"), (F.count_if(F.col("status") == MISS) == 0).alias("none"))
    return found.select("candidate", *by, F.col("none").alias("candidate_all_zero_miss"), F.when(F.col("none"), F.round(1 - F.pow(F.lit(0.05), 1 / F.col("d")), 9)).alias("zero_event_upper_bound"))


def pair_records(results: DataFrame, pairs: list[tuple[str, str]], by: list[str], replicates: int) -> DataFrame:
    """A row for each pair and ``by``: estimate, interval and counts of the cost and the miss effect, and the
    zero-event bound of the candidate. A pair without a row of either policy in a group is left out of it."""
    means = stacked_means(results, pairs, by)
    keys = ["baseline", "candidate", *by]
    found = effect(means, [*keys, "effect"]).join(resampled_intervals(means, [*keys, "effect"], replicates), [*keys, "effect"], "left")
    fields = {"estimate": "estimate", "ci_lo": "lo", "ci_hi": "hi", "n_sessions_defined": "n_sessions_defined", "n_sessions_undefined": "n_sessions_undefined", "n_tasks": "n_tasks"}
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("effect") == e, F.col(c))).alias(f"{e}_{n}") for e in ("cost", "miss") for n, c in fields.items()))
    out = wide.join(zero_event_bounds(results, by), ["candidate", *by], "left")
    return out.withColumn("candidate_all_zero_miss", F.coalesce("candidate_all_zero_miss", F.lit(False)))


def policy_distribution(results: DataFrame) -> DataFrame:
    """Outcome counts, passive share, mean and median cost and miss rate of each policy."""
    done = F.col("status") == COMPLETED
    cost = F.when(done, F.col("is_ticks_net"))
    n, bad, miss = F.count("*"), F.count_if(F.col("status") == UNEVALUABLE), F.count_if(F.col("status") == MISS)
    return results.groupBy("policy_id").agg(
        n.alias("n_tasks"), F.count_if(done).alias("n_completed_on_time"), miss.alias("n_deadline_miss"), bad.alias("n_technically_unevaluable"),
        F.avg(F.when(done, F.col("passive_filled").cast("double"))).alias("passive_fill_fraction"), F.avg(cost).alias("mean_is_ticks_net"), F.median(cost).alias("median_is_ticks_net"),
        F.when(n > bad, miss / (n - bad)).alias("miss_rate"),
    )


def bootstrap_interval(means: DataFrame, draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(lo, hi) over ``draws`` (replicate, pick) of session numbers from 0; null for fewer than two
    defined sessions, or where all values are zero. Numbering sorts sessions only, which are few
    beside tasks."""
    defined = means.filter("session_mean is not null")
    numbered = defined.select("session_mean", (F.row_number().over(Window.orderBy("session_id")) - 1).alias("pick"))
    stats = draws.join(numbered, "pick").groupBy("replicate").agg(F.avg("session_mean").alias("stat"))
    band = stats.agg(F.expr(f"percentile(stat, {alpha / 2})").alias("lo"), F.expr(f"percentile(stat, {1 - alpha / 2})").alias("hi"))
    known = defined.agg(((F.count("*") >= 2) & (F.max(F.abs("session_mean")) > 0)).alias("known"))
    return band.crossJoin(F.broadcast(known)).select(F.when(F.col("known"), F.round("lo", 9)).alias("lo"), F.when(F.col("known"), F.round("hi", 9)).alias("hi"))


def risk_allowance_choice(p_hold: Column, p_switch: Column, v_hold: Column, v_switch: Column, epsilon: Column, supported: Column) -> Column:
    """(choice, reason): the cheaper action among those within ``epsilon`` of the least risk; ties,
    unsupported and nonfinite inputs switch."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    out = lambda c, r: F.struct(F.lit(c).alias("choice"), F.lit(r).alias("reason"))
    least = F.least(p_hold, p_switch)
    hold_ok, switch_ok = p_hold <= least + epsilon, p_switch <= least + epsilon
    hold = hold_ok & (~switch_ok | (v_hold < v_switch))
    return (
        F.when(bad(p_hold) | bad(p_switch) | bad(v_hold) | bad(v_switch), out("SWITCH", "FALLBACK_NONFINITE"))
        .when(~supported, out("SWITCH", "FALLBACK_UNSUPPORTED")).when(hold, out("HOLD", "MODEL_CHOICE")).otherwise(out("SWITCH", "MODEL_CHOICE"))
    )


def select_theta(validation: DataFrame, epsilon: float) -> DataFrame:
    """Each theta's session-weighted miss rate and cost, whether it is within ``epsilon`` of the least
    miss rate, and whether it is chosen: the cheapest such, the smaller on ties."""
    sessions = validation.groupBy("theta", "session_id").agg(F.avg("miss").alias("miss"), F.avg("c_t").alias("c_t"), F.count("*").alias("n"))
    trials = sessions.groupBy("theta").agg(F.round(F.avg("miss"), 9).alias("mean_miss_rate"), F.round(F.avg("c_t"), 9).alias("mean_c_t"), F.count("*").alias("n_sessions"), F.sum("n").alias("n_tasks"))
    every = Window.partitionBy(F.lit(0))  # over the few thetas of a menu
    within = trials.withColumn("within_allowance", F.col("mean_miss_rate") <= F.min("mean_miss_rate").over(every) + epsilon)
    rank = F.row_number().over(Window.partitionBy("within_allowance").orderBy("mean_c_t", "theta"))
    return within.withColumn("chosen", F.col("within_allowance") & (rank == 1))


def support_gate(support: DataFrame, pilots: list[str], min_eligible: int, min_depletion: int) -> DataFrame:
    """(horizon_ns, min_eligible, min_queue_depletion, passes, chosen) of each horizon over the pilot
    sessions; a missing session counts 0; the shortest passing horizon is chosen."""
    wanted = support.sparkSession.createDataFrame([(p,) for p in pilots], "session_id string")
    grid = support.select("horizon_ns").distinct().crossJoin(F.broadcast(wanted))
    per = support.groupBy("horizon_ns", "session_id").agg(F.sum("eligible").alias("e"), F.sum("queue_depletion").alias("d"))
    rows = grid.join(per, ["horizon_ns", "session_id"], "left").groupBy("horizon_ns").agg(F.min(F.coalesce("e", F.lit(0))).alias("min_eligible"), F.min(F.coalesce("d", F.lit(0))).alias("min_queue_depletion"))
    rows = rows.withColumn("passes", (F.col("min_eligible") >= min_eligible) & (F.col("min_queue_depletion") >= min_depletion))
    best = F.min(F.when(F.col("passes"), F.col("horizon_ns"))).over(Window.partitionBy(F.lit(0)))  # over the few horizons
    return rows.withColumn("chosen", F.coalesce(F.col("passes") & (F.col("horizon_ns") == best), F.lit(False)))
