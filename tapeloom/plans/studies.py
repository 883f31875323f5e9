"""Queries over result tables derived from ``lineitem`` and ``orders``: paired effects and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import study as S
from tapeloom.sources.schemas import EPSILONS, THETAS
from tapeloom.sources.tape import RESULTS_SQL, load, task_results

#: Policies of the derived results are A, N and R.
PRIMARY = ("A", "R")
SECONDARY = [("A", "N"), ("N", "R"), ("R", "A")]
PILOTS, MIN_ELIGIBLE, MIN_DEPLETION = [f"1995-{m:02d}" for m in range(1, 7)], 20, 3
#: Replicates of every interval.
BOOT = 2000


def _l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_results(spark, sf_dir).filter("scenario_id = 'L1'")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def paired_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the paired cost effect of each scenario."""
    pairs = S.validated(task_results(spark, sf_dir), *PRIMARY)
    return S.effect(S.session_means(pairs, S.cost_diff(), ["scenario_id"]), ["scenario_id"])


def paired_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.validated(task_results(spark, sf_dir), *PRIMARY)
    return S.effect(S.session_means(pairs, S.miss_diff(), ["scenario_id"]), ["scenario_id"])


def session_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = S.session_means(S.validated(_l1(spark, sf_dir), *PRIMARY), S.cost_diff())
    return means.select("session_id", F.round("session_mean", 9).alias("session_mean"), "n")


def primary_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pair_records(_l1(spark, sf_dir), [PRIMARY], [], BOOT)


def secondary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pair_records(_l1(spark, sf_dir), SECONDARY, [], BOOT)


def latency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pair_records(task_results(spark, sf_dir), [PRIMARY], ["scenario_id"], BOOT)


def policy_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.policy_distribution(_l1(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("passive_fill_fraction", "mean_is_ticks_net", "median_is_ticks_net", "miss_rate")})


def support_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible checkpoints and queue depletions of each session and horizon, of one policy."""
    rows = _l1(spark, sf_dir).filter("policy_id = 'N' or policy_id = 'A'")
    horizon = F.explode(F.array(*(F.lit(h * 1_000_000_000).cast("long") for h in (1, 5, 30))))
    hits = rows.withColumn("horizon_ns", horizon).withColumn("late", F.col("horizon_ns") > 5_000_000_000)
    return hits.groupBy("horizon_ns", "session_id").agg(
        F.count_if(F.col("checkpoint_eligible") & (F.col("horizon_ns") > 1_000_000_000)).alias("eligible"),
        F.count_if(F.col("passive_filled") & (F.col("late") | (F.col("decision_reason") == "MODEL_CHOICE"))).alias("queue_depletion"),
    )


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision log: risks, costs and support of holding and switching."""
    rows = load(spark, sf_dir, "lineitem")
    nan = F.when(F.col("l_linenumber") == 7, F.lit(float("nan")))
    return rows.select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("long").alias("time_ns"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("variant"),
        F.coalesce(nan, F.round(F.col("l_discount") * 100) / 100).alias("p_hold"), (F.round(F.col("l_tax") * 100) / 100).alias("p_switch"),
        F.col("l_quantity").alias("v_hold"), (F.col("l_suppkey") % 50 + 1).cast("double").alias("v_switch"), (F.col("l_linenumber") <= 5).alias("supported"),
    )


def _choice(eps) -> object:
    c = [F.col(k) for k in ("p_hold", "p_switch", "v_hold", "v_switch")]
    return S.risk_allowance_choice(*c, eps, F.col("supported"))


def risk_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _decisions(spark, sf_dir).withColumn("c", _choice(F.lit(0.01)))
    return chosen.groupBy("supported", "c.choice", "c.reason").agg(F.count("*").alias("n"), F.sum("v_hold").alias("v_hold"), F.sum("v_switch").alias("v_switch"))


def epsilon_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decisions(spark, sf_dir).withColumn("primary", _choice(F.lit(0.01))["choice"]).withColumn("epsilon", F.explode(F.array(*(F.lit(e) for e in EPSILONS))))
    rows = rows.withColumn("choice", _choice(F.col("epsilon"))["choice"])
    share = lambda held: F.round(F.avg(held.cast("double")), 9)
    return rows.groupBy("epsilon").agg(F.count("*").alias("n_decisions"), share(F.col("choice") == "HOLD").alias("share_hold"), share(F.col("choice") == "SWITCH").alias("share_switch"), share(F.col("choice") == F.col("primary")).alias("agreement_with_primary"))


def guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each variant: reasons, support rate, model share and whether the model decides too little."""
    rows = _decisions(spark, sf_dir).withColumn("c", _choice(F.lit(0.01)))
    of = lambda r: F.count_if(F.col("c.reason") == r)
    out = rows.groupBy("variant").agg(F.count("*").alias("n_eligible"), of("MODEL_CHOICE").alias("n_model"), of("FALLBACK_UNSUPPORTED").alias("n_unsupported"), of("FALLBACK_NONFINITE").alias("n_nonfinite"), F.round(F.avg(F.col("supported").cast("double")), 9).alias("support_rate"))
    return out.withColumn("model_fraction", F.round(F.col("n_model") / F.col("n_eligible"), 9)).withColumn("degenerate", F.col("n_model") / F.col("n_eligible") < 0.5)


def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared keys of two variants' logs, the last row of a key counting, and how often they differ."""
    rows = _decisions(spark, sf_dir).withColumn("choice", _choice(F.lit(0.01))["choice"])
    last = rows.groupBy("variant", "task_id", "time_ns").agg(F.max_by("choice", F.struct("part", "v_hold", "v_switch")).alias("choice"))
    a, b = (last.filter(F.col("variant") == v).select("task_id", "time_ns", F.col("choice").alias(v)) for v in PRIMARY)
    return a.join(b, ["task_id", "time_ns"]).agg(F.count("*").alias("n_shared"), F.count_if(F.col("A") != F.col("R")).alias("n_differ"))


def select_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _l1(spark, sf_dir).filter("status <> 'TECHNICALLY_UNEVALUABLE'").withColumn("theta", F.explode(F.array(*(F.lit(t) for t in THETAS))))
    shift = F.round(F.col("theta") * 10).cast("long")
    c_t = (F.coalesce("is_ticks_net", F.lit(12.0)) + (F.col("task_id").cast("long") % 7 - shift) * shift).cast("double")
    return S.select_theta(rows.select("theta", "session_id", F.when(F.col("status") == S.MISS, 1.0).otherwise(0.0).alias("miss"), c_t.alias("c_t")), 0.01)


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sessions drawn by an arithmetic hash of (replicate, draw), that SQL can repeat."""
    means = S.session_means(S.validated(_l1(spark, sf_dir), *PRIMARY), S.cost_diff())
    n = means.filter("session_mean is not null").agg(F.count("*").alias("n"))
    # BOOT replicates of one draw per session: small beside the tasks.
    draws = spark.range(BOOT).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(n)).filter("n > 0").select("replicate", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("draw"))
    pick = (F.col("replicate") * 7919 + F.col("draw") * 104729 + F.col("replicate") * F.col("draw") * 31) % 1000003 % F.col("n")
    return S.bootstrap_interval(means, draws.select("replicate", pick.cast("int").alias("pick")))


def support_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each feature over returned lines, widened by a tenth of their spread."""
    return _bounds(load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'"))


FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _long(rows: DataFrame) -> DataFrame:
    return rows.unpivot(["l_orderkey"], list(FEATURES), "feature", "value")


def _bounds(rows: DataFrame) -> DataFrame:
    lo, hi = F.min("value"), F.max("value")
    return _long(rows).groupBy("feature").agg(F.count("*").alias("n_rows"), F.round(lo - 0.1 * (hi - lo), 6).alias("low"), F.round(hi + 0.1 * (hi - lo), 6).alias("high"))


def unsupported_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of many units each feature's narrow bounds leave out; features with none are left out."""
    rows = load(spark, sf_dir, "lineitem")
    small = _bounds(rows.filter("l_quantity <= 30 and l_discount <= 0.05"))
    out = _long(rows.filter("l_returnflag = 'N'")).join(F.broadcast(small), "feature")  # four rows
    return out.groupBy("feature").agg(F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("n_out")).filter("n_out > 0")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score, clipped log loss and base rates of a risk against misses, of each policy; the base rate
    is the training half's."""
    rows = task_results(spark, sf_dir).filter("scenario_id = 'L1' and status <> 'TECHNICALLY_UNEVALUABLE'")
    y = F.when(F.col("status") == S.MISS, 1.0).otherwise(0.0)
    rows = rows.select("policy_id", "task_id", y.alias("y"), ((F.col("task_id").cast("long") * 37 % 100) / 100.0).alias("p"), (F.col("session_id") < "1996-01").alias("train"))
    clipped = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p")))
    loss = -(F.col("y") * F.ln(clipped) + (1 - F.col("y")) * F.ln(1 - clipped))
    test = F.col("train") == False  # noqa: E712
    at = lambda c: F.avg(F.when(test, c))
    return rows.groupBy("policy_id").agg(
        F.count_if(test).alias("n"), F.round(at(F.pow(F.col("p") - F.col("y"), 2)), 8).alias("brier"), F.round(at(loss), 8).alias("log_loss"),
        F.round(F.sqrt(at(F.pow(F.col("p") - F.col("y"), 2))), 8).alias("rmse"), F.round(F.avg(F.when(F.col("train"), F.col("y"))), 9).alias("base_rate"),
    )


def anti_evaluable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches of any task with a flagged row go; a null flag is no flag."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") > 400_000).alias("flagged"))
    bad = rows.filter(F.coalesce("flagged", F.lit(False))).select("o_custkey").distinct()
    return rows.join(bad, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def union_evolving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with different columns, united by name; missing ones are null, types the wider."""
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    b = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("value"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


def oof_signal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's orders with the mean price of all months before: a signal out of its own fold."""
    from pyspark.sql import Window

    orders = load(spark, sf_dir, "orders").withColumn("session_id", F.date_format("o_orderdate", "yyyy-MM"))
    sums = orders.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    before = Window.partitionBy(F.lit(0)).orderBy("session_id").rowsBetween(Window.unboundedPreceding, -1)  # over sessions, which are few
    signal = sums.select("session_id", (F.sum("cents").over(before) / F.sum("n").over(before)).alias("signal"))
    joined = orders.join(signal.filter("signal is not null"), "session_id")
    return joined.groupBy("session_id").agg(F.count("*").alias("n"), F.round(F.first("signal"), 6).alias("signal"), F.count_if(F.col("o_totalprice") * 100 > F.col("signal")).alias("n_above"))


def left_signal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the count of their urgent orders; those without stay, with null."""
    urgent = load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_urgent"))
    return load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(urgent, "c_custkey", "left")


def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in order, the first 60 % for development, the next 20 % for validation; counts round half
    to even."""
    from pyspark.sql import Window

    sessions = load(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("session_id")).agg(F.count("*").alias("n_tasks"))
    every = Window.partitionBy(F.lit(0))  # over sessions, which are few
    rows = sessions.withColumn("i", F.row_number().over(every.orderBy("session_id"))).withColumn("n", F.count("*").over(every))
    dev, val = F.bround(F.col("n") * 0.6, 0), F.bround(F.col("n") * 0.2, 0)
    return rows.select("session_id", "n_tasks", F.when(F.col("i") <= dev, "development").when(F.col("i") <= dev + val, "validation").otherwise("test").alias("split"))


QUERIES = {
    "common_completion": lambda s, d: S.common_completion(task_results(s, d), *PRIMARY).select("task_id", "session_id", "policy_id", "scenario_id", "is_ticks_net"),
    "paired_effect": paired_effect,
    "paired_miss": paired_miss,
    "session_effects": session_effects,
    "primary_pair": primary_pair,
    "secondary_pairs": secondary_pairs,
    "latency_table": latency_table,
    "policy_distribution": policy_distribution,
    "support_counts": support_counts,
    "support_gate": lambda s, d: S.support_gate(support_counts(s, d), PILOTS, MIN_ELIGIBLE, MIN_DEPLETION),
    "select_theta": select_theta,
    "risk_choice": risk_choice,
    "epsilon_sensitivity": epsilon_sensitivity,
    "guardrails": guardrails,
    "disagreement": disagreement,
    "bootstrap_ci": bootstrap_ci,
    "support_bounds": support_bounds,
    "unsupported_features": unsupported_features,
    "calibration": calibration,
    "anti_evaluable": anti_evaluable,
    "union_evolving": union_evolving,
    "oof_signal_join": oof_signal_join,
    "left_signal_join": left_signal_join,
    "chronological_split": chronological_split,
}

_R = f"with {RESULTS_SQL}"
_PAIRS = """pairs as (
  select task_id, scenario_id, any_value(b.session_id) as session_id, max(b.status) filter (policy_id = '{0}') as base_status, max(b.status) filter (policy_id = '{1}') as cand_status,
    max(is_ticks_net) filter (policy_id = '{0}') as base_metric, max(is_ticks_net) filter (policy_id = '{1}') as cand_metric
  from results b where policy_id in ('{0}', '{1}') group by 1, 2)"""
_COST = "case when base_status = 'COMPLETED_ON_TIME' and cand_status = 'COMPLETED_ON_TIME' then base_metric - cand_metric end"
_MISS = "case when base_status <> 'TECHNICALLY_UNEVALUABLE' and cand_status <> 'TECHNICALLY_UNEVALUABLE' then (cand_status = 'DEADLINE_MISS')::int - (base_status = 'DEADLINE_MISS')::int end::double"
_EFFECT = "round(avg(m), 9) as {0}estimate, count(m)::bigint as {0}n_sessions_defined, count(*) filter (m is null)::bigint as {0}n_sessions_undefined, coalesce(sum(n), 0)::bigint as {0}n_tasks"


def _effects(diff: str) -> str:
    return f"{_R}, {_PAIRS.format(*PRIMARY)}, means as (select scenario_id, session_id, avg({diff}) as m, count({diff}) as n from pairs group by 1, 2) select scenario_id, {_EFFECT.format('')} from means group by 1"


def _interval(means: str, name: str) -> str:
    """The interval of session means (session_id, m) by every draw, one row."""
    known = "(select count(*) >= 2 and max(abs(m)) > 0 from d)"
    return f"""(with d as (select m, row_number() over (order by session_id) - 1 as i, count(*) over () as n from {means} where m is not null),
      draws as (select r, (r * 7919 + k * 104729 + r * k * 31) % 1000003 % n as pick from range(0, {BOOT}) a(r), (select n, unnest(range(0, n)) as k from (select distinct n from d))),
      s as (select r, avg(m) as stat from draws join d on d.i = draws.pick group by 1)
      select case when {known} then round(quantile_cont(stat, 0.025), 9) end as {name}_ci_lo, case when {known} then round(quantile_cont(stat, 0.975), 9) end as {name}_ci_hi from s)"""


def _record(base: str, cand: str, scenario: str = "L1", more: str = "") -> str:
    means = lambda d: f"(select session_id, avg({d}) as m, count({d}) as n from pairs where scenario_id = '{scenario}' group by 1)"
    return f"""(with {_PAIRS.format(base, cand)}, z as (select count(distinct session_id) as d, count(*) filter (status = 'DEADLINE_MISS') as k, count(*) as n from results where policy_id = '{cand}' and scenario_id = '{scenario}' and status <> 'TECHNICALLY_UNEVALUABLE')
      select '{base}' as baseline, '{cand}' as candidate, c.*, x.*, ci.*, xi.*, n > 0 and k = 0 as candidate_all_zero_miss, case when n > 0 and k = 0 then round(1 - pow(0.05, 1.0 / d), 9) end as zero_event_upper_bound{more}
      from (select {_EFFECT.format('cost_')} from {means(_COST)}) c, (select {_EFFECT.format('miss_')} from {means(_MISS)}) x, z, {_interval(means(_COST), 'cost')} ci, {_interval(means(_MISS), 'miss')} xi)"""


_DEC = """log as (select l_orderkey as task_id, l_linenumber::bigint as time_ns, l_partkey as part, l_returnflag as variant, case when l_linenumber = 7 then 'nan'::double else round(l_discount * 100) / 100 end as p_hold,
    round(l_tax * 100) / 100 as p_switch, l_quantity as v_hold, (l_suppkey % 50 + 1)::double as v_switch, l_linenumber <= 5 as supported from lineitem)"""
_CASE = """case when isnan(p_hold) then 'SWITCH' when not supported then 'SWITCH' when p_hold <= least(p_hold, p_switch) + {0} and (p_switch > least(p_hold, p_switch) + {0} or v_hold < v_switch) then 'HOLD' else 'SWITCH' end"""
_REASON = "case when isnan(p_hold) then 'FALLBACK_NONFINITE' when not supported then 'FALLBACK_UNSUPPORTED' else 'MODEL_CHOICE' end"
_SUPPORT = """support as (
  select h * 1000000000 as horizon_ns, session_id, count(*) filter (checkpoint_eligible and h > 1)::bigint as eligible, count(*) filter (passive_filled and (h > 5 or decision_reason = 'MODEL_CHOICE'))::bigint as queue_depletion
  from results, (values (1::bigint), (5::bigint), (30::bigint)) x(h) where scenario_id = 'L1' and policy_id in ('N', 'A') group by 1, 2)"""
_LONG = "(select feature, value from (select l_quantity, l_extendedprice, l_discount, l_tax from lineitem where {0}) unpivot (value for feature in (l_quantity, l_extendedprice, l_discount, l_tax)))"
_BOUND = "select feature, count(*)::bigint as n_rows, round(min(value) - 0.1 * (max(value) - min(value)), 6) as low, round(max(value) + 0.1 * (max(value) - min(value)), 6) as high from {0} group by 1"

ORACLE_SQL = {
    "common_completion": f"""{_R} select task_id, session_id, policy_id, scenario_id, is_ticks_net from results r where policy_id in ('A', 'R') and status = 'COMPLETED_ON_TIME'
      and exists (select 1 from results o where o.task_id = r.task_id and o.scenario_id = r.scenario_id and o.status = 'COMPLETED_ON_TIME' and o.policy_id = case r.policy_id when 'A' then 'R' else 'A' end)""",
    "paired_effect": _effects(_COST),
    "paired_miss": _effects(_MISS),
    "session_effects": f"{_R}, {_PAIRS.format(*PRIMARY)} select session_id, round(avg({_COST}), 9) as session_mean, count({_COST})::bigint as n from pairs where scenario_id = 'L1' group by 1",
    "primary_pair": f"{_R} select * from {_record(*PRIMARY)}",
    "secondary_pairs": f"{_R} " + " union all ".join(f"select * from {_record(*p)}" for p in SECONDARY),
    "latency_table": f"{_R} " + " union all ".join(f"select * from {_record(*PRIMARY, s, f''', '{s}' as scenario_id''')}" for s in ("L1", "L6")),
    "policy_distribution": f"""{_R} select policy_id, count(*)::bigint as n_tasks, count(*) filter (status = 'COMPLETED_ON_TIME')::bigint as n_completed_on_time, count(*) filter (status = 'DEADLINE_MISS')::bigint as n_deadline_miss,
      count(*) filter (status = 'TECHNICALLY_UNEVALUABLE')::bigint as n_technically_unevaluable, round(avg(passive_filled::int) filter (status = 'COMPLETED_ON_TIME'), 9) as passive_fill_fraction,
      round(avg(is_ticks_net), 9) as mean_is_ticks_net, round(median(is_ticks_net), 9) as median_is_ticks_net,
      round(case when count(*) filter (status <> 'TECHNICALLY_UNEVALUABLE') > 0 then count(*) filter (status = 'DEADLINE_MISS') / count(*) filter (status <> 'TECHNICALLY_UNEVALUABLE') end, 9) as miss_rate
      from results where scenario_id = 'L1' group by 1""",
    "support_counts": f"{_R}, {_SUPPORT} select * from support",
    "support_gate": f"""{_R}, {_SUPPORT}, pilots(session_id) as (values {', '.join(f"('{p}')" for p in PILOTS)}),
      g as (select h.horizon_ns, min(coalesce(s.eligible, 0))::bigint as min_eligible, min(coalesce(s.queue_depletion, 0))::bigint as min_queue_depletion
        from (select distinct horizon_ns from support) h cross join pilots p left join support s on s.horizon_ns = h.horizon_ns and s.session_id = p.session_id group by 1),
      t as (select *, min_eligible >= {MIN_ELIGIBLE} and min_queue_depletion >= {MIN_DEPLETION} as passes from g)
      select *, passes and horizon_ns = (select min(horizon_ns) from t where passes) as chosen from t""",
    "select_theta": f"""{_R}, v as (select theta, session_id, (status = 'DEADLINE_MISS')::int::double as miss, (coalesce(is_ticks_net, 12.0) + (task_id::bigint % 7 - round(theta * 10)::bigint) * round(theta * 10)::bigint)::double as c_t
        from results, (values (0.0), (0.1), (0.2)) x(theta) where scenario_id = 'L1' and status <> 'TECHNICALLY_UNEVALUABLE'),
      t as (select theta::double as theta, round(avg(m), 9) as mean_miss_rate, round(avg(c), 9) as mean_c_t, count(*)::bigint as n_sessions, sum(n)::bigint as n_tasks from (select theta, session_id, avg(miss) as m, avg(c_t) as c, count(*) as n from v group by 1, 2) group by 1),
      w as (select *, mean_miss_rate <= (select min(mean_miss_rate) from t) + 0.01 as within_allowance from t)
      select *, within_allowance and theta = (select theta from w where within_allowance order by mean_c_t, theta limit 1) as chosen from w""",
    "risk_choice": f"with {_DEC} select supported, {_CASE.format(0.01)} as choice, {_REASON} as reason, count(*)::bigint as n, sum(v_hold) as v_hold, sum(v_switch) as v_switch from log group by 1, 2, 3",
    "epsilon_sensitivity": f"""with {_DEC}, c as (select e as epsilon, {_CASE.format('e')} as choice, {_CASE.format(0.01)} as prim from log, (values (0.0::double), (1e-4::double), (1e-3::double), (1e-2::double), (1.0::double)) x(e))
      select epsilon, count(*)::bigint as n_decisions, round(avg((choice = 'HOLD')::int), 9) as share_hold, round(avg((choice = 'SWITCH')::int), 9) as share_switch, round(avg((choice = prim)::int), 9) as agreement_with_primary from c group by 1""",
    "guardrails": f"""with {_DEC}, r as (select *, {_REASON} as reason from log) select variant, count(*)::bigint as n_eligible, count(*) filter (reason = 'MODEL_CHOICE')::bigint as n_model, count(*) filter (reason = 'FALLBACK_UNSUPPORTED')::bigint as n_unsupported,
      count(*) filter (reason = 'FALLBACK_NONFINITE')::bigint as n_nonfinite, round(avg(supported::int), 9) as support_rate, round(count(*) filter (reason = 'MODEL_CHOICE') / count(*), 9) as model_fraction, count(*) filter (reason = 'MODEL_CHOICE') / count(*) < 0.5 as degenerate from r group by 1""",
    "disagreement": f"""with {_DEC}, l as (select variant, task_id, time_ns, {_CASE.format(0.01)} as choice from log qualify row_number() over (partition by variant, task_id, time_ns order by part desc, v_hold desc, v_switch desc) = 1)
      select count(*)::bigint as n_shared, count(*) filter (a.choice <> b.choice)::bigint as n_differ from l a join l b using (task_id, time_ns) where a.variant = 'A' and b.variant = 'R'""",
    "bootstrap_ci": f"""{_R}, {_PAIRS.format(*PRIMARY)}, means as (select session_id, avg({_COST}) as m from pairs where scenario_id = 'L1' group by 1),
      d as (select m, row_number() over (order by session_id) - 1 as i, count(*) over () as n from means where m is not null),
      draws as (select r, (r * 7919 + k * 104729 + r * k * 31) % 1000003 % n as pick from range(0, {BOOT}) a(r), (select n, unnest(range(0, n)) as k from (select distinct n from d))),
      s as (select r, avg(m) as stat from draws join d on d.i = draws.pick group by 1)
      select case when c >= 2 and z > 0 then round(quantile_cont(stat, 0.025), 9) end as lo, case when c >= 2 and z > 0 then round(quantile_cont(stat, 0.975), 9) end as hi from s, (select count(*) as c, max(abs(m)) as z from d) group by c, z""",
    "support_bounds": _BOUND.format(_LONG.format("l_returnflag = 'R'")),
    "unsupported_features": f"""with b as ({_BOUND.format(_LONG.format('l_quantity <= 30 and l_discount <= 0.05'))})
      select feature, count(*) filter (value < low or value > high)::bigint as n_out from {_LONG.format("l_returnflag = 'N'")} join b using (feature) group by 1 having count(*) filter (value < low or value > high) > 0""",
    "calibration": f"""{_R}, c as (select policy_id, (status = 'DEADLINE_MISS')::int::double as y, (task_id::bigint * 37 % 100) / 100.0::double as p, session_id < '1996-01' as train from results where scenario_id = 'L1' and status <> 'TECHNICALLY_UNEVALUABLE'),
      l as (select *, greatest(1e-12::double, least(1 - 1e-12::double, p)) as q from c)
      select policy_id, count(*) filter (not train)::bigint as n, round(avg((p - y) * (p - y)) filter (not train), 8) as brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))) filter (not train), 8) as log_loss,
        round(sqrt(avg((p - y) * (p - y)) filter (not train)), 8) as rmse, round(avg(y) filter (train), 9) as base_rate from l group by 1""",
    "anti_evaluable": """with r as (select o_orderkey, o_custkey, coalesce(o_orderkey % 3 > 0 and o_totalprice > 400000, false) as flagged from orders)
      select o_custkey, count(*)::bigint as n, min(o_orderkey) as first from r where o_custkey not in (select o_custkey from r where flagged) group by 1""",
    "union_evolving": "select c_custkey as id, c_acctbal as value, null::varchar as name from customer union all select s_suppkey, s_nationkey::double, s_name from supplier",
    "oof_signal_join": """with o as (select *, strftime(o_orderdate, '%Y-%m') as session_id from orders), s as (select session_id, count(*) as n, sum(round(o_totalprice * 100)::bigint) as cents from o group by 1),
      g as (select session_id, sum(cents) over w::double / sum(n) over w::double as signal from s window w as (order by session_id rows between unbounded preceding and 1 preceding))
      select session_id, count(*)::bigint as n, round(any_value(signal), 6) as signal, count(*) filter (o_totalprice * 100 > signal)::bigint as n_above from o join g using (session_id) where signal is not null group by 1""",
    "left_signal_join": "select c_custkey, c_mktsegment, n_urgent from customer left join (select o_custkey, count(*)::bigint as n_urgent from orders where o_orderpriority = '1-URGENT' group by 1) on c_custkey = o_custkey",
    "chronological_split": """with s as (select strftime(o_orderdate, '%Y-%m') as session_id, count(*)::bigint as n_tasks from orders group by 1), r as (select *, row_number() over (order by session_id) as i, count(*) over () as n from s)
      select session_id, n_tasks, case when i <= round_even(n * 0.6, 0) then 'development' when i <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) then 'validation' else 'test' end as split from r""",
}
