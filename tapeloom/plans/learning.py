"""Model queries over the tape. Solvers are no SQL, so they are tested by their optimum instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import features as F_
from tapeloom.operators import models as M
from tapeloom.operators.asof import asof
from tapeloom.operators.study import risk_allowance_choice, select_theta
from tapeloom.plans.market import HOUR, RULES, Market, _flows, _outcomes
from tapeloom.plans.orders import branch_labels, estimates, queue_orders
from tapeloom.sources.schemas import TICK
from tapeloom.sources.tables import written

FEATURES = ["imbalance_1", "imbalance_3", "spread_ticks", "depth_bid_3", "depth_ask_3"]


#: How far ahead a price model looks, and a shorter lead for its variant.
TAU, SHORT_TAU = HOUR // 2, HOUR // 6


def price_samples(m: Market, tau_ns: int) -> DataFrame:
    """Features of each valid quote as it reaches the client (t), and the direction of the market's mid from the batch's
    time to ``tau_ns`` later: null past the session's last sample, or where the later state is invalid."""
    q = m.keep(m.live_quotes.filter("mid2 is not null"))
    probes = q.withColumn("at_ns", F.col("proxy_time_ns") + tau_ns)
    later = asof(probes.select("session_id", "batch_id", "at_ns"), m.mids.withColumnRenamed("mid2", "later2"), ["session_id"], "at_ns", "t", "seq", ["later2"]).drop("sample_time", "at_ns")
    last = m.mids.groupBy("session_id").agg(F.max("t").alias("last_t"))
    rows = probes.join(later, ["session_id", "batch_id"]).join(last, "session_id")
    move = F.signum((F.col("later2") - F.col("mid2")).cast("double")).cast("int")
    spread, depths = ((F.col("ask_price") - F.col("bid_price")) / TICK).alias("spread_ticks"), [F.col(c).cast("double").alias(c) for c in ("depth_bid_3", "depth_ask_3")]
    return rows.select("session_id", "batch_id", F.col("obs_ns").alias("t"), "imbalance_1", "imbalance_3", spread, *depths, F.when(F.col("at_ns") <= F.col("last_t"), move).alias("label"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_samples(Market(spark, sf_dir), TAU).drop("t")


def _split(rows: DataFrame) -> tuple[list[str], list[str], list[str]]:
    names = [r.session_id for r in rows.select("session_id").distinct().orderBy("session_id").collect()]  # sessions, not rows
    dev, val = round(len(names) * 0.6), round(len(names) * 0.2)
    return names[:dev], names[dev : dev + val], names[dev + val :]


def price_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out sessions scored by the model that validation chose."""
    rows = written(_samples(spark, sf_dir))  # read by the split, the fits and the scores
    dev, val, test = _split(rows)
    of = lambda s: rows.filter(F.col("session_id").isin(s))
    model = M.select_price(of(dev), of(val), FEATURES, "label", keep=written)
    down, same, up = model.probabilities()
    return of(test).select("session_id", "batch_id", "label", down.alias("p_down"), same.alias("p_unch"), up.alias("p_up"), model.signal().alias("u"))


def oof_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each development session but the first, scored by a model of all those before."""
    rows = written(_samples(spark, sf_dir))  # read by a fit for each session
    dev, _, _ = _split(rows)
    return M.forward_chained(rows, dev, FEATURES, "label", keep=written).select("session_id", "batch_id", "label", "signal")


def theta_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each price rule's validation trials and the theta that they choose, of models with either lead: fitted on the
    development sessions, they give the signals that reach the client in the validation sessions, and the
    rules' worlds there are compared. An evaluable task without a finite cost is an error."""
    m = Market(spark, sf_dir)
    out = None
    for variant, tau in (("B2", TAU), ("B2_SHORT", SHORT_TAU)):
        rows = m.keep(price_samples(m, tau))
        dev, val, _ = _split(rows)
        of = lambda s: rows.filter(F.col("session_id").isin(s))  # noqa: B023, E731
        model = M.select_price(of(dev), of(val), FEATURES, "label", keep=m.keep)
        signals = of(val).select("session_id", "t", F.col("batch_id").alias("seq"), model.signal().alias("signal"))
        # A task without a reference mid is none to judge.
        at = asof(m.grid.filter(F.col("session_id").isin(val)), m.mids, ["session_id"], "arrival_ns", "t", "seq", ["mid2"], skip_null="mid2")
        grid = m.keep(at.filter("mid2 is not null").drop("mid2", "sample_time"))
        found = _outcomes(m, grid, scenarios=("L1",), policies=tuple(RULES), thetas=RULES, signals=m.keep(signals)).filter("status <> 'TECHNICALLY_UNEVALUABLE'")
        theta = F.substring_index("policy_id", ":", -1).cast("double")
        cost = F.when(F.col("deadline_cost_ticks").isNull() | F.isnan("deadline_cost_ticks"), F.raise_error(F.lit("an evaluable task has no finite cost"))).otherwise(F.col("deadline_cost_ticks"))
        trials = found.select(theta.alias("theta"), F.substring_index("task_id", ":", 1).alias("session_id"), (F.col("status") == "DEADLINE_MISS").cast("double").alias("miss"), cost.alias("c_t"))
        part = select_theta(m.keep(trials), EPSILON).select(F.lit(variant).alias("variant"), "*")
        out = part if out is None else out.unionByName(part)
    return out


EPSILON = 0.01
#: The arms of the action policy and what each may know of a checkpoint; price signals are left out.
ARMS = {"B3": F_.MARKET + F_.MECHANICS + F_.QUEUE, "B3_NO_QUEUE": F_.MARKET + F_.MECHANICS}
LEAST_ROWS, MARGIN = 20, 0.1


class Actions:
    """The action policy's training frame and models: labels of both branches of the development sessions' eligible
    checkpoints, with the features of the checkpoint."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.m = m = Market(spark, sf_dir)
        orders = m.keep(queue_orders(m))
        market = F_.market_features(m.live_quotes, _flows(m), HOUR, 5 * HOUR)
        self.features = m.keep(F_.checkpoint_features(orders, market, estimates(m, orders)))
        self.rows = m.keep(branch_labels(m).join(self.features.drop("session_id"), ["task_id", "scenario_id"]))
        self.train, self.validation, self.test = _split(self.features)

    def learning(self, arm: str) -> DataFrame:
        """Rows whose features are all known; the others are left to the fallback."""
        names = ARMS[arm]
        F_.check_allowed(names, arm)
        return self.rows.filter(F.col("session_id").isin(self.train)).dropna(subset=names)

    def decided(self) -> DataFrame:
        """(task_id, scenario_id, session_id, policy_id, p_hold, p_switch, v_hold, v_switch, supported, choice, reason)
        at every checkpoint of the later sessions."""
        later = self.features.filter(~F.col("session_id").isin(self.train))
        parts = []
        for arm, names in ARMS.items():
            own = self.learning(arm)
            hold, switch = (M.fit_action_by_moments(own.filter(F.col("action") == a), names, "miss", "cost") for a in ("HOLD", "SWITCH"))
            ok = M.support_rule(own, names, LEAST_ROWS, MARGIN)
            scored = later.select("task_id", "scenario_id", "session_id", F.lit(arm).alias("policy_id"), hold.miss().alias("p_hold"), switch.miss().alias("p_switch"), hold.cost().alias("v_hold"), switch.cost().alias("v_switch"), ok.alias("supported"))
            pick = risk_allowance_choice(F.col("p_hold"), F.col("p_switch"), F.col("v_hold"), F.col("v_switch"), F.lit(EPSILON), F.col("supported"))
            parts.append(scored.withColumn("d", pick).select(*scored.columns, "d.choice", "d.reason"))
        return self.m.keep(parts[0].unionByName(parts[1]))


def alpha_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm's and action's error on each development session but the first, of fits on all before it, for each
    penalty; the last session's errors choose."""
    found = Actions(spark, sf_dir)
    out = []
    for arm, names in ARMS.items():
        by = M.moments(found.learning(arm), names, "cost", ["action", "session_id"])  # few: one for each session
        for action in ("HOLD", "SWITCH"):
            own = sorted((s, v) for (a, s), v in by.items() if a == action)
            best = M.choose_alpha(own) if own else None
            out += [(arm, action, s, alpha, mse, n, alpha == best) for s, alpha, mse, n in M.ridge_trials(own)]
    return spark.createDataFrame(out, "policy_id string, action string, session_id string, alpha double, mse double, n_train long, chosen boolean")


def b3_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the action policy's worlds of the later sessions end in."""
    found = Actions(spark, sf_dir)
    later = found.m.keep(found.m.grid.filter(~F.col("session_id").isin(found.train)))
    return _outcomes(found.m, later, policies=tuple(ARMS), choices=found.decided())


QUERIES = {"price_model": price_model, "oof_signal": oof_signal, "action_model": lambda s, d: Actions(s, d).decided(), "alpha_trials": alpha_trials, "theta_trials": theta_trials, "b3_outcomes": b3_outcomes}
ORACLE_SQL: dict[str, str] = {}
