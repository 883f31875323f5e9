"""What worlds send and hear: commands, reports, executions, decisions, and the client's state from its reports.

A world has at most three commands (a passive order, its cancel, an order that takes), so its tables
are a few rows exploded from its own row, and its client's state is a fold over a handful of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.metrics import checkpoint_eligibility
from tapeloom.operators.worlds import KEY

PASSIVE, CANCEL, AGGRESSIVE = "PASSIVE_LIMIT", "CANCEL", "AGGRESSIVE"


def _rows(simulated: DataFrame, *entries: tuple[Column, dict[str, Column]]) -> DataFrame:
    """A row for each entry whose condition holds."""
    each = [F.when(F.coalesce(held, F.lit(False)), F.struct(*(c.alias(n) for n, c in fields.items()))) for held, fields in entries]
    return simulated.select(*KEY, "session_id", F.explode(F.filter(F.array(*each), lambda e: e.isNotNull())).alias("e")).select(*KEY, "session_id", "e.*")


def _id(kind: str) -> Column:
    return F.concat_ws(":", *KEY, F.lit(kind))


def commands(simulated: DataFrame) -> DataFrame:
    """(task_id, policy_id, scenario_id, session_id, command_id, kind, target_id, limit_price, decision_ns, send_ns,
    arrival_ns) of ``worlds.simulate``: a command is sent once computed and arrives after the entry delay."""
    none = F.lit(None)

    def one(kind: str, arrives: str, limit: Column = none, target: Column = none) -> dict[str, Column]:
        decided = F.col(arrives) - F.col("ce")
        return {"command_id": _id(kind), "kind": F.lit(kind), "target_id": target.cast("string"), "limit_price": limit.cast("long"), "decision_ns": decided, "send_ns": decided + F.col("c"), "arrival_ns": F.col(arrives)}

    return _rows(simulated, (F.col("limit").isNotNull(), one(PASSIVE, "x0", F.col("limit"))), (F.col("cancel_sent"), one(CANCEL, "cancel_ns", target=_id(PASSIVE))), (F.col("take_ns").isNotNull(), one(AGGRESSIVE, "take_ns")))


def reports(simulated: DataFrame) -> DataFrame:
    """(..., report_id, command_id, kind, reason, exchange_ns, delivery_ns, executed, price, mechanism) of
    ``worlds.simulate``: executed is the order's quantity so far."""

    def one(command: str, kind: str | Column, at: Column, reason: str | Column = "", executed: int | Column = 0, price: Column = F.lit(None), mechanism: Column = F.lit(None)) -> dict[str, Column]:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return {
            "report_id": F.concat_ws(":", _id(command), lit(kind)), "command_id": _id(command), "kind": lit(kind), "reason": lit(reason), "exchange_ns": at,
            "delivery_ns": at + F.col("r"), "executed": lit(executed).cast("int"), "price": price.cast("long"), "mechanism": mechanism.cast("string"),
        }

    x0, took = F.col("x0"), F.col("take_price").isNotNull() & (F.col("take_status") == "TRADING")
    served = F.when(F.col("filled") | F.col("technical"), "CANCEL_REJECTED_TERMINAL").otherwise("CANCELLED")
    late = F.when(F.col("filled") | F.col("technical"), "ALREADY_TERMINAL").otherwise("")
    halted = F.when(F.col("take_status") == "TRADING", "NO_LIQUIDITY").when(F.col("take_status") == "HALTED", "HALTED").otherwise("STATUS")
    return _rows(
        simulated,
        (F.col("rejected"), one(PASSIVE, "REJECTED", x0, "STATUS")),
        (F.col("working"), one(PASSIVE, "ACCEPTED", x0)),
        (F.col("marketable"), one(PASSIVE, "FILL", x0, "", 1, F.col("x0_price"), F.lit("AGGRESSIVE"))),
        (F.col("filled"), one(PASSIVE, "FILL", F.col("fill.t"), "", 1, F.col("limit"), F.col("fill.m"))),
        (F.col("technical"), one(PASSIVE, "TECHNICAL_RESET", F.col("reset.t"), "TECHNICAL_RESET")),
        (F.col("cancel_sent"), one(CANCEL, served, F.col("cancel_ns"), late, F.col("filled").cast("int"))),
        (F.col("take_ns").isNotNull() & took, one(AGGRESSIVE, "FILL", F.col("take_ns"), "", 1, F.col("take_price"), F.lit("AGGRESSIVE"))),
        (F.col("take_ns").isNotNull() & ~took, one(AGGRESSIVE, "AGGRESSIVE_UNFILLED", F.col("take_ns"), halted)),
    )


def executions(reports: DataFrame) -> DataFrame:
    """(..., execution_id, command_id, exchange_ns, price, quantity, liquidity, mechanism): the fills."""
    liquidity = F.when(F.col("mechanism") == "AGGRESSIVE", "AGGRESSIVE").otherwise("PASSIVE")
    return reports.filter("kind = 'FILL'").select(*KEY, "session_id", F.concat_ws(":", "command_id", F.lit("X")).alias("execution_id"), "command_id", "exchange_ns", "price", F.lit(1).cast("long").alias("quantity"), liquidity.alias("liquidity"), "mechanism")


def decisions(simulated: DataFrame) -> DataFrame:
    """(..., seq, decision_ns, kind, reason, choice): what a world's policy decides at arrival, its checkpoint and
    its cutoff. At the checkpoint it knows the reports delivered until then; it holds or switches only where the
    order is known to work and nothing is pending."""
    at = F.col("checkpoint_ns")
    heard = F.col("known_ns") <= at
    state = (
        F.when(F.col("limit").isNull(), "NONE").when(~heard, "IN_FLIGHT").when(F.col("rejected"), "REJECTED").when(F.col("marketable"), "FILLED")
        .when(F.coalesce("fill_known", F.lit(False)), "FILLED").when(F.col("reset_known"), "TECHNICAL").otherwise("WORKING")
    )
    no = F.lit(False)
    reason = checkpoint_eligibility(state, no, no, F.col("rejected") & heard, no, F.lit(0))
    choice = F.when(F.col("checkpoint_eligible"), F.when(F.col("switches"), "SWITCH").otherwise("HOLD"))
    first = F.when(F.col("policy_id") == "B0", "TAKE").when(F.col("limit").isNull(), "NONE").otherwise("JOIN")
    one = lambda seq, t, kind, reason, choice: {"seq": F.lit(seq), "decision_ns": t, "kind": F.lit(kind), "reason": reason, "choice": choice}
    passive = F.col("policy_id") != "B0"
    switched = F.coalesce(choice == "SWITCH", F.lit(False))
    return _rows(
        simulated,
        (F.lit(True), one(0, F.col("arrival_ns"), "ARRIVAL", F.lit(""), first)),
        (passive, one(1, at, "CHECKPOINT", reason, choice)),
        (passive & ~switched, one(2, F.col("cutoff_ns"), "CUTOFF", F.lit(""), F.lit("TERMINATE"))),
    )


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each world, by time and then by place."""
    last = F.max_by(F.struct("kind", "reason", "choice", "decision_ns"), F.struct("decision_ns", "seq"))
    return decisions.groupBy(*KEY, "session_id").agg(last.alias("d"), F.count("*").alias("n_decisions")).select(*KEY, "session_id", "n_decisions", "d.*")


def first_deliveries(reports: DataFrame) -> DataFrame:
    """Of each report_id the delivery that comes first; later ones change nothing. The first is kept with its
    own columns, whatever a later copy says."""
    w = Window.partitionBy("report_id").orderBy("delivery_ns", "exchange_ns")
    return reports.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


#: Client states that only a fill or a new command leaves.
TERMINAL = ("FILLED", "CANCELLED", "REJECTED", "AGGRESSIVE_UNFILLED", "TECHNICAL")


def _after(s: Column, e: Column) -> Column:
    """A client's state after an event: a command of its own (a name of a kind) or a report."""
    kind, state, executed = e["kind"], s["state"], s["executed"]
    over = state.isin(*TERMINAL)
    done = (kind == "FILL") | ((kind == "CANCEL_REJECTED_TERMINAL") & (e["executed"] >= 1) & ~over)
    sends = kind.isin(PASSIVE, AGGRESSIVE)
    ends = {"REJECTED": "REJECTED", "CANCELLED": "CANCELLED", "AGGRESSIVE_UNFILLED": "AGGRESSIVE_UNFILLED", "TECHNICAL_RESET": "TECHNICAL"}
    new = F.when(sends, "IN_FLIGHT").when((kind == CANCEL) & (state == "WORKING"), "CANCEL_PENDING").when(done, "FILLED")
    new = new.when((kind == "ACCEPTED") & state.isin("IN_FLIGHT", "NONE"), "WORKING")
    for k, v in ends.items():
        new = new.when((kind == k) & ~over, v)
    frees = done | (kind.isin(*ends, "CANCEL_REJECTED_TERMINAL") & ~over)
    reserved = F.when(sends, s["reserved"] + 1).when(frees, 0).otherwise(s["reserved"])
    executed = F.when(done, 1).otherwise(executed)
    return F.struct(
        F.coalesce(new, state).alias("state"), executed.cast("int").alias("executed"), reserved.cast("int").alias("reserved"),
        F.greatest(s["most"], executed + reserved).cast("int").alias("most"), F.when((kind == "FILL") & s["completion_ns"].isNull(), e["exchange_ns"]).otherwise(s["completion_ns"]).alias("completion_ns"),
    )


def client_orders(commands: DataFrame, delivered: DataFrame) -> DataFrame:
    """(task_id, policy_id, scenario_id, session_id, n_commands, n_reports, state, executed, reserved, most,
    completion_ns): each world's client after all of its events, in order of time.

    ``delivered`` are reports as they come, repeated ones too; of each report_id the first counts. A terminal
    state stays but for a fill or a new command; a fill that a late cancel told of counts once. ``most`` is the
    largest sum of executed and reserved quantity, which never passes 1. A world's handful of events is folded in
    one row.
    """
    first = first_deliveries(delivered)
    zero = F.lit(0)
    sent = commands.select(*KEY, "session_id", F.col("decision_ns").alias("t"), zero.alias("class"), F.col("decision_ns").alias("exchange_ns"), "kind", zero.alias("executed"))
    heard = first.select(*KEY, "session_id", F.col("delivery_ns").alias("t"), F.lit(-1).alias("class"), "exchange_ns", "kind", "executed")
    event = F.struct("t", "class", "exchange_ns", "kind", "executed")
    events = sent.unionByName(heard).groupBy(*KEY, "session_id").agg(F.sort_array(F.collect_list(event)).alias("events"))
    start = F.expr("named_struct('state', 'NONE', 'executed', 0, 'reserved', 0, 'most', 0, 'completion_ns', cast(null as bigint))")
    told = events.withColumn("s", F.aggregate("events", start, _after))
    own = F.size(F.filter("events", lambda e: e["class"] == 0))
    return told.select(*KEY, "session_id", own.alias("n_commands"), (F.size("events") - own).alias("n_reports"), "s.*")


COMMANDS_SQL = """
named as (select *, task_id || ':' || policy_id || ':' || scenario_id || ':' as pre, working and not coalesce(f_t + r <= decide_ns and not lost, false) and not coalesce(z_t + r <= decide_ns and lost, false) as cancel_sent from found),
commands as (
  select task_id, policy_id, scenario_id, session_id, pre || kind as command_id, kind, target_id, limit_price::bigint as limit_price, goes_ns - ce as decision_ns, goes_ns - ce + c as send_ns, goes_ns as arrival_ns
  from (select *, 'PASSIVE_LIMIT' as kind, null::varchar as target_id, lim as limit_price, x0 as goes_ns from named where lim is not null
    union all select *, 'CANCEL', pre || 'PASSIVE_LIMIT', null, cancel_ns from named where cancel_sent
    union all select *, 'AGGRESSIVE', null, null, take_ns from named where take_ns is not null)),
told as (
  select *, 'PASSIVE_LIMIT' as about, 'REJECTED' as kind, 'STATUS' as reason, x0 as goes_ns, 0 as executed, null::bigint as price, null::varchar as mech from named where rejected
  union all select *, 'PASSIVE_LIMIT', 'ACCEPTED', '', x0, 0, null, null from named where working
  union all select *, 'PASSIVE_LIMIT', 'FILL', '', x0, 1, x0_price, 'AGGRESSIVE' from named where marketable
  union all select *, 'PASSIVE_LIMIT', 'FILL', '', f_t, 1, lim, case when f_price = lim then 'QUEUE_DEPLETION' else 'TRADE_THROUGH' end from named where filled
  union all select *, 'PASSIVE_LIMIT', 'TECHNICAL_RESET', 'TECHNICAL_RESET', z_t, 0, null, null from named where technical
  union all select *, 'CANCEL', case when filled or technical then 'CANCEL_REJECTED_TERMINAL' else 'CANCELLED' end, case when filled or technical then 'ALREADY_TERMINAL' else '' end, cancel_ns, filled::int, null, null from named where cancel_sent
  union all select *, 'AGGRESSIVE', 'FILL', '', take_ns, 1, take_price, 'AGGRESSIVE' from named where take_ns is not null and take_price is not null
  union all select *, 'AGGRESSIVE', 'AGGRESSIVE_UNFILLED', case when take_status = 'TRADING' then 'NO_LIQUIDITY' else take_status end, take_ns, 0, null, null from named where take_ns is not null and take_price is null),
reports as (
  select task_id, policy_id, scenario_id, session_id, pre || about || ':' || kind as report_id, pre || about as command_id, kind, reason, goes_ns as exchange_ns, goes_ns + r as delivery_ns, executed::int as executed, price, mech as mechanism from told),
decisions as (
  select task_id, policy_id, scenario_id, session_id, 0 as seq, arrival_ns as decision_ns, 'ARRIVAL' as kind, '' as reason, case when policy_id = 'B0' then 'TAKE' when lim is null then 'NONE' else 'JOIN' end as choice from named
  union all
  select task_id, policy_id, scenario_id, session_id, 1, checkpoint_ns, 'CHECKPOINT',
    case when lim is not null and x0 + r > checkpoint_ns then 'INELIGIBLE_PENDING' when marketable or coalesce(f_t + r <= checkpoint_ns and not lost, false) then 'REPORTED_COMPLETE'
      when rejected then 'INELIGIBLE_REJECTED' when checkpoint_eligible then 'MODEL_CHOICE' else 'INELIGIBLE_NOT_WORKING' end,
    case when checkpoint_eligible then case when policy_id = 'PROBE_SWITCH' then 'SWITCH' else 'HOLD' end end from named where policy_id <> 'B0'
  union all
  select task_id, policy_id, scenario_id, session_id, 2, cutoff_ns, 'CUTOFF', '', 'TERMINATE' from named where policy_id <> 'B0' and not (checkpoint_eligible and policy_id = 'PROBE_SWITCH'))
"""
