"""Queries over orders of ours and over the client's side: commands and reports under halts, the client's state,
its queue estimate and its own book."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import commands as C
from tapeloom.operators import delivery, queues
from tapeloom.operators import worlds as W
from tapeloom.operators.asof import asof
from tapeloom.operators.batches import EVIDENCE_SQL
from tapeloom.operators.book import BOOK_SQL
from tapeloom.plans.market import _STATUS, GRID, HOUR, SQL, Market, _outcomes, _outcomes_sql, _sided, _statuses, _worlds
from tapeloom.sources.schemas import LATENCY

#: One batch of so many is held up on its way to the client, for half an hour.
HELD_EVERY, HELD_NS = 17, HOUR // 2


def _halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's plane of the statuses."""
    return _statuses(spark, sf_dir).select("session_id", F.col("event_time_ns").alias("t"), "seq", "status")


def _simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Market(spark, sf_dir)
    return m.keep(_worlds(m, run=W.simulate, statuses=_halts(spark, sf_dir)))


def _resent(reports: DataFrame) -> DataFrame:
    """The reports as a line delivers them that repeats every report of every fifth task a millisecond later, and
    then says that nothing was executed."""
    again = reports.filter("crc32(task_id) % 5 = 0").withColumns({"delivery_ns": F.col("delivery_ns") + 1_000_000, "executed": F.lit(0)})
    return reports.unionByName(again)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _simulated(spark, sf_dir)
    return C.client_orders(C.commands(found), _resent(C.reports(found)))


def _held():
    return F.when(F.col("batch_id") % HELD_EVERY == 0, HELD_NS).otherwise(0)


def _client_quotes(m: Market) -> DataFrame:
    return delivery.client_quotes(m.numbered, m.batches, _held(), m.keep)


def queue_orders(m: Market, scenarios=("L1", "L6")) -> DataFrame:
    """Passive orders that come to rest, with the last batches of both planes when they are sent, arrive, and are
    asked for at their checkpoint."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(LATENCY[s][0] * 1000).cast("long").alias("d"), F.lit((LATENCY[s][1] + LATENCY[s][2]) * 1000).cast("long").alias("ce")) for s in scenarios)))
    rows = _sided(m.grid).withColumn("x", each).select(
        "task_id", F.col("x.s").alias("scenario_id"), "session_id", "side", "arrival_ns", "deadline_ns", (F.col("arrival_ns") - F.col("x.d")).alias("seen_ns"), (F.col("arrival_ns") + F.col("x.ce")).alias("expected_ns"),
        F.expr("arrival_ns + (deadline_ns - arrival_ns) div 2").alias("checkpoint_ns"), F.expr("arrival_ns + (deadline_ns - arrival_ns) div 2 - x.d").alias("asked_ns"))
    quotes = m.timed
    client = quotes.select("session_id", F.col("capture_time_ns").alias("t"), F.col("batch_id").alias("seq"), F.col("last_ordinal").alias("sent_ordinal"), F.col("proxy_time_ns").alias("sent_ns"), "bid_price", "ask_price")
    market = quotes.select("session_id", F.col("proxy_time_ns").alias("t"), F.col("batch_id").alias("seq"), F.col("last_ordinal").alias("arrived_ordinal"), F.col("bid_price").alias("m_bid"), F.col("ask_price").alias("m_ask"))
    thin = W.thinner(m.grid, 2 * len(scenarios))
    rows = m.keep(rows)
    look = lambda df, plane, at, names: asof(df, thin(plane, rows.select("session_id", at), at, names), ["session_id"], at, "t", "seq", names).drop("sample_time")
    found = look(rows, client, "seen_ns", ["sent_ordinal", "sent_ns", "bid_price", "ask_price"])
    found = look(found, market, "expected_ns", ["arrived_ordinal", "m_bid", "m_ask"])
    found = look(found, client.withColumnRenamed("sent_ordinal", "asked_ordinal"), "asked_ns", ["asked_ordinal"])
    rows = look(found, market.withColumnRenamed("arrived_ordinal", "now_ordinal"), "checkpoint_ns", ["now_ordinal"])
    buys = F.col("side") == "B"
    rows = rows.withColumn("limit", F.when(buys, F.col("bid_price")).otherwise(F.col("ask_price")))
    takes = F.when(buys, F.col("limit") >= F.col("m_ask")).otherwise(F.col("limit") <= F.col("m_bid"))
    return rows.filter(F.col("limit").isNotNull() & ~F.coalesce(takes, F.lit(False)))


def estimates(m: Market, orders: DataFrame) -> DataFrame:
    keys = ["task_id", "scenario_id"]
    near = m.keep(queues.asked_orders(orders, m.intervals, keys))
    of = lambda rows: m.keep(rows.join(near, near.columns, "left_semi"))
    placed = queues.placed_intervals(of(m.intervals), of(m.numbered.filter("action = 'A'")), m.batches)
    return queues.queue_estimates(orders, placed, keys)


def _queues(m: Market) -> DataFrame:
    return estimates(m, m.keep(queue_orders(m))).withColumn("q_depleted_frac", F.round("q_depleted_frac", 9))


def branch_labels(m: Market) -> DataFrame:
    """(task_id, scenario_id, session_id, action, miss, cost): what holding and switching led to at each eligible
    checkpoint, of the same task in two worlds that part there. A cost may be null, a miss is not."""
    found = _outcomes(m, policies=("B1", "PROBE_SWITCH")).filter("checkpoint_eligible and status <> 'TECHNICALLY_UNEVALUABLE'")
    action = F.when(F.col("policy_id") == "B1", "HOLD").otherwise("SWITCH")
    return found.select("task_id", "scenario_id", F.substring_index("task_id", ":", 1).alias("session_id"), action.alias("action"), (F.col("status") == "DEADLINE_MISS").cast("int").alias("miss"), F.col("deadline_cost_ticks").alias("cost"))


def trace(spark: SparkSession, sf_dir: str, task_id: str) -> DataFrame:
    """(policy_id, scenario_id, t, what, detail) of one task, in order of time."""
    found = _simulated(spark, sf_dir).filter(F.col("task_id") == task_id)
    row = lambda df, t, what, *detail: df.select("policy_id", "scenario_id", F.col(t).alias("t"), F.lit(what).alias("what"), F.concat_ws(" ", *detail).alias("detail"))
    rows = row(C.decisions(found), "decision_ns", "decides", "kind", "reason", "choice").unionByName(row(C.commands(found), "send_ns", "sends", "kind", "limit_price")).unionByName(row(C.reports(found), "delivery_ns", "hears", "kind", "reason", "price", "mechanism"))
    return rows.orderBy("policy_id", "scenario_id", "t", "what")


QUERIES = {
    "commands": lambda s, d: C.commands(_simulated(s, d)),
    "reports": lambda s, d: C.reports(_simulated(s, d)),
    "executions": lambda s, d: C.executions(C.reports(_simulated(s, d))),
    "decisions": lambda s, d: C.decisions(_simulated(s, d)),
    "latest_decisions": lambda s, d: C.latest_decisions(C.decisions(_simulated(s, d))),
    "client_orders": _orders,
    "halted_outcomes": lambda s, d: _outcomes(Market(s, d), statuses=_halts(s, d)),
    "client_quotes": lambda s, d: _client_quotes(Market(s, d)),
    "plane_gap": lambda s, d: (lambda m: delivery.plane_gap(m.quotes, m.keep(_client_quotes(m))))(Market(s, d)),
    "queue_cohort": lambda s, d: _queues(Market(s, d)),
    "branch_labels": lambda s, d: branch_labels(Market(s, d)),
}

#: The market's statuses come first, as the worlds read them.
_HALTED = W.worlds_sql(halts="select session_id, event_time_ns as t, seq, status from statuses")
_GRID = f"{GRID}, {_STATUS}"
_EVENTS = f"{_GRID}, {EVIDENCE_SQL}, {_HALTED}, {C.COMMANDS_SQL}"
_KEYS = "task_id, policy_id, scenario_id, session_id"
_CLIENT = f"""{SQL},
delivered as (
  select *, row_number() over w - 1 as place, coalesce(sum(n_records) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as records_before
  from (select *, capture_time_ns + case when batch_id % {HELD_EVERY} = 0 then {HELD_NS} else 0 end as deliver_ns from batches) window w as (partition by session_id order by deliver_ns, batch_id)),
own_numbered as (
  select n.* replace (d.place as batch_id, d.records_before + row_number() over (partition by n.session_id, n.batch_id order by n.source_ordinal) - 1 as source_ordinal)
  from numbered n join delivered d using (session_id, batch_id)),
own_batches as (select * replace (place as batch_id, records_before as first_ordinal, records_before + n_records - 1 as last_ordinal), batch_id as market_batch_id from delivered)"""
_CLIENT_BOOK = f"{_CLIENT}, " + BOOK_SQL.replace("numbered", "own_numbered").replace("batches", "own_batches")
_CLIENT_QUOTES = f"""{_CLIENT_BOOK}, client_quotes as (select q.session_id, q.batch_id as place, b.market_batch_id as batch_id, b.deliver_ns, bid_price, bid_qty, ask_price, ask_qty, mid2
  from quotes q join own_batches b using (session_id, batch_id))"""
#: The market's book beside the client's, under other names.
_MARKET_BOOK = re.sub(r"\b(epochs|own|fold|states|intervals|resting|depth|quotes)\b", r"m_\1", BOOK_SQL)

ORACLE_SQL = {
    "branch_labels": f"""select task_id, scenario_id, split_part(task_id, ':', 1) as session_id, case when policy_id = 'B1' then 'HOLD' else 'SWITCH' end as action, (status = 'DEADLINE_MISS')::int as miss, deadline_cost_ticks as cost
      from ({_outcomes_sql(GRID, W.worlds_sql(("B1", "PROBE_SWITCH")))}) where checkpoint_eligible and status <> 'TECHNICALLY_UNEVALUABLE'""",
    "commands": f"{_EVENTS} select * from commands",
    "reports": f"{_EVENTS} select * from reports",
    "executions": f"""{_EVENTS} select {_KEYS}, command_id || ':X' as execution_id, command_id, exchange_ns, price, 1::bigint as quantity,
      case when mechanism = 'AGGRESSIVE' then 'AGGRESSIVE' else 'PASSIVE' end as liquidity, mechanism from reports where kind = 'FILL'""",
    "decisions": f"{_EVENTS} select * from decisions",
    "latest_decisions": f"""{_EVENTS} select {_KEYS}, count(*)::bigint as n_decisions, arg_max(kind, (decision_ns, seq)) as kind, arg_max(reason, (decision_ns, seq)) as reason,
      (array_agg(choice order by decision_ns desc, seq desc))[1] as choice, max(decision_ns) as decision_ns from decisions group by {_KEYS}""",
    # Without the fold: who was filled, else what ended last; reports come once here.
    "client_orders": f"""{_EVENTS},
      heard as (select {_KEYS}, count(*) as n, bool_or(kind = 'FILL') as filled, min(exchange_ns) filter (kind = 'FILL') as completion_ns, arg_max(kind, (delivery_ns, exchange_ns)) filter (kind in ('ACCEPTED', 'REJECTED', 'CANCELLED', 'AGGRESSIVE_UNFILLED', 'TECHNICAL_RESET')) as last from reports group by {_KEYS}),
      sent as (select {_KEYS}, count(*) as n from commands group by {_KEYS}),
      worlds_all as (select {_KEYS} from named)
      select w.task_id, w.policy_id, w.scenario_id, w.session_id, coalesce(s.n, 0)::int as n_commands, coalesce(h.n, 0)::int as n_reports,
        case when filled then 'FILLED' when last = 'TECHNICAL_RESET' then 'TECHNICAL' when last is null then 'NONE' else last end as state, coalesce(filled, false)::int as executed, 0 as reserved, 1 as most, completion_ns
      from worlds_all w join sent s using ({_KEYS}) left join heard h using ({_KEYS})""",
    "halted_outcomes": _outcomes_sql(_GRID, _HALTED),
    "client_quotes": f"{_CLIENT_QUOTES} select * from client_quotes",
    "plane_gap": f"""{_CLIENT_QUOTES}, {_MARKET_BOOK}
      select c.session_id, count(*)::bigint as n_batches, count(*) filter (place <> c.batch_id)::bigint as n_overtaken, count(*) filter (c.mid2 is distinct from m.mid2)::bigint as n_other_mid,
        count(*) filter ((c.bid_price, c.bid_qty, c.ask_price, c.ask_qty) is distinct from (m.bid_price, m.bid_qty, m.ask_price, m.ask_qty))::bigint as n_other_quote
      from client_quotes c join m_quotes m on m.session_id = c.session_id and m.batch_id = c.batch_id group by 1""",
    "queue_cohort": f"""{GRID}, {queues.QUEUES_SQL},
      spec(scenario_id, d, ce) as (values ('L1', 0, 300000), ('L6', 1000000, 3000000)),
      asked as (select g.session_id || ':' || g.k || ':' || s.side as task_id, x.scenario_id, g.session_id, s.side, g.arrival_ns - x.d as seen_ns, g.arrival_ns + x.ce as expected_ns, (g.arrival_ns + g.deadline_ns) // 2 as checkpoint_ns, x.d
        from grid g, (values ('B'), ('A')) s(side), spec x),
      timed as (select q.session_id, q.batch_id, q.proxy_time_ns, b.capture_time_ns, b.last_ordinal, q.bid_price, q.ask_price from quotes q join batches b using (session_id, batch_id)),
      sent as (
        select a.*, case when side = 'B' then c.bid_price else c.ask_price end as lim, c.last_ordinal as o0, c.proxy_time_ns as p0, m.last_ordinal as ox, m.bid_price as mb, m.ask_price as ma, c1.last_ordinal as o1, m1.last_ordinal as oc
        from asked a left join lateral (select * from timed t where t.session_id = a.session_id and t.capture_time_ns <= a.seen_ns order by t.capture_time_ns desc, t.batch_id desc limit 1) c on true
          left join lateral (select * from timed t where t.session_id = a.session_id and t.proxy_time_ns <= a.expected_ns order by t.proxy_time_ns desc, t.batch_id desc limit 1) m on true
          left join lateral (select * from timed t where t.session_id = a.session_id and t.capture_time_ns <= a.checkpoint_ns - a.d order by t.capture_time_ns desc, t.batch_id desc limit 1) c1 on true
          left join lateral (select * from timed t where t.session_id = a.session_id and t.proxy_time_ns <= a.checkpoint_ns order by t.proxy_time_ns desc, t.batch_id desc limit 1) m1 on true),
      resting_orders as (select * from sent where lim is not null and not coalesce(case when side = 'B' then lim >= ma else lim <= mb end, false)),
      held as (
        select o.task_id, o.scenario_id,
          coalesce(sum(quantity) filter (ord_from <= o0 and ord_to > o0), 0)::bigint as first,
          coalesce(sum(quantity) filter (ord_from <= o1 and ord_to > o1 and since <= o0), 0)::bigint as est,
          coalesce(sum(quantity) filter (ord_from <= o1 and ord_to > o1 and since > o0 and added_ns > p0 and added_ns <= expected_ns
            and not coalesce(before <= o0 or (before_added_ns > p0 and before_added_ns <= expected_ns), false)), 0)::bigint as more,
          coalesce(sum(quantity) filter (ord_from <= oc and ord_to > oc and since <= ox), 0)::bigint as true_ahead
        from resting_orders o left join placed p on p.session_id = o.session_id and p.side = o.side and p.price_fixed = o.lim group by 1, 2)
      select task_id, scenario_id, est as q_ahead_est, est + more as q_ahead_upper, more as q_insertion_uncertain, first - est as q_depleted,
        round(case when first > 0 then (first - est) / first else 0.0 end, 9)::double as q_depleted_frac, true_ahead from held""",
}
