"""Hypothetical one-contract orders against the tape, in closed form.

An order of ours never moves the book, so its world is a chain of at most three commands, and each step
is the first event after a known time. Policies are rows: B0 takes at arrival, B1 joins the best and
holds, PROBE_SWITCH joins and switches at the checkpoint if it may, and a price rule does so where the
signal that the client sees there is over its theta. All tasks, policies and scenarios are one set of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.metrics import price_rule_choice
from tapeloom.operators.asof import asof, thinned
from tapeloom.operators.book import BUCKET
from tapeloom.operators.ranges import points_in_intervals, points_in_mixed_intervals
from tapeloom.sources.schemas import LATENCY, TICK

POLICIES = ("B0", "B1", "PROBE_SWITCH")
KEY = ["task_id", "policy_id", "scenario_id"]


def guard_ns(compute_us: int, entry_us: int, response_us: int) -> int:
    return (3 * (compute_us + entry_us) + 2 * response_us) * 1000 + 1


PLACE = ["session_id", "order_id", "side", "price_fixed", "priority"]
#: Ordinals that an order rests unchanged for in most cases.
SHORT = 256


def clears(ours: DataFrame, intervals: DataFrame, keep=lambda df: df) -> DataFrame:
    """(KEY, clear_ordinal) of ``ours`` (KEY, session_id, side, price_fixed, last_ordinal): when the last order leaves its
    place that stands at this level then. An order keeps its place through adjoining intervals, so only those of
    the orders that stand there are looked at further. ``keep`` may write these."""
    ahead = keep(points_in_intervals(ours, intervals.select(*PLACE, "ord_from", "ord_to"), ["session_id", "side", "price_fixed"], "last_ordinal", "ord_from", "ord_to", BUCKET).select(*KEY, *PLACE))
    until = intervals.join(ahead.select(*PLACE).distinct(), PLACE, "left_semi").groupBy(*PLACE).agg(F.max("ord_to").alias("until"))
    return ahead.join(until, PLACE).groupBy(*KEY).agg(F.max("until").alias("clear_ordinal"))


def resting_fills(numbered: DataFrame, batches: DataFrame, evidence: DataFrame, intervals: DataFrame) -> DataFrame:
    """(session_id, side, price_fixed, ordinal, t): fills that an evaluator may trust. Their batch has
    only valid groups and no flag, their order rests at the best price of its side with quantity enough."""
    good = evidence.filter("n_allocations > 0").select("session_id", "batch_id").join(batches.select("session_id", "batch_id", F.col("proxy_time_ns").alias("t")), ["session_id", "batch_id"])
    fills = numbered.filter("action = 'F' and quantity > 0").join(good, ["session_id", "batch_id"]).select("session_id", "t", F.col("source_ordinal").alias("ordinal"), (F.col("source_ordinal") - 1).alias("at"), "side", F.col("price_fixed").alias("f_price"), F.col("quantity").alias("f_qty"), F.col("order_id").alias("f_order"))
    before = points_in_mixed_intervals(fills, intervals.select("session_id", "side", "order_id", "price_fixed", "quantity", "ord_from", "ord_to"), ["session_id", "side"], "at", "ord_from", "ord_to", SHORT, BUCKET)
    best = F.when(F.col("side") == "B", F.max("price_fixed")).otherwise(F.min("price_fixed"))
    own = (F.col("order_id") == F.col("f_order")) & (F.col("price_fixed") == F.col("f_price")) & (F.col("quantity") >= F.col("f_qty"))
    rows = before.groupBy("session_id", "t", "ordinal", "side", "f_price").agg(best.alias("best"), F.bool_or(own).alias("own"))
    return rows.filter("own and best = f_price").select("session_id", "side", F.col("f_price").alias("price_fixed"), "ordinal", "t")


def _opposite(side: Column, bid: str, ask: str) -> Column:
    return F.when(side == "B", F.col(ask)).otherwise(F.col(bid))


def trading_at(rows: DataFrame, at: str, statuses: DataFrame | None, name: str) -> DataFrame:
    """``rows`` with ``name``: the trading status at ``at``, by ``statuses`` (session_id, t, seq, status); before
    any, or without the table, a session trades."""
    if statuses is None:
        return rows.withColumn(name, F.lit("TRADING"))
    found = asof(rows, statuses.select("session_id", "t", "seq", F.col("status").alias(name)), ["session_id"], at, "t", "seq", [name]).drop("sample_time")
    return found.withColumn(name, F.coalesce(name, F.lit("TRADING")))


#: Probes of which the times are broadcast.
FEW = 2_000_000


def thinner(tasks: DataFrame, times: int = 1):
    """What cuts (session_id, t, seq, ...) to the rows that ``times`` probes a task can find, where they are few."""
    if tasks.count() * times > FEW:
        return lambda samples, at_times, at, values, skip_null=None: samples
    return lambda samples, at_times, at, values, skip_null=None: thinned(samples, at_times, ["session_id"], at, "t", "seq", values, skip_null)


def worlds(*tables: DataFrame, **options) -> DataFrame:
    """One row for each task, policy and scenario: limit, checkpoint_eligible, exec_ns, exec_price, mechanism,
    reset. Takes what ``simulate`` takes."""
    return simulate(*tables, **options).select(*KEY, "session_id", "side", "arrival_ns", "deadline_ns", "limit", "checkpoint_eligible", "exec_ns", "exec_price", "mechanism", F.col("technical").alias("reset"))


def simulate(tasks: DataFrame, market: DataFrame, client: DataFrame, intervals: DataFrame, fills: DataFrame, resets: DataFrame, scenarios=tuple(LATENCY), policies=POLICIES, keep=lambda df: df, thetas: dict[str, float] | None = None, signals: DataFrame | None = None, statuses: DataFrame | None = None, choices: DataFrame | None = None) -> DataFrame:
    """One row for each task (task_id, session_id, side B or A, arrival_ns, deadline_ns), policy and
    scenario, with all times and verdicts of its commands; ``operators.commands`` makes tables of them.

    ``market`` and ``client`` are quotes (session_id, t, seq, bid_price, ask_price; market also
    last_ordinal) by batch time and by delivery; ``resets`` are (session_id, t, ordinal). ``keep`` may
    write what several steps read, such as a checkpoint. ``thetas`` names price rules among the policies;
    they read ``signals`` (session_id, t, seq, signal) by delivery, and switch without one. ``statuses``
    (session_id, t, seq, status) halt the market: a passive order that comes then is rejected, one that takes stays
    unfilled, and what the tape shows fills nobody; cancels are served. ``choices`` (task_id, policy_id,
    scenario_id, choice) are what models chose for other policies at an eligible checkpoint; a world without one
    switches.
    """
    thetas = thetas or {}
    modelled = set(policies) - set(POLICIES) - set(thetas)
    unknown = set() if choices is not None else modelled
    if unknown or (thetas and signals is None):
        raise ValueError(f"no rule for {sorted(unknown)}" if unknown else "price rules need signals")
    spec = [(s, LATENCY[s][0] * 1000, LATENCY[s][1] * 1000, LATENCY[s][2] * 1000, LATENCY[s][3] * 1000, guard_ns(*LATENCY[s][1:])) for s in scenarios]
    number = lambda v, name: F.lit(v).cast("long").alias(name)
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(s).alias("s"), number(d, "d"), number(c, "c"), number(c + e, "ce"), number(r, "r"), number(g, "g")) for s, d, c, e, r, g in spec for p in policies)))
    w = tasks.withColumn("x", each).select(
        "task_id", "session_id", "side", "arrival_ns", "deadline_ns", F.col("x.p").alias("policy_id"), F.col("x.s").alias("scenario_id"), F.col("x.c").alias("c"), F.col("x.ce").alias("ce"), F.col("x.r").alias("r"),
        (F.col("arrival_ns") - F.col("x.d")).alias("seen_ns"), (F.col("arrival_ns") + F.col("x.ce")).alias("x0"),
        F.expr("arrival_ns + (deadline_ns - arrival_ns) div 2").alias("checkpoint_ns"), (F.col("deadline_ns") - F.col("x.g")).alias("cutoff_ns"),
    )
    thin = thinner(tasks, len(scenarios) * len(policies))
    times = w.select("session_id", "seen_ns", "x0", (F.col("checkpoint_ns") - (F.col("arrival_ns") - F.col("seen_ns"))).alias("decide_ns"))
    w = asof(w, thin(client, times, "seen_ns", ["bid_price", "ask_price"]), ["session_id"], "seen_ns", "t", "seq", ["bid_price", "ask_price"]).drop("sample_time")
    passive = F.col("policy_id") != "B0"
    w = w.withColumn("limit", F.when(passive, F.when(F.col("side") == "B", F.col("bid_price")).otherwise(F.col("ask_price")))).drop("bid_price", "ask_price")
    w = asof(w, thin(market, times, "x0", ["bid_price", "ask_price", "last_ordinal"]), ["session_id"], "x0", "t", "seq", ["bid_price", "ask_price", "last_ordinal"]).drop("sample_time")
    w = trading_at(w, "x0", statuses, "x0_status")
    fills = trading_at(fills, "t", statuses, "fill_status").filter("fill_status = 'TRADING'").drop("fill_status")
    opposite = _opposite(F.col("side"), "bid_price", "ask_price")
    marketable = (F.col("x0_status") == "TRADING") & F.coalesce(F.col("limit").isNotNull() & F.when(F.col("side") == "B", F.col("limit") >= opposite).otherwise(F.col("limit") <= opposite), F.lit(False))
    w = w.withColumns({"marketable": marketable, "x0_price": opposite}).withColumn("rejected", F.col("limit").isNotNull() & (F.col("x0_status") != "TRADING"))
    w = w.withColumn("working", F.col("limit").isNotNull() & ~F.col("marketable") & ~F.col("rejected"))
    switches = F.col("policy_id") == "PROBE_SWITCH"
    if thetas:
        decide = F.col("checkpoint_ns") - (F.col("arrival_ns") - F.col("seen_ns"))
        w = asof(w.withColumn("decide_ns", decide), thin(signals, times, "decide_ns", ["signal"]), ["session_id"], "decide_ns", "t", "seq", ["signal"]).drop("sample_time", "decide_ns")
        theta = F.coalesce(*(F.when(F.col("policy_id") == p, F.lit(v)) for p, v in thetas.items()))
        rule = price_rule_choice(F.when(F.col("side") == "B", 1).otherwise(-1), F.col("signal"), theta) == "SWITCH"
        switches = switches | (F.col("policy_id").isin(*thetas) & rule)
    if choices is not None:
        w = w.join(choices.select(*KEY, "choice"), KEY, "left")
        switches = switches | (F.col("policy_id").isin(*modelled) & (F.coalesce("choice", F.lit("SWITCH")) == "SWITCH"))
    w = keep(w.withColumn("switches", switches))
    # Orders ahead at our level when we arrive; the last of them leaves at clear_ordinal.
    ours = w.filter("working and last_ordinal is not null").select(*KEY, "session_id", "side", F.col("limit").alias("price_fixed"), "last_ordinal")
    w = keep(w.join(clears(ours, intervals, keep), KEY, "left"))
    # Without a fill, the controller starts at the cutoff or, if the order is known to work, at the checkpoint.
    known = F.col("x0") + F.col("r")

    def chain(start: Column) -> Column:
        """Arrival of the cancel that a controller sends which starts then."""
        return F.greatest(start, known) + F.col("ce")

    span = lambda to: w.filter("working").select(*KEY, "session_id", F.col("side").alias("w_side"), "limit", "clear_ordinal", "cutoff_ns", (F.col("x0") + 1).alias("lo"), (to + 1).alias("hi"))
    longest = span(chain(F.col("cutoff_ns")))
    bucket = 3_600_000_000_000
    met = points_in_intervals(fills, longest, ["session_id"], "t", "lo", "hi", bucket).filter("side = w_side and (clear_ordinal is null or ordinal > clear_ordinal)")
    met = met.filter((F.col("price_fixed") == F.col("limit")) | F.when(F.col("w_side") == "B", F.col("price_fixed") < F.col("limit")).otherwise(F.col("price_fixed") > F.col("limit")))
    mechanism = F.when(F.col("price_fixed") == F.col("limit"), "QUEUE_DEPLETION").otherwise("TRADE_THROUGH")
    first = met.groupBy(*KEY).agg(F.min(F.struct("ordinal", "t", mechanism.alias("m"))).alias("fill"))
    hit = points_in_intervals(resets, longest, ["session_id"], "t", "lo", "hi", bucket).groupBy(*KEY).agg(F.min(F.struct("ordinal", "t")).alias("reset"))
    w = w.join(first, KEY, "left").join(hit, KEY, "left")
    lost = F.col("reset").isNotNull() & (F.col("fill").isNull() | (F.col("reset.ordinal") < F.col("fill.ordinal")))
    # What the client knows at the checkpoint: an accepted order, no fill, no reset.
    fill_known = F.coalesce(F.col("fill.t") + F.col("r") <= F.col("checkpoint_ns"), F.lit(False)) & ~lost
    reset_known = lost & (F.col("reset.t") + F.col("r") <= F.col("checkpoint_ns"))
    eligible = F.col("working") & (known <= F.col("checkpoint_ns")) & ~fill_known & ~reset_known
    w = w.withColumn("checkpoint_eligible", F.coalesce(eligible, F.lit(False)))
    start = F.when(F.col("checkpoint_eligible") & F.col("switches"), F.col("checkpoint_ns")).otherwise(F.col("cutoff_ns"))
    w = w.withColumns({"known_ns": known, "fill_known": fill_known, "reset_known": F.coalesce(reset_known, F.lit(False)), "decide_ns": F.greatest(start, known), "cancel_ns": chain(start)})
    filled = F.col("working") & F.coalesce((F.col("fill.t") <= F.col("cancel_ns")) & ~lost, F.lit(False))
    technical = F.col("working") & lost & F.coalesce(F.col("reset.t") <= F.col("cancel_ns"), F.lit(False))
    taker = F.when(F.col("policy_id") == "B0", F.col("x0")).when(F.col("limit").isNull(), F.col("cutoff_ns") + F.col("ce")).when(F.col("rejected"), chain(F.col("cutoff_ns"))).when(F.col("working") & ~filled & ~technical, F.col("cancel_ns") + F.col("r") + F.col("ce"))
    # A cancel is sent unless the client knows by then that nothing is left to cancel.
    told = lambda event: F.coalesce(F.col(f"{event}.t") + F.col("r") <= F.col("decide_ns"), F.lit(False))
    sent = F.col("working") & ~F.coalesce(told("fill") & ~lost, F.lit(False)) & ~F.coalesce(told("reset") & lost, F.lit(False))
    w = keep(w.withColumns({"filled": filled, "technical": technical, "cancel_sent": sent}).withColumn("take_ns", taker).drop("bid_price", "ask_price", "last_ordinal"))
    w = asof(w, thin(market, w, "take_ns", ["bid_price", "ask_price"]), ["session_id"], "take_ns", "t", "seq", ["bid_price", "ask_price"]).drop("sample_time")
    w = trading_at(w, "take_ns", statuses, "take_status")
    w = w.withColumn("take_price", F.when(F.col("take_ns").isNotNull(), _opposite(F.col("side"), "bid_price", "ask_price")))
    takes = F.col("take_price").isNotNull() & (F.col("take_status") == "TRADING")
    exec_ns = F.when(F.col("marketable"), F.col("x0")).when(F.col("filled"), F.col("fill.t")).when(takes, F.col("take_ns"))
    price = F.when(F.col("marketable"), F.col("x0_price")).when(F.col("filled"), F.col("limit")).when(takes, F.col("take_price"))
    how = F.when(F.col("marketable"), "AGGRESSIVE").when(F.col("filled"), F.col("fill.m")).when(takes, "AGGRESSIVE")
    return w.withColumns({"exec_ns": exec_ns, "exec_price": price, "mechanism": how}).drop("bid_price", "ask_price")


def outcomes(found: DataFrame, reference: DataFrame, unevaluable: DataFrame, last_valid: DataFrame) -> DataFrame:
    """Status and costs of ``worlds``. ``reference`` is (task_id, m0_mid2); ``unevaluable`` is
    (session_id, arrival_ns, deadline_ns, reason); ``last_valid`` is (task_id, m_t_mid2). A fill after the
    deadline does not count; what cannot be evaluated has no cost."""
    rows = found.join(reference, "task_id").join(unevaluable.select("session_id", "arrival_ns", "deadline_ns", "reason").distinct(), ["session_id", "arrival_ns", "deadline_ns"], "left").join(last_valid, "task_id", "left")
    s = F.when(F.col("side") == "B", 1).otherwise(-1)
    done = F.coalesce(F.col("exec_ns") <= F.col("deadline_ns"), F.lit(False))
    status = F.when(F.col("reason").isNotNull() | F.col("reset"), "TECHNICALLY_UNEVALUABLE").when(done, "COMPLETED_ON_TIME").otherwise("DEADLINE_MISS")
    cost = s * (2 * F.col("exec_price") - F.col("m0_mid2")) / (2.0 * TICK)
    rest = s * (F.col("m_t_mid2") - F.col("m0_mid2")) / (2.0 * TICK)
    rows = rows.withColumn("status", status)
    return rows.select(
        *KEY, "status", "checkpoint_eligible", F.when(done, F.col("exec_ns")).alias("completion_ns"), F.when(done, F.col("exec_price")).alias("price_fixed"), F.when(done, F.col("mechanism")).alias("mechanism"),
        F.when(F.col("status") == "COMPLETED_ON_TIME", cost).alias("is_ticks"), F.when(F.col("status") != "TECHNICALLY_UNEVALUABLE", F.when(done, cost).otherwise(rest)).alias("deadline_cost_ticks"),
        F.coalesce("reason", F.when(F.col("reset"), "OVERLAY_TECHNICAL_RESET")).alias("reason"),
    )


#: A market that is never halted.
NO_HALTS = "select null::varchar as session_id, 0::bigint as t, 0::bigint as seq, 'TRADING' as status where false"


def worlds_sql(policies=POLICIES, rule: str = "false", told: str = "", halts: str = NO_HALTS) -> str:
    """The oracle; ``rule`` says where a price rule switches, over what ``told`` joins to w6; ``halts`` are the
    market's (session_id, t, seq, status)."""
    rows = ", ".join(f"('{p}')" for p in policies)
    return _WORLDS_SQL.replace("{policies}", rows).replace("{rule}", rule).replace("{told}", told).replace("{halts}", halts)


def _status_at(probe: str, at: str) -> str:
    return f"coalesce((select h.status from halts h where h.session_id = {probe}.session_id and h.t <= {at} order by h.t desc, h.seq desc limit 1), 'TRADING')"


_WORLDS_SQL = f"""
halts as ({{halts}}),
stints as (select session_id, order_id, side, price_fixed, priority, min(ord_from) as ord_from, max(ord_to) as ord_to from intervals group by 1, 2, 3, 4, 5),
good as (select e.session_id, e.batch_id, b.proxy_time_ns as t from evidence e join batches b using (session_id, batch_id) where not e.invalid and b.quality_flags = '' and e.fills > 0),
fills as (
  select n.session_id, n.side, n.price_fixed, n.source_ordinal as ordinal, g.t from numbered n join good g using (session_id, batch_id)
  where n.action = 'F' and n.quantity > 0 and {_status_at('g', 'g.t')} = 'TRADING'
    and exists (select 1 from intervals i where i.session_id = n.session_id and i.ord_from < n.source_ordinal and i.ord_to >= n.source_ordinal and i.order_id = n.order_id and i.side = n.side and i.price_fixed = n.price_fixed and i.quantity >= n.quantity)
    and n.price_fixed = (select case when n.side = 'B' then max(i.price_fixed) else min(i.price_fixed) end from intervals i where i.session_id = n.session_id and i.ord_from < n.source_ordinal and i.ord_to >= n.source_ordinal and i.side = n.side)),
resets as (select session_id, proxy_time_ns as t, first_ordinal as ordinal from batches where kind = 'INITIALIZATION' or has_clear),
spec(scenario_id, d, c, ce, r) as (values ('L1', 0, 50000, 300000, 250000), ('L6', 1000000, 500000, 3000000, 2500000)),
w0 as (
  select g.session_id || ':' || g.k || ':' || s.side as task_id, g.session_id, s.side, g.arrival_ns, g.deadline_ns, p.policy_id, x.scenario_id, x.c, x.ce, x.r,
    g.arrival_ns + x.ce as x0, (g.arrival_ns + g.deadline_ns) // 2 as checkpoint_ns, g.deadline_ns - (3 * x.ce + 2 * x.r + 1) as cutoff_ns, g.arrival_ns - x.d as seen_ns
  from grid g, (values ('B'), ('A')) s(side), (values {{policies}}) p(policy_id), spec x),
market as (select q.session_id, q.proxy_time_ns as t, q.batch_id as seq, q.bid_price, q.ask_price, b.last_ordinal from quotes q join batches b using (session_id, batch_id)),
seen as (select q.session_id, b.capture_time_ns as t, q.batch_id as seq, q.bid_price, q.ask_price from quotes q join batches b using (session_id, batch_id)),
w1 as (
  select w.*, case when policy_id <> 'B0' then case when side = 'B' then c.bid_price else c.ask_price end end as lim, case when side = 'B' then m.ask_price else m.bid_price end as x0_price, m.last_ordinal
  from w0 w left join lateral (select * from seen m where m.session_id = w.session_id and m.t <= w.seen_ns order by t desc, seq desc limit 1) c on true
    left join lateral (select * from market m where m.session_id = w.session_id and m.t <= w.x0 order by t desc, seq desc limit 1) m on true),
w2 as (select *, x0_status = 'TRADING' and coalesce(lim is not null and case when side = 'B' then lim >= x0_price else lim <= x0_price end, false) as marketable, lim is not null and x0_status <> 'TRADING' as rejected from (select w1.*, {_status_at('w1', 'w1.x0')} as x0_status from w1)),
w3 as (
  select *, lim is not null and not marketable and not rejected as working, greatest(cutoff_ns, x0 + r) + ce as last_cancel,
    (select max(ord_to) from stints s where s.session_id = w2.session_id and s.side = w2.side and s.price_fixed = w2.lim and s.ord_from <= w2.last_ordinal and s.ord_to > w2.last_ordinal) as clear_ordinal from w2),
w4 as (
  select w.*, f.ordinal as f_ordinal, f.t as f_t, f.price_fixed as f_price, z.ordinal as z_ordinal, z.t as z_t
  from w3 w left join lateral (select * from fills f where w.working and f.session_id = w.session_id and f.side = w.side and f.t > w.x0 and f.t <= w.last_cancel and (w.clear_ordinal is null or f.ordinal > w.clear_ordinal)
      and (f.price_fixed = w.lim or case when w.side = 'B' then f.price_fixed < w.lim else f.price_fixed > w.lim end) order by ordinal limit 1) f on true
    left join lateral (select * from resets z where w.working and z.session_id = w.session_id and z.t > w.x0 and z.t <= w.last_cancel order by ordinal limit 1) z on true),
w5 as (select *, z_ordinal is not null and (f_ordinal is null or z_ordinal < f_ordinal) as lost from w4),
w6 as (select *, coalesce(working and x0 + r <= checkpoint_ns and not (coalesce(f_t + r <= checkpoint_ns, false) and not lost) and not (lost and z_t + r <= checkpoint_ns), false) as checkpoint_eligible from w5),
w7 as (select w6.*, greatest(case when checkpoint_eligible and (policy_id = 'PROBE_SWITCH' or {{rule}}) then checkpoint_ns else cutoff_ns end, x0 + r) + ce as cancel_ns from w6 {{told}}),
w8 as (select *, working and coalesce(f_t <= cancel_ns and not lost, false) as filled, working and lost and coalesce(z_t <= cancel_ns, false) as technical from w7),
w9 as (select *, case when policy_id = 'B0' then x0 when lim is null then cutoff_ns + ce when rejected then greatest(cutoff_ns, x0 + r) + ce when working and not filled and not technical then cancel_ns + r + ce end as take_ns from w8),
w10 as (
  select w.*, greatest(cancel_ns - ce, x0 + r) as decide_ns, case when side = 'B' then m.ask_price else m.bid_price end as offered, {_status_at('w', 'w.take_ns')} as take_status from w9 w
    left join lateral (select * from market m where m.session_id = w.session_id and m.t <= w.take_ns order by t desc, seq desc limit 1) m on true),
found as (select *, case when take_status = 'TRADING' then offered end as take_price from w10),
worlds as (
  select task_id, policy_id, scenario_id, session_id, side, arrival_ns, deadline_ns, lim as "limit", checkpoint_eligible,
    case when marketable then x0 when filled then f_t when take_ns is not null and take_price is not null then take_ns end as exec_ns,
    case when marketable then x0_price when filled then lim when take_ns is not null then take_price end as exec_price,
    case when marketable then 'AGGRESSIVE' when filled then case when f_price = lim then 'QUEUE_DEPLETION' else 'TRADE_THROUGH' end when take_ns is not null and take_price is not null then 'AGGRESSIVE' end as mechanism, technical as reset
  from found)
"""

WORLDS_SQL = worlds_sql()
