"""Queries over the tape of ``events``: batches, book, timelines, features, tasks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import asof as asofs
from tapeloom.operators import batches as B
from tapeloom.operators import book, flow, quality
from tapeloom.operators import tasks as T
from tapeloom.operators import worlds as W
from tapeloom.sources.schemas import THETAS
from tapeloom.sources.tables import written
from tapeloom.sources.tape import TAPE_SQL, load, tape

#: The test tables' events lie minutes apart, so their windows are hours.
HOUR = 3_600_000_000_000
MARKOUTS, MAX_AGE = [60_000_000_000, 600_000_000_000, HOUR], HOUR // 2


class Market:
    """The tables that a session's records give, each built from the one before. With ``settle`` those
    that are read often are written once; without, a plan that reads one twice computes it twice."""

    def __init__(self, spark: SparkSession, sf_dir: str, settle: bool = True):
        self.spark, self.records = spark, tape(spark, sf_dir)
        keep = written if settle else lambda df: df
        self.numbered = B.number_batches(self.records, keep if settle else None)
        self.batches = keep(B.assemble(self.numbered))
        self.keep, self.made = keep, {}

    def _made(self, name: str, build) -> DataFrame:
        """For what is cheap to work out of a written table and a small one."""
        if name not in self.made:
            self.made[name] = build()
        return self.made[name]

    def _once(self, name: str, build) -> DataFrame:
        return self._made(name, lambda: self.keep(build()))

    @property
    def epochs(self) -> DataFrame:
        return self._made("epochs", lambda: book.with_epoch(self.numbered, self.batches, self.keep))

    @property
    def states(self) -> DataFrame:
        return self._once("states", lambda: book.order_state(self.epochs))

    @property
    def intervals(self) -> DataFrame:
        return self._made("intervals", lambda: book.order_intervals(self.states, self.epochs, self.keep))

    @property
    def resting(self) -> DataFrame:
        return book.resting_at(self.intervals, self.batches)

    @property
    def changes(self) -> DataFrame:
        return self._once("changes", lambda: book.level_changes(self.intervals))

    def depth(self, top: int | None = None) -> DataFrame:
        return book.level_depth(self.changes, self.batches, top)

    @property
    def timed(self) -> DataFrame:
        """Quotes with the time of delivery and the last record of their batch."""
        return self._once("timed", lambda: book.quotes_after(self.changes, self.batches, "capture_time_ns", "last_ordinal"))

    @property
    def quotes(self) -> DataFrame:
        return self.timed.drop("capture_time_ns", "last_ordinal")

    @property
    def evidence(self) -> DataFrame:
        return self._once("evidence", lambda: B.execution_groups(self.numbered, self.batches))

    @property
    def judged(self) -> DataFrame:
        return self._once("judged", lambda: quality.judged_batches(self.batches, self.states.filter("anomaly is not null"), self.evidence))

    @property
    def mids(self) -> DataFrame:
        """The market's mid timeline, by batch time."""
        return self.quotes.select("session_id", F.col("proxy_time_ns").alias("t"), F.col("batch_id").alias("seq"), "mid2")

    @property
    def client_mids(self) -> DataFrame:
        """The client's, by the time at which a batch is complete."""
        return self.timed.select("session_id", F.col("capture_time_ns").alias("t"), F.col("batch_id").alias("seq"), "mid2")

    def grid_of(self, horizon_ns: int) -> DataFrame:
        sessions = self.numbered.groupBy("session_id").agg(F.min("event_time_ns").alias("start_ns"), F.max("event_time_ns").alias("end_ns"))
        return T.arrival_grid(sessions, horizon_ns)

    @property
    def grid(self) -> DataFrame:
        return self._once("grid", lambda: self.grid_of(HOUR))

    @property
    def signals(self) -> DataFrame:
        """What a price rule without a model goes by: the imbalance at the best prices, as delivered."""
        return self.timed.select("session_id", F.col("capture_time_ns").alias("t"), F.col("batch_id").alias("seq"), F.col("imbalance_1").alias("signal"))

    @property
    def live_quotes(self) -> DataFrame:
        return self.timed.filter("kind = 'LIVE'").drop("last_ordinal").withColumnRenamed("capture_time_ns", "obs_ns")


SQL = f"with recursive {TAPE_SQL}, {B.BATCH_SQL}"
BOOK = f"{SQL}, {book.BOOK_SQL}"


def _grid_sql(horizon: int) -> str:
    gap = max(10_000_000_000, 2 * horizon)
    return f"""{BOOK},
sessions as (select session_id, min(event_time_ns) as start_ns, max(event_time_ns) as end_ns from tape group by 1),
phased as (select session_id, start_ns + 1000000000 + cast('0x' || substr(sha256(session_id), 1, 8) as bigint) % {gap} as first, end_ns - {horizon} - 1000000000 as final from sessions),
grid as (select session_id, k, first + k * {gap} as arrival_ns, first + k * {gap} + {horizon} as deadline_ns
  from (select session_id, first, unnest(range(0, (final - first) // {gap} + 1)) as k from phased where first <= final)),
mids as (select session_id, proxy_time_ns as t, batch_id as seq, mid2 from quotes),
client as (select q.session_id, b.capture_time_ns as t, q.batch_id as seq, q.mid2 from quotes q join batches b using (session_id, batch_id))"""


GRID = _grid_sql(HOUR)


def _last(source: str, probe: str, at: str, valid: bool = False) -> str:
    """The oracle's as-of: a lateral look back."""
    return f"""left join lateral (select m.mid2, m.t from {source} m where m.session_id = {probe}.session_id and m.t <= {at}
      {'and m.mid2 is not null' if valid else ''} order by m.t desc, m.seq desc limit 1) l on true"""


def _flows(m: Market) -> DataFrame:
    return flow.batch_flow(m.numbered, m.batches)


def _tasks(m: Market) -> DataFrame:
    return m.grid.select("session_id", "k", "arrival_ns", "deadline_ns")


def _fills(m: Market) -> DataFrame:
    at = m.grid.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    return at.select(F.concat_ws(":", "session_id", "k", "side").alias("fill_id"), "session_id", "side", F.col("arrival_ns").alias("fill_ns"), F.lit(100_000_000_000).cast("long").alias("price_fixed"))


def _markouts(m: Market) -> DataFrame:
    intervals = quality.invalid_intervals(m.judged)
    return T.markouts(_fills(m), m.mids, lambda w: quality.unevaluable(w, intervals, m.judged), MARKOUTS, MAX_AGE)


EVIDENCE = f"{BOOK}, {B.EVIDENCE_SQL}, {quality.QUALITY_SQL}"
UNEVALUABLE = """coalesce((select arg_min(i.reason, i.start_ns) from bad i where i.session_id = {w}.session_id and i.end_ns > i.start_ns and {lo} < i.end_ns and {hi} >= i.start_ns),
    (select 'SNAPSHOT_RESET' from judged j where j.session_id = {w}.session_id and j.init and {lo} < j.proxy_time_ns and j.proxy_time_ns <= {hi} limit 1))"""
MARKOUT_SQL = f"""{GRID}, {B.EVIDENCE_SQL}, {quality.QUALITY_SQL},
fills as (select session_id || ':' || k || ':' || side as fill_id, session_id, side, arrival_ns as fill_ns, h as horizon_ns, arrival_ns + h as target_ns
  from grid, (values (1), (-1)) s(side), (values ({MARKOUTS[0]}::bigint), ({MARKOUTS[1]}::bigint), ({MARKOUTS[2]}::bigint)) x(h)),
looked as (
  select f.*, s.mid2 as state_mid2, v.mid2 as mid2, f.target_ns - v.t as age, (select max(t) from mids m where m.session_id = f.session_id) as last_t, {UNEVALUABLE.format(w='f', lo='f.fill_ns', hi='f.target_ns')} as lost
  from fills f left join lateral (select mid2 from mids m where m.session_id = f.session_id and m.t <= f.target_ns order by t desc, seq desc limit 1) s on true
    left join lateral (select mid2, t from mids m where m.session_id = f.session_id and m.t <= f.target_ns and m.mid2 is not null order by t desc, seq desc limit 1) v on true),
marked as (
  select *, case when last_t is null or target_ns > last_t then 'OUTSIDE_COVERAGE' when lost is not null then 'SOURCE_DISCONTINUITY' when state_mid2 is null then 'INVALID_STATE' when age > {MAX_AGE} then 'STALE_REFERENCE' end as missing_reason from looked),
markouts as (select fill_id, session_id, side, horizon_ns, target_ns, case when missing_reason is null then side * (mid2 - 200000000000) / 500000000.0 end::double as markout_ticks, missing_reason from marked)"""


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("instrument_id"), F.col("l_linenumber").cast("long").alias("source_ordinal"), F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("tie"))
    found = B.duplicate_records(lines, ["instrument_id", "source_ordinal"], "DUPLICATE_ORDINAL")
    return found.groupBy("kind", "source_ordinal", "first_seen").agg(F.count("*").alias("n"))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir).withColumn("half", F.expr("source_ordinal div 80"))
    windows = rows.groupBy("half", (F.col("order_id") % 5).alias("instrument_id")).agg(F.min("event_time_ns").alias("start_ns"), (F.max("event_time_ns") + HOUR // 3).alias("end_ns")).withColumnRenamed("half", "id")
    return B.overlapping_windows(windows, HOUR // 3)


def _sided(grid: DataFrame) -> DataFrame:
    """Both tasks of each arrival; a grid of several horizons names them too."""
    names = ["session_id", "k", "side", *(c for c in grid.columns if c == "horizon_ns")]
    return grid.withColumn("side", F.explode(F.array(F.lit("B"), F.lit("A")))).withColumn("task_id", F.concat_ws(":", *names))


def _worlds(m: Market, grid: DataFrame | None = None, run=W.worlds, scenarios=("L1", "L6"), policies=W.POLICIES, thetas: dict | None = None, statuses: DataFrame | None = None, choices: DataFrame | None = None, signals: DataFrame | None = None) -> DataFrame:
    """Every arrival's two tasks under each policy, in the primary and the slowest scenario."""
    tasks = _sided(m.grid if grid is None else grid).select("task_id", "session_id", "side", "arrival_ns", "deadline_ns")
    pick = lambda t, *more: m.timed.select("session_id", F.col(t).alias("t"), F.col("batch_id").alias("seq"), "bid_price", "ask_price", *more)
    intervals = m.intervals
    resets = m.batches.filter("kind = 'INITIALIZATION' or has_clear").select("session_id", F.col("proxy_time_ns").alias("t"), F.col("first_ordinal").alias("ordinal"))
    fills = W.resting_fills(m.numbered, m.batches, m.evidence, intervals)
    return run(tasks, pick("proxy_time_ns", "last_ordinal"), pick("capture_time_ns"), intervals, fills, resets, scenarios=scenarios, policies=policies, keep=m.keep, thetas=thetas, signals=m.signals if signals is None else signals, statuses=statuses, choices=choices)


def _outcomes(m: Market, grid: DataFrame | None = None, **of) -> DataFrame:
    """Costs against the market's mid at arrival, with quality verdicts."""
    grid = m.grid if grid is None else grid
    both = grid.select("session_id", F.explode(F.array("arrival_ns", "deadline_ns")).alias("t"))
    mids = W.thinner(grid, 2)(m.mids, both, "t", ["mid2"], "mid2")
    at = asofs.asof(grid, mids, ["session_id"], "arrival_ns", "t", "seq", ["mid2"], skip_null="mid2").withColumnRenamed("mid2", "m0_mid2").drop("sample_time")
    end = asofs.asof(at, mids, ["session_id"], "deadline_ns", "t", "seq", ["mid2"], skip_null="mid2")
    named = _sided(end).select("task_id", "m0_mid2", F.col("mid2").alias("m_t_mid2"))
    probes = grid.select("session_id", "k", "arrival_ns", "deadline_ns")
    verdicts = quality.unevaluable(probes, quality.invalid_intervals(m.judged), m.judged).filter("reason is not null")
    return W.outcomes(_worlds(m, grid, **of), named.select("task_id", "m0_mid2"), verdicts, named.select("task_id", "m_t_mid2"))


#: Horizons beside the primary one; the first is too short for a checkpoint under the slowest scenario.
LADDER = (20_000_000, HOUR // 2, HOUR, 2 * HOUR)
OTHERS = [h for h in T.valid_horizons(LADDER, ("L1", "L6")) if h != HOUR]


RULES = {f"B2:{theta}": theta for theta in THETAS}


def _trials(m: Market) -> DataFrame:
    """Each session's evaluable tasks under each price rule, in the primary scenario."""
    found = _outcomes(m, scenarios=("L1",), policies=tuple(RULES), thetas=RULES).filter("status <> 'TECHNICALLY_UNEVALUABLE'")
    return found.groupBy(F.substring_index("task_id", ":", 1).alias("session_id"), "policy_id").agg(
        F.count("*").alias("n_evaluable"), F.count_if(F.col("status") == "DEADLINE_MISS").alias("n_missed"), F.count_if("checkpoint_eligible").alias("n_choices"),
        F.round(F.avg("deadline_cost_ticks"), 9).alias("mean_cost_ticks"))


def _sensitivity(m: Market) -> DataFrame:
    """Every task's outcome at the other valid horizons, policies without models, primary scenario."""
    grids = [m.grid_of(h).withColumn("horizon_ns", F.lit(h).cast("long")) for h in OTHERS]
    grid = m.keep(functools.reduce(DataFrame.unionByName, grids))
    found = _outcomes(m, grid, scenarios=("L1",), policies=("B0", "B1"))
    return found.select(F.substring_index("task_id", ":", -1).cast("long").alias("horizon_ns"), F.regexp_replace("task_id", ":[0-9]+$", "").alias("task_id"), "policy_id", "status", "is_ticks", "deadline_cost_ticks")


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading states of the tape: some of its events halt a session, others resume it."""
    ns = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") * 1000
    rows = load(spark, sf_dir, "events").filter("event_id % 5 = 0 and event_type in ('error', 'signup')")
    status = F.when(F.col("event_type") == "error", "HALTED").otherwise("TRADING")
    return rows.select(F.col("ts").cast("date").cast("string").alias("session_id"), F.col("event_id").alias("seq"), status.alias("status"), ns.alias("event_time_ns"), (ns + 2_000_000).alias("capture_time_ns"))


def _client_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = T.delivery_probes(Market(spark, sf_dir, settle=False).grid)
    return T.status_at(probes, "at_ns", _statuses(spark, sf_dir), "capture_time_ns")


QUERIES = {
    "batch_assembly": lambda s, d: Market(s, d, settle=False).batches.select("session_id", "batch_id", "n_records", "proxy_time_ns", "capture_time_ns", "kind"),
    "batch_quality_flags": lambda s, d: Market(s, d, settle=False).batches.groupBy("kind", "quality_flags").agg(F.count("*").alias("n_batches"), F.sum("n_records").alias("n_records")),
    "duplicate_records": duplicates,
    "overlapping_windows": overlaps,
    "execution_groups": lambda s, d: Market(s, d, settle=False).evidence,
    "order_state": lambda s, d: Market(s, d).states.drop("anomaly", "batch_id", "next_ordinal", "next_batch"),
    "book_anomalies": lambda s, d: Market(s, d).states.filter("anomaly is not null").groupBy("session_id", "anomaly").agg(F.count("*").alias("n"), F.min("source_ordinal").alias("first_ordinal")),
    "level_depth": lambda s, d: Market(s, d).depth(10),
    "best_quotes": lambda s, d: Market(s, d).quotes.drop("depth_bid_3", "depth_ask_3", "imbalance_1", "imbalance_3"),
    "imbalance_depth": lambda s, d: Market(s, d).quotes.select("session_id", "batch_id", "depth_bid_3", "depth_ask_3", F.round("imbalance_1", 9).alias("imbalance_1"), F.round("imbalance_3", 9).alias("imbalance_3")),
    "queue_ahead": lambda s, d: book.queue_ahead(Market(s, d).resting),
    "mid_timeline": lambda s, d: Market(s, d).mids,
    "asof_state": lambda s, d: (lambda m: asofs.asof(_tasks(m), m.mids, ["session_id"], "arrival_ns", "t", "seq", ["mid2"]))(Market(s, d)),
    "asof_last_valid": lambda s, d: (lambda m: asofs.asof(_tasks(m), m.mids, ["session_id"], "arrival_ns", "t", "seq", ["mid2"], skip_null="mid2"))(Market(s, d)),
    "asof_shifted": lambda s, d: (lambda m: T.shifted_asof(m.grid, m.client_mids).drop("sample_time"))(Market(s, d)),
    "true_cancels": lambda s, d: _flows(Market(s, d, settle=False)),
    "trailing_flow": lambda s, d: flow.trailing_flow(_flows(Market(s, d, settle=False)), HOUR),
    "mid_vol_change": lambda s, d: (lambda x: flow.mid_moves(x.filter("mid2 is not null").select("session_id", "batch_id", "obs_ns", "mid2"), 5 * HOUR, HOUR).withColumn("mid_vol", F.round("mid_vol", 9)))(Market(s, d).live_quotes),
    "quote_age": lambda s, d: flow.quote_age(Market(s, d).live_quotes).withColumn("quote_age_ms", F.round("quote_age_ms", 6)),
    "quality_intervals": lambda s, d: quality.invalid_intervals(Market(s, d).judged),
    "unevaluable_tasks": lambda s, d: (lambda m: quality.unevaluable(_tasks(m), quality.invalid_intervals(m.judged), m.judged))(Market(s, d)),
    "arrival_grid": lambda s, d: Market(s, d, settle=False).grid,
    "task_manifest": lambda s, d: (lambda m: T.task_manifest(m.grid, m.mids, m.client_mids))(Market(s, d)),
    "price_labels": lambda s, d: (lambda m: T.price_labels(m.grid, m.mids, HOUR // 2))(Market(s, d)),
    "markouts": lambda s, d: _markouts(Market(s, d)),
    "batch_status": lambda s, d: T.status_at(Market(s, d, settle=False).batches.select("session_id", "batch_id", "proxy_time_ns"), "proxy_time_ns", _statuses(s, d), "event_time_ns"),
    "client_status": _client_status,
    "validation_trials": lambda s, d: _trials(Market(s, d)),
    "horizon_sensitivity": lambda s, d: _sensitivity(Market(s, d)),
    "worlds": lambda s, d: _worlds(Market(s, d)),
    "world_outcomes": lambda s, d: _outcomes(Market(s, d)),
    "markout_summary": lambda s, d: T.summarize_markouts(_markouts(Market(s, d)), ["side", "horizon_ns"]).withColumns({"mean_markout_ticks": F.round("mean_markout_ticks", 9), "median_markout_ticks": F.round("median_markout_ticks", 9)}),
}

_FLOW = """flows as (
  select b.session_id, b.batch_id, b.capture_time_ns as obs_ns,
    (coalesce(sum(quantity) filter (action = 'T' and side = 'B'), 0) - coalesce(sum(quantity) filter (action = 'T' and side = 'A'), 0))::bigint as trade_signed,
    count(*) filter (action = 'T')::bigint as trade_count, coalesce(sum(quantity) filter (action = 'C' and side = 'B' and not executed), 0)::bigint as cancel_bid,
    coalesce(sum(quantity) filter (action = 'C' and side = 'A' and not executed), 0)::bigint as cancel_ask,
    coalesce(sum(quantity) filter (action = 'A' and side = 'B'), 0)::bigint as add_bid, coalesce(sum(quantity) filter (action = 'A' and side = 'A'), 0)::bigint as add_ask
  from batches b join (select *, coalesce(lag(action) over w = 'F' and lag(order_id) over w = order_id, false) as executed from numbered
    window w as (partition by session_id, batch_id order by source_ordinal)) n using (session_id, batch_id)
  where b.kind = 'LIVE' group by 1, 2, 3)"""
_LIVE = "live as (select q.*, b.capture_time_ns as obs_ns from quotes q join batches b using (session_id, batch_id) where b.kind = 'LIVE')"
_FRAME = "range between {} preceding and current row"

def _outcomes_sql(grid: str, worlds: str = W.WORLDS_SQL) -> str:
    return f"""{grid}, {B.EVIDENCE_SQL}, {quality.QUALITY_SQL}, {worlds},
      priced as (
        select w.*, case when side = 'B' then 1 else -1 end as s, coalesce(exec_ns <= deadline_ns, false) as done, a.mid2 as m0, z.mid2 as mt, {UNEVALUABLE.format(w='w', lo='w.arrival_ns', hi='w.deadline_ns')} as bad_reason
        from worlds w left join lateral (select mid2 from mids m where m.session_id = w.session_id and m.t <= w.arrival_ns and m.mid2 is not null order by t desc, seq desc limit 1) a on true
          left join lateral (select mid2 from mids m where m.session_id = w.session_id and m.t <= w.deadline_ns and m.mid2 is not null order by t desc, seq desc limit 1) z on true),
      judged2 as (select *, case when bad_reason is not null or reset then 'TECHNICALLY_UNEVALUABLE' when done then 'COMPLETED_ON_TIME' else 'DEADLINE_MISS' end as status from priced)
      select task_id, policy_id, scenario_id, status, checkpoint_eligible, case when done then exec_ns end as completion_ns, case when done then exec_price end as price_fixed, case when done then mechanism end as mechanism,
        case when status = 'COMPLETED_ON_TIME' then s * (2 * exec_price - m0) / 500000000.0 end::double as is_ticks,
        case when status <> 'TECHNICALLY_UNEVALUABLE' then case when done then s * (2 * exec_price - m0) / 500000000.0 else s * (mt - m0) / 500000000.0 end end::double as deadline_cost_ticks,
        coalesce(bad_reason, case when reset then 'OVERLAY_TECHNICAL_RESET' end) as reason from judged2"""


_RULED = W.worlds_sql(
    tuple(RULES), "coalesce(case when side = 'B' then 1 else -1 end * sg.signal > cast(substr(policy_id, 4) as double), true)",
    """left join lateral (select q.imbalance_1 as signal from quotes q join batches b using (session_id, batch_id)
      where q.session_id = w6.session_id and b.capture_time_ns <= w6.checkpoint_ns - (w6.arrival_ns - w6.seen_ns) order by b.capture_time_ns desc, q.batch_id desc limit 1) sg on true""")  # fmt: skip
_STATUS = """statuses as (select cast(ts::date as varchar) as session_id, event_id as seq, case when event_type = 'error' then 'HALTED' else 'TRADING' end as status,
    epoch_us(ts) * 1000 as event_time_ns, epoch_us(ts) * 1000 + 2000000 as capture_time_ns from events where event_id % 5 = 0 and event_type in ('error', 'signup'))"""


def _status_sql(probe: str, at: str, time: str) -> str:
    return f"""select p.*, coalesce(l.status, 'TRADING') as status from {probe} p
      left join lateral (select status from statuses s where s.session_id = p.session_id and s.{time} <= p.{at} order by s.{time} desc, s.seq desc limit 1) l on true"""


ORACLE_SQL = {
    "batch_assembly": f"{SQL} select session_id, batch_id, n_records, proxy_time_ns, capture_time_ns, kind from batches",
    "batch_quality_flags": f"{SQL} select kind, quality_flags, count(*)::bigint as n_batches, sum(n_records)::bigint as n_records from batches group by 1, 2",
    "duplicate_records": """select 'DUPLICATE_ORDINAL' as kind, l_linenumber::bigint as source_ordinal, l_linenumber::bigint as first_seen, sum(n - 1)::bigint as n
      from (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1) group by 1, 2, 3""",
    "overlapping_windows": f"""with {TAPE_SQL}, w as (select source_ordinal // 80 as id, order_id % 5 as instrument_id, min(event_time_ns) as s, max(event_time_ns) + {HOUR // 3} as e from tape group by 1, 2)
      select a.instrument_id, a.id as a_id, b.id as b_id from w a join w b on a.instrument_id = b.instrument_id and a.id < b.id and a.s <= b.e and b.s <= a.e""",
    "execution_groups": f"{SQL}, {B.EVIDENCE_SQL} select e.session_id, e.batch_id, n_groups, n_valid, invalid, case when invalid or quality_flags <> '' then 0 else fills end::bigint as n_allocations from evidence e join batches using (session_id, batch_id)",
    "order_state": f"{BOOK} select s.session_id, s.epoch, s.order_id, s.source_ordinal, o.action, s.alive, s.side, s.price as price_fixed, s.qty as quantity, s.prio as priority from states s join own o using (session_id, source_ordinal)",
    "book_anomalies": f"{BOOK} select session_id, anomaly, count(*)::bigint as n, min(source_ordinal) as first_ordinal from states where anomaly is not null group by 1, 2",
    "level_depth": f"{BOOK} select * from depth where level <= 10",
    "best_quotes": f"{BOOK} select session_id, batch_id, proxy_time_ns, kind, bid_price, bid_qty, ask_price, ask_qty, mid2 from quotes",
    "imbalance_depth": f"{BOOK} select session_id, batch_id, depth_bid_3, depth_ask_3, round(imbalance_1, 9) as imbalance_1, round(imbalance_3, 9) as imbalance_3 from quotes",
    "queue_ahead": f"{BOOK} select session_id, batch_id, order_id, coalesce(sum(quantity) over (partition by session_id, batch_id, side, price_fixed order by priority rows between unbounded preceding and 1 preceding), 0)::bigint as ahead from resting",
    "mid_timeline": f"{BOOK} select session_id, proxy_time_ns as t, batch_id as seq, mid2 from quotes",
    "asof_state": f"{GRID} select g.session_id, g.k, g.arrival_ns, g.deadline_ns, l.mid2, l.t as sample_time from grid g {_last('mids', 'g', 'g.arrival_ns')}",
    "asof_last_valid": f"{GRID} select g.session_id, g.k, g.arrival_ns, g.deadline_ns, l.mid2, l.t as sample_time from grid g {_last('mids', 'g', 'g.arrival_ns', True)}",
    "asof_shifted": f"""{GRID}, probes as (select session_id, k, 'L' || n as scenario_id, arrival_ns - case when n in (2, 6) then 1000000 else 0 end as at_ns from grid, range(0, 7) r(n))
      select g.session_id, g.k, g.scenario_id, g.at_ns, l.mid2 from probes g {_last('client', 'g', 'g.at_ns')}""",
    "true_cancels": f"{SQL}, {_FLOW} select * from flows",
    "trailing_flow": f"{SQL}, {_FLOW} select session_id, batch_id, obs_ns, " + ", ".join(f"sum({c}) over w::bigint as {c}" for c in ("trade_signed", "trade_count", "cancel_bid", "cancel_ask", "add_bid", "add_ask")) + f" from flows window w as (partition by session_id order by obs_ns {_FRAME.format(HOUR - 1)})",
    "mid_vol_change": f"""{BOOK}, {_LIVE}, valid as (select *, row_number() over (partition by session_id order by obs_ns, batch_id) as i from live where mid2 is not null),
      moves as (select v.*, (v.mid2 - lag(v.mid2) over (partition by session_id order by i)) / 500000000.0 as change, lag(obs_ns) over (partition by session_id order by i) as prev_obs from valid v)
      select v.session_id, v.batch_id, v.obs_ns, round(coalesce((select stddev_pop(m.change) from moves m where m.session_id = v.session_id and m.obs_ns <= v.obs_ns and m.prev_obs > v.obs_ns - {5 * HOUR}), 0), 9)::double as mid_vol,
        ((v.mid2 - first_value(v.mid2) over (partition by v.session_id order by v.obs_ns {_FRAME.format(HOUR - 1)})) / 500000000.0)::double as mid_change from valid v""",
    "quote_age": f"""{BOOK}, {_LIVE}, seen as (select *, lag(batch_id) over w as before, (bid_price, bid_qty, ask_price, ask_qty) is distinct from lag((bid_price, bid_qty, ask_price, ask_qty)) over w as differs from live window w as (partition by session_id order by obs_ns, batch_id)),
      told as (select *, case when case when before is null then bid_price is not null or ask_price is not null else differs end then obs_ns end as changed_ns from seen)
      select session_id, batch_id, round(coalesce(greatest(obs_ns - last_value(changed_ns ignore nulls) over (partition by session_id order by obs_ns, batch_id rows between unbounded preceding and current row), 0) / 1000000.0, 0), 6)::double as quote_age_ms from told""",
    "quality_intervals": f"{EVIDENCE} select * from bad",
    "unevaluable_tasks": f"{GRID}, {B.EVIDENCE_SQL}, {quality.QUALITY_SQL} select g.*, {UNEVALUABLE.format(w='g', lo='g.arrival_ns', hi='g.deadline_ns')} as reason from grid g",
    "arrival_grid": f"{GRID} select * from grid",
    "task_manifest": f"""{GRID}, probes as (select *, 'L' || n as scenario_id, arrival_ns - case when n in (2, 6) then 1000000 else 0 end as at_ns from grid, range(0, 7) r(n)),
      lacking as (select g.session_id, g.k, min(g.scenario_id) as lacking from probes g {_last('client', 'g', 'g.at_ns')} where l.mid2 is null group by 1, 2),
      told as (select g.*, l.mid2, lacking from grid g {_last('mids', 'g', 'g.arrival_ns')} left join lacking x on x.session_id = g.session_id and x.k = g.k),
      judged as (select *, case when mid2 is null then 'NO_VALID_HISTORICAL_MID' when lacking is not null then 'NO_CLIENT_MID[' || lacking || ']' end as r from told)
      select case when r is null then session_id || ':' || lpad(k::varchar, 5, '0') || ':' || side end as task_id, session_id, side, arrival_ns, deadline_ns, case when r is null then mid2 end as m0_mid2, r is null as eligible, r as ineligible_reason
      from judged, (values ('BUY'), ('SELL')) s(side)""",
    "price_labels": f"""{GRID}, now as (select g.*, l.mid2 as mid_now from grid g {_last('mids', 'g', 'g.arrival_ns')}), later as (select g.*, l.mid2 from now g {_last('mids', 'g', f'g.arrival_ns + {HOUR // 2}')})
      select session_id, k, case when arrival_ns + {HOUR // 2} <= (select max(t) from mids m where m.session_id = later.session_id) then sign(mid2 - mid_now) end::int as label from later""",
    "markouts": f"{MARKOUT_SQL} select * from markouts",
    "worlds": f"{GRID}, {B.EVIDENCE_SQL}, {W.WORLDS_SQL} select * from worlds",
    "world_outcomes": _outcomes_sql(GRID),
    "validation_trials": f"""select split_part(task_id, ':', 1) as session_id, policy_id, count(*)::bigint as n_evaluable, count(*) filter (status = 'DEADLINE_MISS')::bigint as n_missed,
      count(*) filter (checkpoint_eligible)::bigint as n_choices, round(avg(deadline_cost_ticks), 9) as mean_cost_ticks
      from ({_outcomes_sql(GRID, _RULED)}) where scenario_id = 'L1' and status <> 'TECHNICALLY_UNEVALUABLE' group by 1, 2""",
    "horizon_sensitivity": " union all ".join(f"""select {h}::bigint as horizon_ns, task_id, policy_id, status, is_ticks, deadline_cost_ticks
      from ({_outcomes_sql(_grid_sql(h))}) where policy_id in ('B0', 'B1') and scenario_id = 'L1'""" for h in OTHERS),
    "batch_status": f"{SQL}, {_STATUS}, probes as (select session_id, batch_id, proxy_time_ns from batches) {_status_sql('probes', 'proxy_time_ns', 'event_time_ns')}",
    "client_status": f"""{GRID}, {_STATUS}, probes as (select session_id, k, 'L' || n as scenario_id, arrival_ns - case when n in (2, 6) then 1000000 else 0 end as at_ns from grid, range(0, 7) r(n))
      {_status_sql('probes', 'at_ns', 'capture_time_ns')}""",
    "markout_summary": f"""{MARKOUT_SQL} select side, horizon_ns, count(*)::bigint as n_completed, count(markout_ticks)::bigint as n_defined, count(*) filter (markout_ticks is null)::bigint as n_missing,
      count(distinct session_id)::bigint as n_sessions, round(avg(markout_ticks), 9) as mean_markout_ticks, round(median(markout_ticks), 9) as median_markout_ticks from markouts group by 1, 2""",
}
