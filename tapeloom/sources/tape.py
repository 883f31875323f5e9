"""An order-level tape and a study's result table, derived from the general test tables.

The ordinal is event_id * 8 + place, so no global sort is needed to number records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources.schemas import BAD_TS_RECV, LAST, MAYBE_BAD_BOOK, SNAPSHOT, TICK


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: How many events an order of a clean session rests, and events from one book reset to the next.
RESTS, RESET = 6, 499
#: Records of a clean session by number: place, action, flags, what is added to the quantity, and whether they are of
#: the event's own order, not of the one that leaves.
KINDS = [(0, "T", 0, 0, False), (1, "F", 0, 0, False), (2, "C", 0, 0, False), (3, "A", LAST, 0, True), (1, "M", 0, 3, False), (2, "C", 0, 3, False), (0, "R", SNAPSHOT, 0, False), (3, "A", SNAPSHOT | LAST, 0, True)]
TRADE, CLEAR = 0, 6


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records (session_id, source_ordinal, action, side, price_fixed, quantity, order_id,
    event_time_ns, capture_time_ns, flags) of the table ``events``.

    Every sixth day is dirty: orders are reused, flags and times are bad. On the other days an event
    adds an order around a price that wanders, and the order of RESTS events before leaves: it is
    executed, or modified and cancelled, or cancelled.
    """
    ns = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") * 1000
    events = load(spark, sf_dir, "events").select(F.col("ts").cast("date").cast("string").alias("session_id"), F.dayofmonth("ts").alias("day"), "event_id", "user_id", "event_type", "value", ns.alias("ns"))
    return _dirty(events.filter("day % 6 = 0")).unionByName(_clean(events.filter("day % 6 <> 0")))


def _clean(events: DataFrame) -> DataFrame:
    e, k, kind = F.col("event_id"), F.col("of"), F.col("r")
    numbers = lambda *kinds: F.array(*(F.lit(n) for n in kinds))
    leaves = F.col("before").isNotNull() & (F.expr(f"event_id div {RESET}") == F.expr(f"(event_id - {RESTS}) div {RESET}"))
    records = (
        F.when(e % RESET == 0, numbers(CLEAR, 7)).when(~leaves, numbers(3)).when(F.col("event_type").isin("purchase", "click"), numbers(TRADE, 1, 2, 3))
        .when(F.col("event_type") == "view", numbers(4, 5, 3)).otherwise(numbers(2, 3))
    )
    before = events.select("session_id", (e + RESTS).alias("event_id"), F.lit(True).alias("before"))
    # Only numbers are exploded, and a record's columns are worked out from its own.
    rows = events.join(before, ["session_id", "event_id"], "left").select("session_id", "event_id", "ns", F.explode(records).alias("r"))
    of = lambda n: F.get(F.array(*(F.lit(v[n]) for v in KINDS)), kind)
    rows = rows.withColumn("of", F.when(of(4), e).otherwise(e - RESTS))
    side = lambda k: F.when(k % 2 == 0, "B").otherwise("A")
    price = 100_000_000_000 + TICK * F.abs(F.expr("of div 12") % 21 - 10) + F.when(k % 2 == 0, -1).otherwise(1) * TICK * (1 + F.expr("of div 2") % 2)
    none = F.lit(0).cast("long")
    return rows.select(
        "session_id", (e * 8 + of(0)).alias("source_ordinal"), of(1).alias("action"), F.when(kind == CLEAR, "N").when(kind == TRADE, side(k + 1)).otherwise(side(k)).alias("side"),
        F.when(kind == CLEAR, none).otherwise(price).alias("price_fixed"), F.when(kind == CLEAR, none).otherwise(1 + k % 5 + of(3)).alias("quantity"), F.when(kind.isin(TRADE, CLEAR), none).otherwise(k + 1).alias("order_id"),
        F.col("ns").alias("event_time_ns"), (F.col("ns") + (e % 7) * 1000).alias("capture_time_ns"), of(2).cast("long").alias("flags"),
    )


def _dirty(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    own = F.when(F.col("user_id") % 2 == 0, "B").otherwise("A")
    other = F.when(F.col("user_id") % 2 == 0, "A").otherwise("B")
    order = F.col("user_id") % 20
    one = lambda action, side=own, order=order, sub=0, last=None: F.struct(F.lit(sub).alias("sub"), action.alias("action"), side.alias("side"), order.alias("order_id"), (last if last is not None else e % 3 == 2).alias("last"))
    trade = F.array(one(F.lit("T"), other, F.lit(0).cast("long"), 0, F.lit(False)), one(F.lit("F"), own, order, 1, F.lit(False)), one(F.lit("C"), own, order, 2, F.lit(True)))
    kind = F.col("event_type")
    single = F.when(kind == "view", "M").when(kind == "click", "C").when((kind == "error") & (e % 97 == 0), "R").otherwise("A")
    rows = events.select(
        "session_id",
        "event_id",
        "ns",
        F.when(own == "B", 100_000_000_000 - (e % 5) * TICK).otherwise(100_250_000_000 + (e % 5) * TICK).alias("price_fixed"),
        (1 + F.floor("value") % 20).cast("long").alias("quantity"),
        F.explode(F.when(kind == "purchase", trade).otherwise(F.array(one(single)))).alias("r"),
    )
    bit = lambda held, value: F.when(held, value).otherwise(0)
    flags = bit(F.col("r.last"), LAST) + bit(e % 97 <= 2, SNAPSHOT) + bit(e % 307 == 0, BAD_TS_RECV) + bit(e % 211 == 0, MAYBE_BAD_BOOK)
    return rows.select(
        "session_id", (e * 8 + F.col("r.sub")).alias("source_ordinal"), "r.action", "r.side", "price_fixed", "quantity", "r.order_id",
        F.col("ns").alias("event_time_ns"), (F.col("ns") + (e % 7) * 1000 - F.when(e % 401 == 0, 50_000).otherwise(0)).alias("capture_time_ns"), flags.cast("long").alias("flags"),
    )


TAPE_SQL = f"""
tape_dirty as (
  select cast(cast(ts as date) as varchar) as session_id, event_id * 8 + sub as source_ordinal, action,
    case when swap then case when user_id % 2 = 0 then 'A' else 'B' end else case when user_id % 2 = 0 then 'B' else 'A' end end as side,
    case when user_id % 2 = 0 then 100000000000 - (event_id % 5) * 250000000 else 100250000000 + (event_id % 5) * 250000000 end as price_fixed,
    cast(1 + cast(floor(value) as bigint) % 20 as bigint) as quantity,
    case when swap then 0 else user_id % 20 end as order_id,
    epoch_us(ts) * 1000 as event_time_ns,
    epoch_us(ts) * 1000 + (event_id % 7) * 1000 - case when event_id % 401 = 0 then 50000 else 0 end as capture_time_ns,
    cast(case when closes then 128 else 0 end + case when event_id % 97 <= 2 then 32 else 0 end
      + case when event_id % 307 = 0 then 8 else 0 end + case when event_id % 211 = 0 then 4 else 0 end as bigint) as flags
  from (
    select *, 0 as sub, case event_type when 'view' then 'M' when 'click' then 'C'
        when 'error' then case when event_id % 97 = 0 then 'R' else 'A' end else 'A' end as action, false as swap, event_id % 3 = 2 as closes
      from events where event_type <> 'purchase'
    union all select *, 0, 'T', true, false from events where event_type = 'purchase'
    union all select *, 1, 'F', false, false from events where event_type = 'purchase'
    union all select *, 2, 'C', false, true from events where event_type = 'purchase')
  where day(ts) % 6 = 0),
tape_steps as (
  select a.event_id as e, a.ts, b.event_id as b, a.event_id % {RESET} = 0 as resets,
    b.event_id is not null and a.event_id // {RESET} = b.event_id // {RESET} and a.event_id % {RESET} <> 0 as leaves, a.event_type in ('purchase', 'click') as trades, a.event_type = 'view' as modifies
  from events a left join events b on b.event_id = a.event_id - {RESTS} and cast(b.ts as date) = cast(a.ts as date)
  where day(a.ts) % 6 <> 0),
tape_rows as (
  select e, ts, 0 as sub, 'T' as action, b as o, true as swap, 0 as more, 0 as flags from tape_steps where leaves and trades
  union all select e, ts, 1, 'F', b, false, 0, 0 from tape_steps where leaves and trades
  union all select e, ts, 1, 'M', b, false, 3, 0 from tape_steps where leaves and modifies
  union all select e, ts, 2, 'C', b, false, case when modifies then 3 else 0 end, 0 from tape_steps where leaves
  union all select e, ts, 0, 'R', null, false, 0, 32 from tape_steps where resets
  union all select e, ts, 3, 'A', e, false, 0, case when resets then 160 else 128 end from tape_steps),
tape as (
  select * from tape_dirty
  union all
  select cast(cast(ts as date) as varchar), e * 8 + sub, action, case when o is null then 'N' when (o % 2 = 0) <> swap then 'B' else 'A' end,
    coalesce(100000000000 + 250000000 * abs(o // 12 % 21 - 10) + case when o % 2 = 0 then -1 else 1 end * 250000000 * (1 + o // 2 % 2), 0)::bigint,
    coalesce(1 + o % 5 + more, 0)::bigint, case when o is null or swap then 0 else o + 1 end, epoch_us(ts) * 1000, epoch_us(ts) * 1000 + (e % 7) * 1000, flags::bigint
  from tape_rows)
"""


#: Lines of an order table that one task takes at most, so that what it holds does not grow with the table.
PART_LINES = 1_000_000


def task_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each task, policy and scenario, of the tables ``lineitem`` and ``orders``.

    is_ticks_net is a whole number of hundredths, so that means of it are the same in any order up
    to rounding of the last division. Rows are dealt by task_id once, and all that groups by tasks goes on from there.
    """
    lines = load(spark, sf_dir, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // PART_LINES))
    dealt = lambda rows, key, *names: rows.select(F.col(key).cast("string").alias("task_id"), *names).repartition(parts, "task_id")
    joined = dealt(lines, "l_orderkey", "l_orderkey", "l_returnflag", "l_tax", "l_linestatus", "l_discount").join(dealt(load(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", "o_custkey"), "task_id")
    grouped = joined.groupBy("task_id", "l_orderkey", "l_returnflag").agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("session_id"),
        F.max("l_tax").alias("tax"),
        # The least status, as a number: a string in a sum of a group would have it sorted instead of hashed.
        F.min(F.when(F.col("l_linestatus").isNotNull(), F.ascii("l_linestatus"))).alias("line"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("metric"),
        F.count("*").alias("n"),
        F.min("o_custkey").alias("cust"),
    )
    status = F.when(F.col("tax") >= 0.08, "TECHNICALLY_UNEVALUABLE").when(F.col("line") == ord("F"), "COMPLETED_ON_TIME").otherwise("DEADLINE_MISS")
    rows = grouped.select(
        "task_id", "session_id", F.col("l_returnflag").alias("policy_id"), status.alias("status"),
        F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1).alias("side"), F.lit(1_000_000_000).cast("long").alias("horizon_ns"),
        F.col("metric"), "n", "cust",
    )
    scenarios = F.explode(F.array(F.struct(F.lit("L1").alias("id"), F.lit(0).alias("shift")), F.struct(F.lit("L6").alias("id"), F.lit(3).alias("shift"))))
    value = F.col("metric") + F.when(F.col("policy_id") == "A", F.col("s.shift")).otherwise(0)
    return rows.withColumn("s", scenarios).select(
        "task_id", "session_id", "policy_id", F.col("s.id").alias("scenario_id"), "horizon_ns", "side", "status",
        F.when(F.col("status") == "COMPLETED_ON_TIME", value.cast("double")).alias("is_ticks_net"),
        (F.col("n") % 2 == 0).alias("passive_filled"), (F.col("n") > 1).alias("checkpoint_eligible"),
        F.when(F.col("n") > 3, "MODEL_CHOICE").when(F.col("n") > 2, "FALLBACK_UNSUPPORTED").when(F.col("n") > 1, "FALLBACK_NONFINITE").otherwise("NOT_APPLICABLE").alias("decision_reason"),
        F.when((F.col("cust") + F.length("policy_id") + F.col("n")) % 3 == 0, "HOLD").otherwise("SWITCH").alias("checkpoint_choice"),
    )


RESULTS_SQL = """
results as (
  select task_id, session_id, policy_id, s.id as scenario_id, 1000000000::bigint as horizon_ns, side, status,
    case when status = 'COMPLETED_ON_TIME' then cast(metric + case when policy_id = 'A' then s.shift else 0 end as double) end as is_ticks_net,
    n % 2 = 0 as passive_filled, n > 1 as checkpoint_eligible,
    case when n > 3 then 'MODEL_CHOICE' when n > 2 then 'FALLBACK_UNSUPPORTED' when n > 1 then 'FALLBACK_NONFINITE' else 'NOT_APPLICABLE' end as decision_reason,
    case when (cust + length(policy_id) + n) % 3 = 0 then 'HOLD' else 'SWITCH' end as checkpoint_choice
  from (
    select cast(l_orderkey as varchar) as task_id, strftime(min(o_orderdate), '%Y-%m') as session_id, l_returnflag as policy_id,
      case when l_orderkey % 2 = 0 then 1 else -1 end as side, count(*) as n, min(o_custkey) as cust,
      case when max(l_tax) >= 0.08 then 'TECHNICALLY_UNEVALUABLE' when min(l_linestatus) = 'F' then 'COMPLETED_ON_TIME' else 'DEADLINE_MISS' end as status,
      sum(cast(round(l_discount * 100) as bigint)) as metric
    from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey, l_returnflag) g,
    (values ('L1', 0), ('L6', 3)) s(id, shift))
"""
