"""Atomic batches, their quality, duplicate records, overlapping sessions, execution evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.ranges import points_in_intervals, running_total
from tapeloom.sources.schemas import BAD_TS_RECV, LAST, MAYBE_BAD_BOOK, SNAPSHOT

MUTATES = ("A", "M", "C", "R")


def has(bit: int):
    return F.col("flags").bitwiseAND(bit) != 0


def number_batches(records: DataFrame, keep=None) -> DataFrame:
    """``records`` with batch_id: how many records of the session before it close a batch. ``keep`` may write them."""
    closing = records.withColumn("_closes", has(LAST).cast("long"))
    return running_total(closing, ["session_id"], "source_ordinal", "_closes", "batch_id", keep=keep).drop("_closes")


def assemble(numbered: DataFrame) -> DataFrame:
    """One row for each batch: its times, kind and sorted quality flags."""
    mutating_ok = F.col("action").isin(*MUTATES)
    bad_record = (F.col("action").isin("T", "F") & (F.col("quantity") <= 0)) | (has(SNAPSHOT) & ~F.col("action").isin("A", "R", "N"))
    rows = numbered.groupBy("session_id", "batch_id").agg(
        F.count("*").alias("n_records"),
        F.min("source_ordinal").alias("first_ordinal"),
        F.max("source_ordinal").alias("last_ordinal"),
        F.max("event_time_ns").alias("proxy_time_ns"),
        F.max("capture_time_ns").alias("capture_time_ns"),
        F.bool_and(has(SNAPSHOT)).alias("all_snapshot"),
        F.min_by((F.col("action") == "R").cast("int"), "source_ordinal").alias("first_clears"),
        # Mutating records that are no snapshots, the first record aside.
        (F.count_if(mutating_ok & ~has(SNAPSHOT)) - F.max_by((mutating_ok & ~has(SNAPSHOT)).cast("long"), -F.col("source_ordinal"))).alias("plain_later"),
        F.bool_or(has(LAST)).alias("closed"),
        F.bool_or(F.col("capture_time_ns") < F.col("event_time_ns")).alias("early"),
        F.bool_or((F.col("event_time_ns") < 0) | (F.col("capture_time_ns") < 0) | has(BAD_TS_RECV)).alias("bad_ts"),
        F.bool_or(bad_record).alias("bad_record"),
        F.bool_or(has(MAYBE_BAD_BOOK)).alias("bad_book"),
        F.bool_or(F.col("action") == "R").alias("has_clear"),
    )
    init = F.col("all_snapshot") | ((F.col("first_clears") == 1) & (F.col("n_records") > 1) & (F.col("plain_later") == 0))
    before = F.lag("proxy_time_ns").over(Window.partitionBy("session_id").orderBy("batch_id"))
    flag = lambda held, name: F.when(held, F.lit(name))
    flags = F.array_compact(
        F.array(
            flag(F.col("early"), "CAPTURE_BEFORE_PROXY"), flag(before > F.col("proxy_time_ns"), "DECREASING_PROXY_TIME"), flag(F.col("bad_record"), "INVALID_RECORD"),
            flag(F.col("bad_ts"), "INVALID_TIMESTAMP"), flag(F.col("bad_book"), "MAYBE_BAD_BOOK"), flag(~F.col("closed"), "TRUNCATED"),
        )
    )
    return rows.select("session_id", "batch_id", "n_records", "first_ordinal", "last_ordinal", "proxy_time_ns", "capture_time_ns", F.when(init, "INITIALIZATION").otherwise("LIVE").alias("kind"), F.array_join(flags, ",").alias("quality_flags"), "has_clear")


BATCH_SQL = """
numbered as (
  select *, coalesce(sum(case when flags & 128 <> 0 then 1 else 0 end) over (partition by session_id order by source_ordinal rows between unbounded preceding and 1 preceding), 0)::bigint as batch_id
  from tape),
ranked as (select *, row_number() over (partition by session_id, batch_id order by source_ordinal) as k from numbered),
gathered as (
  select session_id, batch_id, count(*)::bigint as n_records, min(source_ordinal) as first_ordinal, max(source_ordinal) as last_ordinal,
    max(event_time_ns) as proxy_time_ns, max(capture_time_ns) as capture_time_ns,
    bool_and(flags & 32 <> 0) or (bool_or(k = 1 and action = 'R') and count(*) > 1
      and not bool_or(k > 1 and action in ('A', 'M', 'C', 'R') and flags & 32 = 0)) as init,
    bool_or(flags & 128 <> 0) as closed, bool_or(capture_time_ns < event_time_ns) as early,
    bool_or(event_time_ns < 0 or capture_time_ns < 0 or flags & 8 <> 0) as bad_ts,
    bool_or((action in ('T', 'F') and quantity <= 0) or (flags & 32 <> 0 and action not in ('A', 'R', 'N'))) as bad_record,
    bool_or(flags & 4 <> 0) as bad_book, bool_or(action = 'R') as has_clear
  from ranked group by 1, 2),
batches as (
  select session_id, batch_id, n_records, first_ordinal, last_ordinal, proxy_time_ns, capture_time_ns,
    case when init then 'INITIALIZATION' else 'LIVE' end as kind,
    concat_ws(',', case when early then 'CAPTURE_BEFORE_PROXY' end,
      case when lag(proxy_time_ns) over (partition by session_id order by batch_id) > proxy_time_ns then 'DECREASING_PROXY_TIME' end,
      case when bad_record then 'INVALID_RECORD' end, case when bad_ts then 'INVALID_TIMESTAMP' end,
      case when bad_book then 'MAYBE_BAD_BOOK' end, case when not closed then 'TRUNCATED' end) as quality_flags, has_clear
  from gathered)
"""


def duplicate_records(records: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Second and later rows of a key, with the ordinal of the first: (kind, source_ordinal, first)."""
    w = Window.partitionBy(*keys).orderBy("source_ordinal", "tie")
    ranked = records.withColumn("n", F.row_number().over(w)).withColumn("first_seen", F.first("source_ordinal").over(w))
    return ranked.filter("n > 1").select(F.lit(kind).alias("kind"), "source_ordinal", "first_seen")


def overlapping_windows(windows: DataFrame, bucket_ns: int = 86_400_000_000_000) -> DataFrame:
    """Pairs of windows (id, instrument_id, start_ns, end_ns), closed at both ends, that overlap.

    The later start of two windows that overlap lies in the other, so each start meets the windows that run through
    its bucket, and a pair comes once however long they are. Choose a bucket near the usual window.
    """
    w = lambda s: [F.col("id").alias(f"{s}_id"), F.col("start_ns").alias(f"{s}_start"), F.col("end_ns").alias(f"{s}_end")]
    later = windows.select("instrument_id", *w("y"))
    met = points_in_intervals(later, windows.select("instrument_id", *w("x"), (F.col("end_ns") + 1).alias("_upto")), ["instrument_id"], "y_start", "x_start", "_upto", bucket_ns)
    once = met.filter("x_start <= y_end and x_id <> y_id and (x_start < y_start or x_id < y_id)")
    return once.select("instrument_id", F.least("x_id", "y_id").alias("a_id"), F.greatest("x_id", "y_id").alias("b_id"))


def execution_groups(numbered: DataFrame, batches: DataFrame) -> DataFrame:
    """(session_id, batch_id, n_groups, n_valid, invalid, n_allocations): TRADE, (FILL, CANCEL)+ groups.

    A group starts at a trade and goes on while fill and cancel alternate; its fills must add up to
    the trade. A fill outside of a group, or a bad group, makes the batch invalid. An invalid or
    flagged batch has no allocations.
    """
    w = Window.partitionBy("session_id", "batch_id").orderBy("source_ordinal")
    look = lambda c, k: F.lead(c, k).over(w)
    rows = numbered.withColumn("prev", F.lag("action").over(w)).withColumn("group", F.sum((F.col("action") == "T").cast("long")).over(w))
    for c in ("action", "order_id", "side", "price_fixed", "quantity", "flags"):
        rows = rows.withColumn(f"n_{c}", look(c, 1))
    gw = Window.partitionBy("session_id", "batch_id", "group").orderBy("source_ordinal")
    rows = rows.withColumn("k", F.row_number().over(gw) - 1)
    # Fills stand at 1, 3, 5, ... and cancels at 2, 4, ... while the protocol holds.
    in_order = F.when(F.col("k") == 0, F.col("action") == "T").when(F.col("k") % 2 == 1, F.col("action") == "F").otherwise(F.col("action") == "C")
    rows = rows.withColumn("held", F.bool_and(in_order).over(gw.rowsBetween(Window.unboundedPreceding, 0)))
    head = lambda c: F.first(c).over(gw)
    fill_ok = (
        (F.col("quantity") > 0) & (F.col("order_id") > 0) & F.col("side").isin("A", "B") & (F.col("side") != head("side")) & (F.col("price_fixed") == head("price_fixed")) & ~has(SNAPSHOT)
        & (F.col("n_action") == "C") & (F.col("n_order_id") == F.col("order_id")) & (F.col("n_side") == F.col("side")) & (F.col("n_price_fixed") == F.col("price_fixed"))
        & (F.col("n_quantity") == F.col("quantity")) & (F.col("n_flags").bitwiseAND(SNAPSHOT) == 0)
    )
    in_group = F.col("held") & (F.col("group") > 0)
    groups = rows.withColumn("fill_ok", F.coalesce(fill_ok, F.lit(False))).groupBy("session_id", "batch_id", "group").agg(
        F.bool_or((F.col("k") == 0) & (F.col("quantity") > 0) & F.col("side").isin("A", "B") & (F.col("order_id") == 0) & ~has(SNAPSHOT)).alias("head_ok"),
        F.max_by("quantity", -F.col("k")).alias("volume"),
        F.count_if(in_group & (F.col("action") == "F")).alias("fills"),
        F.count_if(in_group & (F.col("action") == "F") & F.col("fill_ok")).alias("good_fills"),
        F.sum(F.when(in_group & (F.col("action") == "F"), F.col("quantity")).otherwise(0)).alias("filled"),
        F.count_if(~in_group & (F.col("action") == "F")).alias("orphans"),
    )
    valid = (F.col("group") > 0) & F.col("head_ok") & (F.col("fills") > 0) & (F.col("fills") == F.col("good_fills")) & (F.col("filled") == F.col("volume"))
    per_batch = groups.withColumn("valid", valid).groupBy("session_id", "batch_id").agg(
        F.count_if(F.col("group") > 0).alias("n_groups"), F.count_if(F.col("valid")).alias("n_valid"),
        F.bool_or((F.col("orphans") > 0) | ((F.col("group") > 0) & ~F.col("valid"))).alias("invalid"), F.sum(F.when(F.col("valid"), F.col("fills")).otherwise(0)).alias("fills"),
    )
    flagged = batches.select("session_id", "batch_id", (F.col("quality_flags") != "").alias("flagged"))
    return per_batch.join(flagged, ["session_id", "batch_id"]).select("session_id", "batch_id", "n_groups", "n_valid", "invalid", F.when(F.col("invalid") | F.col("flagged"), 0).otherwise(F.col("fills")).cast("long").alias("n_allocations"))


EVIDENCE_SQL = """
grouped as (select *, sum(case when action = 'T' then 1 else 0 end) over w as g, lead(action) over w as n_action, lead(order_id) over w as n_order, lead(side) over w as n_side,
    lead(price_fixed) over w as n_price, lead(quantity) over w as n_quantity, lead(flags) over w as n_flags
  from numbered window w as (partition by session_id, batch_id order by source_ordinal)),
placed as (select *, row_number() over w - 1 as k, first_value(side) over w as t_side, first_value(price_fixed) over w as t_price, first_value(quantity) over w as t_quantity
  from grouped window w as (partition by session_id, batch_id, g order by source_ordinal)),
held as (select *, g > 0 and bool_and(action = case when k = 0 then 'T' when k % 2 = 1 then 'F' else 'C' end) over (partition by session_id, batch_id, g order by source_ordinal) as inside from placed),
groups as (select session_id, batch_id, g,
    g > 0 and bool_or(k = 0 and quantity > 0 and side in ('A', 'B') and order_id = 0 and flags & 32 = 0)
      and count(*) filter (inside and action = 'F') > 0 and sum(case when inside and action = 'F' then quantity else 0 end) = max(t_quantity)
      and bool_and(not (inside and action = 'F') or coalesce(quantity > 0 and order_id > 0 and side <> t_side and price_fixed = t_price and flags & 32 = 0
        and n_action = 'C' and n_order = order_id and n_side = side and n_price = price_fixed and n_quantity = quantity and n_flags & 32 = 0, false)) as valid,
    count(*) filter (inside and action = 'F') as fills, count(*) filter (not inside and action = 'F') as orphans
  from held group by 1, 2, 3),
evidence as (select session_id, batch_id, count(*) filter (g > 0)::bigint as n_groups, count(*) filter (valid)::bigint as n_valid,
    bool_or(orphans > 0 or (g > 0 and not valid)) as invalid, sum(case when valid then fills else 0 end)::bigint as fills
  from groups group by 1, 2)
"""
