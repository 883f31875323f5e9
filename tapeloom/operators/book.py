"""The order book without a global fold.

What happens to an order depends only on its own records and on resets, so its state is a running fold
over its records in one reset epoch. Levels change by what the orders' intervals add and take away; a
session is cut into segments of batches, each opens with the levels that stand there, and so all
segments are folded side by side. Folds stream over sorted rows and hold one order or one book only.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.ranges import bucket_of, marks_upto, points_in_intervals

#: Ordinals that an order interval's join bucket spans.
BUCKET = 4096
#: Batches of a session that one fold of its levels covers.
SEGMENT = 1024
#: Rows that a fold sends on at once.
CHUNK = 20_000


def with_epoch(numbered: DataFrame, batches: DataFrame, keep=lambda df: df) -> DataFrame:
    """Records with ``epoch``: how many resets (CLEAR records, starts of INITIALIZATION batches) the
    session has had, a record's own included. ``keep`` may write the resets."""
    clears = numbered.filter("action = 'R'").select("session_id", "source_ordinal")
    opens = batches.filter("kind = 'INITIALIZATION'").select("session_id", F.col("first_ordinal").alias("source_ordinal"))
    return marks_upto(numbered, clears.unionByName(opens), ["session_id"], "source_ordinal", "epoch", BUCKET, keep)


GONE = (False, None, None, 0, None)
#: What the fold of orders finds.
OWN = ("alive", "side", "price_fixed", "quantity", "priority", "anomaly")


def _step(state: tuple, at: int, action: str, side: str | None, price: int | None, qty: int | None) -> tuple[tuple, str | None]:
    """An order's (alive, side, price, quantity, priority) after one record, and the record's anomaly."""
    alive, own_side, own_price, own_qty, priority = state
    empty = qty is None or qty <= 0
    if action == "A":
        anomaly = "ADD_INVALID_SIDE" if side not in ("A", "B") else "ADD_NONPOSITIVE_QTY" if empty else "DUPLICATE_ADD" if alive else None
        return (state if anomaly else (True, side, price, qty, at)), anomaly
    if action == "C":
        anomaly = "CANCEL_UNKNOWN" if not alive else "CANCEL_NONPOSITIVE_QTY" if empty else None
        if anomaly:
            return state, anomaly
        left = own_qty - min(own_qty, qty)
        return ((True, own_side, own_price, left, priority) if left else GONE), ("CANCEL_OVER_QTY" if qty > own_qty else None)
    anomaly = "MODIFY_NONPOSITIVE_QTY" if empty else None if alive else "MODIFY_UNKNOWN"
    back = price != own_price or (not empty and qty > own_qty)
    return (state if anomaly else (True, own_side, price, qty, at if back else priority)), anomaly


STATES = "session_id string, epoch bigint, order_id bigint, source_ordinal bigint, batch_id bigint, action string, alive boolean, side string, price_fixed bigint, quantity bigint, priority bigint, anomaly string, next_ordinal bigint, next_batch bigint"
_STATES = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in STATES.split(", "))])


def _changes_of(part: pa.RecordBatch, names: tuple[str, ...], last: tuple | None) -> tuple[list[bool], tuple]:
    """Where a row's key differs from that of the row before, and the part's last key."""
    new = np.zeros(part.num_rows, bool)
    for n in names:
        codes = part.column(n).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = tuple(part.column(n)[0].as_py() for n in names) != last
    return new.tolist(), tuple(part.column(n)[part.num_rows - 1].as_py() for n in names)


def _values(column: pa.Array) -> list:
    """What ``to_pylist`` gives of whole numbers or of few different strings, without an object for each scalar."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        coded = column.dictionary_encode(null_encoding="encode")
        words = coded.dictionary.to_pylist()
        return [words[k] for k in coded.indices.to_numpy(zero_copy_only=False).tolist()]
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    out = column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    for k in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
        out[k] = None
    return out


def _fold_orders(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, state = None, GONE
    for part in parts:
        if not part.num_rows:
            continue
        new, last = _changes_of(part, ("session_id", "epoch", "order_id"), last)
        out = []
        for first, at, action, side, price, qty in zip(new, *(_values(part.column(n)) for n in ("source_ordinal", "action", "side", "price_fixed", "quantity"))):
            state, anomaly = _step(GONE if first else state, at, action, side, price, qty)
            out.append((*state, anomaly))
        # What is no part of the state goes on as it came.
        fields, found = list(_STATES), iter(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(next(found), f.type) if f.name in OWN else part.column(f.name) for f in fields], schema=_STATES)


def order_state(epochs: DataFrame) -> DataFrame:
    """(session_id, epoch, order_id, source_ordinal, batch_id, action, alive, side, price_fixed, quantity,
    priority, anomaly, next_ordinal, next_batch): each add, modify and cancel with the order's state after it, and
    where the order's next one in the epoch is.

    An order's records in one epoch come sorted to one task, which holds the order's state alone; CLEAR
    needs no row, as it ends the epoch. A null side is invalid, a null quantity is not positive.
    """
    own = epochs.filter(F.col("action").isin("A", "M", "C")).select("session_id", F.col("epoch").cast("long").alias("epoch"), "order_id", "source_ordinal", "batch_id", "action", "side", "price_fixed", "quantity")
    key = ["session_id", "epoch", "order_id"]
    w = Window.partitionBy(*key).orderBy("source_ordinal")
    rows = own.repartition(*key).sortWithinPartitions(*key, "source_ordinal")
    return rows.withColumns({"next_ordinal": F.lead("source_ordinal").over(w), "next_batch": F.lead("batch_id").over(w)}).mapInArrow(_fold_orders, STATES)


def order_intervals(states: DataFrame, epochs: DataFrame, keep=lambda df: df) -> DataFrame:
    """(session_id, order_id, side, price_fixed, quantity, priority, ord_from, ord_to, batch_from,
    batch_to): while an order rests unchanged, [ord_from, ord_to) in ordinals, and the batches of both
    ends. A reset ends it; at a session's end batch_to is null. ``keep`` may write the epochs' ends."""
    # Batches are numbered in the order of ordinals, so the least of both are of the same record.
    found = epochs.groupBy("session_id", "epoch").agg(F.min("source_ordinal").alias("at"), F.min("batch_id").alias("in"), F.max("source_ordinal").alias("last"))
    reset, of = F.lead(F.struct("at", F.col("in").alias("batch_id"))).over(Window.partitionBy("session_id").orderBy("epoch")), Window.partitionBy("session_id")
    ends = keep(found.select("session_id", "epoch", reset.alias("reset_at"), (F.max("last").over(of) + 1).alias("session_end")))
    rows = states.filter("alive").join(ends, ["session_id", "epoch"])
    return rows.select("session_id", "order_id", "side", "price_fixed", "quantity", "priority", F.col("source_ordinal").alias("ord_from"), F.coalesce("next_ordinal", "reset_at.at", "session_end").alias("ord_to"),
                       F.col("batch_id").alias("batch_from"), F.coalesce("next_batch", "reset_at.batch_id").alias("batch_to"))


def resting_at(intervals: DataFrame, batches: DataFrame) -> DataFrame:
    """Orders that rest after each batch's last record, for what needs each order; levels don't."""
    points = batches.select("session_id", "batch_id", F.col("last_ordinal").alias("at"))
    return points_in_intervals(points, intervals.drop("batch_from", "batch_to"), ["session_id"], "at", "ord_from", "ord_to", BUCKET)


def level_changes(intervals: DataFrame) -> DataFrame:
    """(session_id, batch_id, side, price_fixed, quantity, n_orders): what each batch adds to a level."""
    ends = F.explode(F.array(F.struct(F.col("batch_from").alias("batch_id"), F.col("quantity").alias("quantity"), F.lit(1).alias("n")), F.struct(F.col("batch_to").alias("batch_id"), (-F.col("quantity")).alias("quantity"), F.lit(-1).alias("n"))))
    rows = intervals.select("session_id", "side", "price_fixed", ends.alias("e")).filter("e.batch_id is not null")
    found = rows.groupBy("session_id", F.col("e.batch_id").alias("batch_id"), "side", "price_fixed").agg(F.sum("e.quantity").alias("quantity"), F.sum("e.n").alias("n_orders"))
    return found.filter("quantity <> 0 or n_orders <> 0")


DEPTH = "session_id string, batch_id bigint, side string, price_fixed bigint, quantity bigint, n_orders bigint, level int"
_DEPTH = pa.schema([("session_id", pa.string()), ("batch_id", pa.int64()), ("side", pa.string()), ("price_fixed", pa.int64()), ("quantity", pa.int64()), ("n_orders", pa.int64()), ("level", pa.int32())])


def _fold_levels(top: int | None):
    def rows_out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DEPTH)], schema=_DEPTH)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, out = None, []
        levels: dict = {}
        best: dict = {}
        for part in parts:
            columns = [part.column(n).to_pylist() for n in ("session_id", "segment", "batch_id", "side", "price_fixed", "quantity", "n_orders")]
            for session, number, batch, side, price, qty, n in zip(*columns):
                if (session, number) != segment:
                    segment, levels, best = (session, number), {}, {"A": [], "B": []}
                if side is None:
                    for s, ranked in best.items():
                        for k, r in enumerate(ranked[:top]):
                            p = -r if s == "B" else r
                            out.append((session, batch, s, p, *levels[s, p], k + 1))
                    if len(out) >= CHUNK:
                        yield rows_out(out)
                        out = []
                    continue
                rank, held = (-price if side == "B" else price), levels.get((side, price))
                qty, n = (qty + held[0], n + held[1]) if held else (qty, n)
                if held is None:
                    insort(best[side], rank)
                levels[side, price] = (qty, n)
                if n == 0:
                    del levels[side, price], best[side][bisect_left(best[side], rank)]
        if out:
            yield rows_out(out)

    return run


def _level_rows(changes: DataFrame, batches: DataFrame) -> DataFrame:
    """What folds of levels read, sorted: the changes, the levels that stand where a segment opens, and the batches."""
    cut = lambda df: df.withColumn("segment", bucket_of("batch_id", SEGMENT))
    sums = cut(changes).groupBy("session_id", "side", "price_fixed", "segment").agg(F.sum("quantity").alias("q"), F.sum("n_orders").alias("n"))
    w = Window.partitionBy("session_id", "side", "price_fixed").orderBy("segment")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    last = cut(batches).groupBy("session_id").agg(F.max("segment").alias("last"))
    stands = sums.select("session_id", "side", "price_fixed", F.col("segment").alias("from"), F.lead("segment").over(w).alias("next"), F.sum("q").over(upto).alias("quantity"), F.sum("n").over(upto).alias("n_orders"))
    stands = stands.filter("n_orders > 0").join(last, "session_id").withColumn("to", F.coalesce("next", "last")).filter("from < to")
    opening = stands.select("session_id", F.explode(F.sequence(F.col("from") + 1, F.col("to"))).alias("segment"), F.lit(-1).cast("long").alias("batch_id"), "side", "price_fixed", "quantity", "n_orders")
    rows = opening.unionByName(cut(changes)).unionByName(cut(batches), allowMissingColumns=True)
    return rows.repartition("session_id", "segment").sortWithinPartitions("session_id", "segment", "batch_id", F.col("side").asc_nulls_last())


def level_depth(changes: DataFrame, batches: DataFrame, top: int | None = None) -> DataFrame:
    """(session_id, batch_id, side, price_fixed, quantity, n_orders, level): the ``top`` levels (None:
    all) after each batch; level 1 is the best."""
    return _level_rows(changes, batches.select("session_id", "batch_id")).mapInArrow(_fold_levels(top), DEPTH)


BEST = "bid_price bigint, bid_qty bigint, ask_price bigint, ask_qty bigint, depth_bid_3 bigint, depth_ask_3 bigint"


def _fold_best(kept: list[str]):
    names = [*kept, *(c.split()[0] for c in BEST.split(", "))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        held: dict = {}
        best: dict = {}
        for part in parts:
            if not part.num_rows:
                continue
            new, last = _changes_of(part, ("session_id", "segment"), last)
            at, out = [], []
            for k, (first, side, price, qty, n) in enumerate(zip(new, *(_values(part.column(c)) for c in ("side", "price_fixed", "quantity", "n_orders")))):
                if first:
                    held, best = {"A": {}, "B": {}}, {"A": [], "B": []}
                if side is None:
                    row = []
                    for s in ("B", "A"):
                        top = [held[s][r] for r in best[s][:3]]
                        row += [-best[s][0] if s == "B" else best[s][0], top[0][0], sum(q for q, _ in top)] if top else [None, None, 0]
                    at.append(k)
                    out.append((row[0], row[1], row[3], row[4], row[2], row[5]))
                    continue
                rank, levels = (-price if side == "B" else price), held[side]
                known = levels.get(rank)
                if known is None:
                    insort(best[side], rank)
                else:
                    qty, n = qty + known[0], n + known[1]
                levels[rank] = (qty, n)
                if n == 0:
                    del levels[rank], best[side][bisect_left(best[side], rank)]
            if at:
                same = [part.column(c).take(pa.array(at)) for c in kept]
                yield pa.RecordBatch.from_arrays(same + [pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return run


def quotes_after(changes: DataFrame, batches: DataFrame, *more: str) -> DataFrame:
    """What ``best_quotes`` gives over ``level_depth``, with the columns ``more`` of ``batches``: one fold that gives a
    row for each batch, not one for each of its levels."""
    own = batches.select("session_id", "batch_id", "proxy_time_ns", "kind", *more)
    types = ", ".join(f"{n} {t}" for n, t in own.dtypes)
    return _with_mid(_level_rows(changes, own).mapInArrow(_fold_best(own.columns), f"{types}, {BEST}"))


def best_quotes(batches: DataFrame, depth: DataFrame) -> DataFrame:
    """One row for each batch: best prices and sizes, three-level depths, imbalances and mid2, which is
    null where a side is empty or the book is crossed or locked."""
    top = (F.col("level") == 1)
    bid, ask = F.col("side") == "B", F.col("side") == "A"
    agg = depth.filter("level <= 3").groupBy("session_id", "batch_id").agg(
        F.max(F.when(top & bid, F.col("price_fixed"))).alias("bid_price"), F.max(F.when(top & bid, F.col("quantity"))).alias("bid_qty"),
        F.max(F.when(top & ask, F.col("price_fixed"))).alias("ask_price"), F.max(F.when(top & ask, F.col("quantity"))).alias("ask_qty"),
        F.coalesce(F.sum(F.when(bid, F.col("quantity"))), F.lit(0)).alias("depth_bid_3"), F.coalesce(F.sum(F.when(ask, F.col("quantity"))), F.lit(0)).alias("depth_ask_3"),
    )
    rows = batches.select("session_id", "batch_id", "proxy_time_ns", "kind").join(agg, ["session_id", "batch_id"], "left").fillna(0, ["depth_bid_3", "depth_ask_3"])
    return _with_mid(rows)


def _with_mid(rows: DataFrame) -> DataFrame:
    imbalance = lambda b, a: F.when(b + a > 0, (b - a) / (b + a)).otherwise(F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.withColumns(
        {
            "mid2": F.when(F.col("bid_price") < F.col("ask_price"), F.col("bid_price") + F.col("ask_price")),
            "imbalance_1": imbalance(zero("bid_qty"), zero("ask_qty")),
            "imbalance_3": imbalance(F.col("depth_bid_3"), F.col("depth_ask_3")),
        }
    )


def queue_ahead(resting: DataFrame) -> DataFrame:
    """(session_id, batch_id, order_id, ahead): quantity of earlier priority at an order's own level."""
    w = Window.partitionBy("session_id", "batch_id", "side", "price_fixed").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    return resting.select("session_id", "batch_id", "order_id", F.coalesce(F.sum("quantity").over(w), F.lit(0)).alias("ahead"))


BOOK_SQL = """
epochs as (
  select n.*, sum(case when action = 'R' or (b.kind = 'INITIALIZATION' and n.source_ordinal = b.first_ordinal) then 1 else 0 end)
    over (partition by n.session_id order by n.source_ordinal)::bigint as epoch
  from numbered n join batches b using (session_id, batch_id)),
own as (select *, row_number() over (partition by session_id, epoch, order_id order by source_ordinal) as k from epochs where action in ('A', 'M', 'C')),
fold as (
  select session_id, epoch, order_id, 0::bigint as k, null::bigint as source_ordinal, false as alive, null::varchar as side, null::bigint as price, 0::bigint as qty, null::bigint as prio, null::varchar as anomaly
    from own where k = 1
  union all
  select f.session_id, f.epoch, f.order_id, o.k, o.source_ordinal,
    case when o.action = 'A' and not f.alive and o.side in ('A', 'B') and o.quantity > 0 then true
      when o.action = 'C' and f.alive and o.quantity > 0 and o.quantity >= f.qty then false else f.alive end,
    case when o.action = 'A' and not f.alive and o.side in ('A', 'B') and o.quantity > 0 then o.side
      when o.action = 'C' and f.alive and o.quantity > 0 and o.quantity >= f.qty then null else f.side end,
    case when o.action = 'A' and not f.alive and o.side in ('A', 'B') and o.quantity > 0 then o.price_fixed
      when o.action = 'M' and f.alive and o.quantity > 0 then o.price_fixed
      when o.action = 'C' and f.alive and o.quantity > 0 and o.quantity >= f.qty then null else f.price end,
    case when o.action = 'A' and not f.alive and o.side in ('A', 'B') and o.quantity > 0 then o.quantity
      when o.action = 'M' and f.alive and o.quantity > 0 then o.quantity
      when o.action = 'C' and f.alive and o.quantity > 0 then f.qty - least(f.qty, o.quantity) else f.qty end,
    case when o.action = 'A' and not f.alive and o.side in ('A', 'B') and o.quantity > 0 then o.source_ordinal
      when o.action = 'M' and f.alive and o.quantity > 0 and (o.price_fixed <> f.price or o.quantity > f.qty) then o.source_ordinal
      when o.action = 'C' and f.alive and o.quantity > 0 and o.quantity >= f.qty then null else f.prio end,
    case when o.action = 'A' and o.side not in ('A', 'B') then 'ADD_INVALID_SIDE' when o.action = 'A' and o.quantity <= 0 then 'ADD_NONPOSITIVE_QTY'
      when o.action = 'A' and f.alive then 'DUPLICATE_ADD' when o.action = 'C' and not f.alive then 'CANCEL_UNKNOWN'
      when o.action = 'C' and o.quantity <= 0 then 'CANCEL_NONPOSITIVE_QTY' when o.action = 'C' and o.quantity > f.qty then 'CANCEL_OVER_QTY'
      when o.action = 'M' and o.quantity <= 0 then 'MODIFY_NONPOSITIVE_QTY' when o.action = 'M' and not f.alive then 'MODIFY_UNKNOWN' end
  from fold f join own o on o.session_id = f.session_id and o.epoch = f.epoch and o.order_id = f.order_id and o.k = f.k + 1),
states as (select f.*, o.batch_id from fold f join own o using (session_id, source_ordinal) where f.k > 0),
intervals as (
  select s.session_id, s.order_id, s.side, s.price as price_fixed, s.qty as quantity, s.prio as priority, s.source_ordinal as ord_from, coalesce(nxt, reset_at, session_end) as ord_to
  from (select *, lead(source_ordinal) over (partition by session_id, epoch, order_id order by source_ordinal) as nxt from states) s
    left join (select session_id, epoch - 1 as epoch, min(source_ordinal) as reset_at from epochs group by 1, 2) e using (session_id, epoch)
    join (select session_id, max(source_ordinal) + 1 as session_end from epochs group by 1) l using (session_id)
  where alive),
resting as (select b.session_id, b.batch_id, i.* exclude (session_id) from batches b join intervals i on b.session_id = i.session_id and b.last_ordinal >= i.ord_from and b.last_ordinal < i.ord_to),
depth as (
  select *, row_number() over (partition by session_id, batch_id, side order by case when side = 'B' then -price_fixed else price_fixed end) as level
  from (select session_id, batch_id, side, price_fixed, sum(quantity)::bigint as quantity, count(*)::bigint as n_orders from resting group by 1, 2, 3, 4)),
quotes as (
  select *, case when bid_price < ask_price then bid_price + ask_price end as mid2,
    case when coalesce(bid_qty, 0) + coalesce(ask_qty, 0) > 0 then (coalesce(bid_qty, 0) - coalesce(ask_qty, 0)) / (coalesce(bid_qty, 0) + coalesce(ask_qty, 0)) else 0.0 end::double as imbalance_1,
    case when depth_bid_3 + depth_ask_3 > 0 then (depth_bid_3 - depth_ask_3) / (depth_bid_3 + depth_ask_3) else 0.0 end::double as imbalance_3
  from (
    select b.session_id, b.batch_id, b.proxy_time_ns, b.kind, max(price_fixed) filter (level = 1 and side = 'B') as bid_price, max(quantity) filter (level = 1 and side = 'B') as bid_qty,
      max(price_fixed) filter (level = 1 and side = 'A') as ask_price, max(quantity) filter (level = 1 and side = 'A') as ask_qty,
      coalesce(sum(quantity) filter (side = 'B' and level <= 3), 0)::bigint as depth_bid_3, coalesce(sum(quantity) filter (side = 'A' and level <= 3), 0)::bigint as depth_ask_3
    from batches b left join depth d using (session_id, batch_id) group by 1, 2, 3, 4))
"""
