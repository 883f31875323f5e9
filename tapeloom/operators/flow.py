"""Trailing market features of a client, at the times at which batches reach it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.ranges import bucket_of
from tapeloom.sources.schemas import TICK


def batch_flow(numbered: DataFrame, batches: DataFrame) -> DataFrame:
    """(session_id, batch_id, obs_ns, trade_signed, trade_count, cancel_bid, cancel_ask, add_bid, add_ask)
    of each batch that is no initialization. A cancel right after a fill of its order in the batch is
    an execution, and no cancel."""
    w = Window.partitionBy("session_id", "batch_id").orderBy("source_ordinal")
    executed = (F.lag("action").over(w) == "F") & (F.lag("order_id").over(w) == F.col("order_id"))
    rows = numbered.withColumn("executed", F.coalesce(executed, F.lit(False)))
    qty = lambda held: F.coalesce(F.sum(F.when(held, F.col("quantity"))), F.lit(0))
    bid, ask, of = F.col("side") == "B", F.col("side") == "A", lambda a: F.col("action") == a
    flow = rows.groupBy("session_id", "batch_id").agg(
        (qty(of("T") & bid) - qty(of("T") & ask)).alias("trade_signed"), F.count_if(of("T")).alias("trade_count"),
        qty(of("C") & bid & ~F.col("executed")).alias("cancel_bid"), qty(of("C") & ask & ~F.col("executed")).alias("cancel_ask"),
        qty(of("A") & bid).alias("add_bid"), qty(of("A") & ask).alias("add_ask"),
    )
    live = batches.filter("kind = 'LIVE'").select("session_id", "batch_id", F.col("capture_time_ns").alias("obs_ns"))
    return live.join(flow, ["session_id", "batch_id"])


FLOWS = ("trade_signed", "trade_count", "cancel_bid", "cancel_ask", "add_bid", "add_ask")


class Trailing:
    """Sums over (t - window, t] at each row of ``rows`` (by, at), with time cut into ranges of one window.

    A window ends in its row's range and begins in the range before. So each row goes to its own range, where it
    comes at t, and to the next, where it leaves at t + window: the sum is the total of the range before and what
    came, less what left, a running sum. Work grows with the rows, not with rows x window, and a task has
    two ranges of a key.
    """

    def __init__(self, rows: DataFrame, by: list[str], at: str, window: int, ties: str):
        self.names = rows.columns
        # Both are made of one row, as the branches of a union would each work out and hold what ``rows`` come from.
        place = lambda own: F.struct((bucket_of(at, window) + (0 if own else 1)).alias("_range"), (F.col(at) + F.lit(0 if own else window).cast("long")).alias("_key"), F.lit(own).alias("_own"))
        twice = rows.withColumn("_place", F.explode(F.array(place(True), place(False))))
        self.rows, self.ties = twice.select(*rows.columns, "_place.*", F.col(at).alias("_t")), ties
        self.whole = Window.partitionBy(*by, "_range")
        self.upto = self.whole.orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)
        #: In order of time, the range before first.
        self.line = self.whole.orderBy("_t", ties)

    def sum(self, v: Column) -> Column:
        left = F.coalesce(F.sum(F.when(~F.col("_own"), v)).over(self.whole), F.lit(0))
        return left + F.sum(F.when(F.col("_own"), v).otherwise(-v)).over(self.upto)

    def first(self, name: str) -> Column:
        """The value of the window's first row, by a column ``name`` and the one that ``following`` made of it."""
        out = F.max_by(f"_next_{name}", F.when(~F.col("_own"), F.struct("_t", self.ties))).over(self.upto)
        return F.coalesce(out, F.first(name).over(self.line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))

    def following(self, *names: str) -> None:
        self.rows = self.rows.withColumns({f"_next_{n}": F.lead(n).over(self.line) for n in names})

    def with_columns(self, **columns: Column) -> DataFrame:
        return self.rows.withColumns(columns).filter("_own").select(*self.names, *columns)


def trailing_flow(flow: DataFrame, window_ns: int) -> DataFrame:
    """Sums of each flow over (obs - window, obs], at every batch."""
    t = Trailing(flow.select("session_id", "batch_id", "obs_ns", *(F.col(n).alias(f"_{n}") for n in FLOWS)), ["session_id"], "obs_ns", window_ns, "batch_id")
    return t.with_columns(**{n: t.sum(F.col(f"_{n}")) for n in FLOWS}).select("session_id", "batch_id", "obs_ns", *FLOWS)


def mid_moves(samples: DataFrame, vol_ns: int, change_ns: int) -> DataFrame:
    """(session_id, batch_id, obs_ns, mid_vol, mid_change) at each valid mid (session_id, batch_id,
    obs_ns, mid2), in ticks.

    The volatility is the population deviation of the changes between samples that both lie in the
    window: of the window's changes the first is left out, as it comes from before. So a change is only asked for
    where both of its samples lie in two ranges side by side. Sums are of whole half ticks, so they are exact.
    """
    vol = Trailing(samples.select("session_id", "batch_id", "obs_ns", "mid2"), ["session_id"], "obs_ns", vol_ns, "batch_id")
    change = ((F.col("mid2") - F.lag("mid2").over(vol.line)) / TICK).cast("long")
    vol.rows = vol.rows.withColumn("k", F.coalesce(change, F.lit(0)))
    vol.following("k")
    square = F.col("k") * F.col("k")
    rows = vol.with_columns(n=vol.sum(F.lit(1)) - 1, s1=vol.sum(F.col("k")) - vol.first("k"), s2=vol.sum(square) - vol.first("k") * vol.first("k"))
    near = Trailing(rows, ["session_id"], "obs_ns", change_ns, "batch_id")
    near.following("mid2")
    rows = near.with_columns(near=near.sum(F.lit(1)), from2=near.first("mid2"))
    spread = F.sqrt((F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double")) / F.col("n") / 2
    moved = (F.col("mid2") - F.col("from2")) / (2.0 * TICK)
    return rows.select("session_id", "batch_id", "obs_ns", F.when(F.col("n") < 1, 0.0).otherwise(spread).alias("mid_vol"), F.when(F.col("near") < 2, 0.0).otherwise(moved).alias("mid_change"))


def quote_age(quotes: DataFrame) -> DataFrame:
    """(session_id, batch_id, quote_age_ms) at each live batch (obs_ns): since the best prices or sizes
    last changed; 0 before any change."""
    w = Window.partitionBy("session_id").orderBy("obs_ns", "batch_id")
    best = F.struct("bid_price", "bid_qty", "ask_price", "ask_qty")
    none = F.expr("named_struct('bid_price', cast(null as bigint), 'bid_qty', cast(null as bigint), 'ask_price', cast(null as bigint), 'ask_qty', cast(null as bigint))")
    changed = ~best.eqNullSafe(F.lag(best, 1).over(w)) & ~(F.lag("obs_ns").over(w).isNull() & best.eqNullSafe(none))
    rows = quotes.withColumn("changed", F.when(changed, F.col("obs_ns")))
    last = F.last("changed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("session_id", "batch_id", F.coalesce(F.greatest(F.col("obs_ns") - last, F.lit(0)) / 1_000_000.0, F.lit(0.0)).alias("quote_age_ms"))
