"""A client's estimate of the queue ahead of its order, from what has been delivered to it.

When an order is sent, the orders that the client sees at its price are frozen as a cohort. Later only those
that kept their place count, with the quantity that they have by then. An order keeps its place while it
rests at one price with one priority, so the cohort at a later time is who rests then and has rested
without a break since before the order was sent: one range join at the times asked for, no fold over time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.book import BUCKET
from tapeloom.operators.ranges import points_in_intervals


def placed_intervals(intervals: DataFrame, numbered: DataFrame, batches: DataFrame) -> DataFrame:
    """``intervals`` with ``since``, the ordinal since which the order keeps its place, ``added_ns``, its batch's
    time if a live batch added the order there, and of the order's place before at that level, if it still
    stood when that batch began, ``before`` and ``before_added_ns``."""
    place = ["session_id", "order_id", "side", "price_fixed", "priority"]
    places = intervals.groupBy(*place).agg(F.min("ord_from").alias("since"), F.max("ord_to").alias("until"), F.min_by("batch_from", "ord_from").alias("batch_id"))
    live = batches.select("session_id", "batch_id", "first_ordinal", F.when(F.col("kind") == "LIVE", F.col("proxy_time_ns")).alias("live_ns"))
    adds = numbered.filter("action = 'A'").select("session_id", "batch_id", "order_id", "side", "price_fixed").distinct().withColumn("added", F.lit(True))
    told = places.join(live, ["session_id", "batch_id"]).join(adds, ["session_id", "batch_id", "order_id", "side", "price_fixed"], "left")
    told = told.withColumn("added_ns", F.when(F.col("added"), F.col("live_ns")))
    w = Window.partitionBy("session_id", "order_id", "side", "price_fixed").orderBy("since")
    told = told.withColumn("last", F.lag(F.struct("since", "until", "added_ns")).over(w))
    stood = F.col("last.until") > F.col("first_ordinal")
    told = told.select(*place, "since", "added_ns", F.when(stood, F.col("last.since")).alias("before"), F.when(stood, F.col("last.added_ns")).alias("before_added_ns"))
    return intervals.join(told, place)


def asked_points(orders: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, session_id, side, price_fixed, sent_ns, expected_ns, ask, at, ref): what ``queue_estimates`` asks for."""
    at = lambda kind, at, ref: F.struct(F.lit(kind).alias("ask"), F.col(at).alias("at"), F.col(ref).alias("ref"))
    asks = F.explode(F.array(at("FIRST", "sent_ordinal", "sent_ordinal"), at("NOW", "asked_ordinal", "sent_ordinal"), at("TRUE", "now_ordinal", "arrived_ordinal")))
    points = orders.select(*keys, "session_id", "side", F.col("limit").alias("price_fixed"), "sent_ns", "expected_ns", asks.alias("x"))
    return points.select("*", "x.*").drop("x").filter("at is not null")


def asked_orders(orders: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(session_id, order_id, side, price_fixed): who rests where and when ``queue_estimates`` asks. It needs no interval
    of others, and ``placed_intervals`` keeps orders apart by these columns."""
    level = ["session_id", "side", "price_fixed"]
    points = asked_points(orders, keys).select(*level, "at").distinct()
    return points_in_intervals(points, intervals.select(*level, "order_id", "ord_from", "ord_to"), level, "at", "ord_from", "ord_to", BUCKET).select("session_id", "order_id", "side", "price_fixed").distinct()


def queue_estimates(orders: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q_ahead_est, q_ahead_upper, q_insertion_uncertain, q_depleted, q_depleted_frac, true_ahead) of
    ``orders`` (keys, session_id, side, limit, sent_ordinal and sent_ns, the last batch delivered when the
    order was sent, expected_ns, when it should arrive, asked_ordinal, the last batch delivered when the
    estimate is asked for, arrived_ordinal and now_ordinal, the market's at its arrival and at that time).

    The cohort's quantity is the estimate. Adds of live batches after sent_ns and until expected_ns may stand
    ahead too, and make the upper bound; an order that was counted already and comes again in one batch is none
    of them. ``true_ahead`` is the market's quantity that stood before the order arrived. An empty cohort has a
    depleted part of 0.
    """
    points = asked_points(orders, keys)
    held = points_in_intervals(points, placed.drop("batch_from", "batch_to"), ["session_id", "side", "price_fixed"], "at", "ord_from", "ord_to", BUCKET)
    cohort = F.col("since") <= F.col("ref")
    entry = lambda c: (F.col(c) > F.col("sent_ns")) & (F.col(c) <= F.col("expected_ns"))
    counted = (F.col("before") <= F.col("ref")) | entry("before_added_ns")
    uncertain = ~cohort & F.coalesce(entry("added_ns"), F.lit(False)) & ~F.coalesce(counted, F.lit(False))
    qty = lambda ask, of: F.coalesce(F.sum(F.when((F.col("ask") == ask) & of, F.col("quantity"))), F.lit(0))
    sums = held.groupBy(*keys).agg(qty("FIRST", cohort).alias("first"), qty("NOW", cohort).alias("est"), qty("NOW", uncertain).alias("more"), qty("TRUE", cohort).alias("true"))
    rows = orders.join(sums, keys, "left").fillna(0, ["first", "est", "more", "true"])
    gone = F.col("first") - F.col("est")
    return rows.select(*keys, F.col("est").alias("q_ahead_est"), (F.col("est") + F.col("more")).alias("q_ahead_upper"), F.col("more").alias("q_insertion_uncertain"), gone.alias("q_depleted"),
                       F.when(F.col("first") > 0, gone / F.col("first")).otherwise(0.0).alias("q_depleted_frac"), F.col("true").alias("true_ahead"))


QUEUES_SQL = """
places as (select session_id, order_id, side, price_fixed, priority, min(ord_from) as since, max(ord_to) as until from intervals group by 1, 2, 3, 4, 5),
opened_places as (
  select p.*, b.first_ordinal, case when b.kind = 'LIVE' and exists (select 1 from numbered a where a.session_id = p.session_id and a.batch_id = n.batch_id and a.action = 'A' and a.order_id = p.order_id and a.side = p.side and a.price_fixed = p.price_fixed)
    then b.proxy_time_ns end as added_ns
  from places p join numbered n on n.session_id = p.session_id and n.source_ordinal = p.since join batches b on b.session_id = n.session_id and b.batch_id = n.batch_id),
known_places as (
  select p.*, x.since as before, x.added_ns as before_added_ns from opened_places p left join lateral (
    select since, until, added_ns from opened_places o where o.session_id = p.session_id and o.order_id = p.order_id and o.side = p.side and o.price_fixed = p.price_fixed and o.since < p.since order by o.since desc limit 1) x on x.until > p.first_ordinal),
placed as (select i.*, k.since, k.added_ns, k.before, k.before_added_ns from intervals i join known_places k using (session_id, order_id, side, price_fixed, priority))
"""
