"""Joins that meet only what lies near: against plain loops."""

import random

from tapeloom.operators import queues, worlds
from tapeloom.operators.ranges import points_in_mixed_intervals


def test_short_and_long_intervals_meet_their_points(spark):
    rng = random.Random(5)
    spans = [(k, a, a + rng.choice([1, 3, 16, 17, 40, 900])) for k, a in enumerate(rng.randrange(-500, 500) for _ in range(60))]
    at = sorted({rng.randrange(-600, 1500) for _ in range(300)})
    points, intervals = spark.createDataFrame([("s", p) for p in at], "s string, at long"), spark.createDataFrame([("s", *x) for x in spans], "s string, k long, lo long, hi long")
    got = sorted((r["at"], r.k) for r in points_in_mixed_intervals(points, intervals, ["s"], "at", "lo", "hi", 16, 128).collect())
    assert got == sorted((p, k) for p in at for k, lo, hi in spans if lo <= p < hi)


def test_the_last_of_the_orders_ahead_clears_the_level_and_only_asked_orders_are_taken(spark):
    # Order 1 keeps its place through two intervals; 2 comes later, 3 stands at another price, 4 has come again.
    rows = [(1, "B", 10, 100, 100, 110), (1, "B", 10, 100, 110, 150), (2, "B", 10, 130, 130, 190), (3, "B", 11, 90, 90, 300), (4, "B", 10, 95, 95, 105), (4, "B", 10, 180, 180, 400)]
    intervals = spark.createDataFrame([("s", *x) for x in rows], "session_id string, order_id long, side string, price_fixed long, priority long, ord_from long, ord_to long")
    ours = spark.createDataFrame([("t", "B1", "L1", "s", "B", 10, 104), ("u", "B1", "L1", "s", "B", 12, 104)], "task_id string, policy_id string, scenario_id string, session_id string, side string, price_fixed long, last_ordinal long")
    assert [(r.task_id, r.clear_ordinal) for r in worlds.clears(ours, intervals).collect()] == [("t", 150)]
    orders = spark.createDataFrame([("t", "s", "B", 10, 104, 1, 2, 140, 104, None)], "task_id string, session_id string, side string, limit long, sent_ordinal long, sent_ns long, expected_ns long, asked_ordinal long, arrived_ordinal long, now_ordinal long")
    assert {r.order_id for r in queues.asked_orders(orders, intervals, ["task_id"]).collect()} == {1, 2, 4}
