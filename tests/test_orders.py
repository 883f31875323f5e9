"""The client's side against plain loops: its queue estimate, its book in order of delivery, its state by reports."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import batches as B
from tapeloom.operators import book, commands, delivery, queues
from tapeloom.operators.worlds import worlds_sql
from tapeloom.sources.schemas import LAST, SNAPSHOT

RECORD = "session_id string, source_ordinal long, action string, side string, price_fixed long, quantity long, order_id long, event_time_ns long, capture_time_ns long, flags long"
TICK = 250_000_000


def random_tape(seed, n=400, session="s"):
    """Records in batches of one to three; now and then the book is rebuilt."""
    rng, rows, live, at = random.Random(seed), [], {}, 0
    while len(rows) < n:
        size, t = rng.randint(1, 3), 1_000 * (at + 1)
        init = rng.random() < 0.02
        if init:
            live = {}
        for k in range(size):
            last = LAST if k == size - 1 else 0
            order = rng.choice(list(live)) if live and rng.random() < 0.5 and not init else rng.randrange(40)
            side = live.get(order, rng.choice("BA"))
            price = TICK * (400 + (rng.randrange(3) if side == "A" else -1 - rng.randrange(3)))
            action = "A" if init or order not in live or rng.random() < 0.1 else rng.choice("CCMM")
            rows.append((session, at, action, side, price, rng.randint(1, 6), order, t, t + rng.randrange(300), last | (SNAPSHOT if init else 0)))
            live[order] = side
            at += 1
    return rows


def batched(rows):
    out, now = [], []
    for i, r in enumerate(rows):
        now.append((i, r))
        if r[-1] & LAST:
            out.append(now)
            now = []
    return out + ([now] if now else [])


def tables(spark, rows):
    numbered = B.number_batches(spark.createDataFrame(rows, RECORD)).cache()
    return numbered, B.assemble(numbered).cache()


def best(book_):
    def side(s, f):
        prices = [o[1] for o in book_.values() if o[0] == s]
        p = f(prices) if prices else None
        return p, sum(o[2] for o in book_.values() if o[0] == s and o[1] == p) if prices else None

    return (*side("B", max), *side("A", min))


@pytest.mark.parametrize("seed", [1, 2])
def test_the_clients_book_folds_batches_as_they_are_delivered(spark, seed):
    rows = random_tape(seed)
    numbered, found = tables(spark, rows)
    kinds = {r.batch_id: r.kind for r in found.collect()}
    groups = batched(rows)
    held = lambda k: 5_500 if k % 4 == 0 else 0
    order = sorted(range(len(groups)), key=lambda k: (max(r[8] for _, r in groups[k]) + held(k), k))
    assert order != sorted(order)
    # Priorities and snapshots go by the order of delivery.
    book_, want, at = {}, [], 0
    for place, k in enumerate(order):
        if kinds[k] == "INITIALIZATION":
            book_ = {}
        for _, (_, _, action, side, price, qty, oid, *_r) in groups[k]:
            old = book_.get(oid)
            if action == "A" and old is None:
                book_[oid] = (side, price, qty, at)
            elif action == "C" and old:
                left = old[2] - min(old[2], qty)
                book_.pop(oid)
                if left:
                    book_[oid] = (*old[:2], left, old[3])
            elif action == "M" and old:
                book_[oid] = (old[0], price, qty, at if price != old[1] or qty > old[2] else old[3])
            at += 1
        want.append((place, k, *best(book_)))
    got = delivery.client_quotes(numbered, found, F.when(F.col("batch_id") % 4 == 0, 5_500).otherwise(0))
    assert sorted((r.place, r.batch_id, r.bid_price, r.bid_qty, r.ask_price, r.ask_qty) for r in got.collect()) == want


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_the_queue_estimate_against_a_registry_that_follows_each_batch(spark, seed):
    rows = random_tape(seed, 500)
    numbered, found = tables(spark, rows)
    info = {r.batch_id: r for r in found.collect()}
    groups = batched(rows)
    books, book_ = [], {}
    for k, g in enumerate(groups):
        if info[k].kind == "INITIALIZATION":
            book_ = {}
        for i, (_, _, action, side, price, qty, oid, *_r) in g:
            old = book_.get(oid)
            if action == "A" and old is None:
                book_[oid] = (side, price, qty, i)
            elif action == "C" and old:
                left = old[2] - min(old[2], qty)
                book_.pop(oid)
                if left:
                    book_[oid] = (*old[:2], left, old[3])
            elif action == "M" and old:
                book_[oid] = (old[0], price, qty, i if price != old[1] or qty > old[2] else old[3])
        books.append(dict(book_))
    rng, asked, want = random.Random(seed), [], {}
    for n in range(120):
        k0 = rng.randrange(len(groups) - 2)
        k1 = rng.randrange(k0, min(len(groups), k0 + 60))
        side = rng.choice("BA")
        levels = sorted({o[1] for o in books[k0].values() if o[0] == side})
        if not levels:
            continue
        limit, p0 = rng.choice(levels), info[k0].proxy_time_ns
        expected = p0 + rng.choice([0, 1_000, 4_000, 20_000])
        asked.append((n, "s", side, limit, info[k0].last_ordinal, p0, expected, info[k1].last_ordinal, info[k0].last_ordinal, info[k1].last_ordinal))
        cohort = {o: v[3] for o, v in books[k0].items() if v[:2] == (side, limit)}
        first, more = sum(books[k0][o][2] for o in cohort), {}
        for k in range(k0 + 1, k1 + 1):
            now = books[k]
            if info[k].kind == "LIVE" and p0 < info[k].proxy_time_ns <= expected:
                for _, (_, _, action, s, price, _q, oid, *_r) in groups[k]:
                    if action == "A" and s == side and price == limit and oid not in cohort and oid not in more and oid in now:
                        more[oid] = now[oid][3]
            for registry in (cohort, more):
                for o in list(registry):
                    if o not in now or now[o][:2] != (side, limit) or now[o][3] != registry[o]:
                        del registry[o]
        est, extra = (sum(books[k1][o][2] for o in r) for r in (cohort, more))
        want[n] = (est, est + extra, extra, first - est, (first - est) / first if first else 0.0, est)
    epochs = book.with_epoch(numbered, found)
    placed = queues.placed_intervals(book.order_intervals(book.order_state(epochs), epochs), numbered, found)
    orders = spark.createDataFrame(asked, "n long, session_id string, side string, limit long, sent_ordinal long, sent_ns long, expected_ns long, asked_ordinal long, arrived_ordinal long, now_ordinal long")
    got = {r.n: tuple(r)[1:] for r in queues.queue_estimates(orders, placed, ["n"]).collect()}
    assert got == want and any(v[2] for v in want.values()) and any(v[3] for v in want.values())


KEYS = ("t:1:B", "B1", "L1", "t")


def told(spark, events):
    """Reports (id, command, kind, exchange, delivery, executed)."""
    rows = [(*KEYS, i, c, k, "", x, d, e, None, None) for i, c, k, x, d, e in events]
    return spark.createDataFrame(rows, "task_id string, policy_id string, scenario_id string, session_id string, report_id string, command_id string, kind string, reason string, exchange_ns long, delivery_ns long, executed int, price long, mechanism string")


def sent(spark, *events):
    return spark.createDataFrame([(*KEYS, c, k, t) for c, k, t in events], "task_id string, policy_id string, scenario_id string, session_id string, command_id string, kind string, decision_ns long")


@pytest.mark.parametrize(
    "events, state, executed, reserved, completed",
    [
        ([("a", "P", "ACCEPTED", 5, 6, 0)], "WORKING", 0, 1, None),
        ([("a", "P", "ACCEPTED", 5, 6, 0), ("f", "P", "FILL", 7, 8, 1), ("f", "P", "FILL", 7, 9, 1)], "FILLED", 1, 0, 7),
        ([("r", "P", "REJECTED", 5, 6, 0), ("a", "P", "ACCEPTED", 5, 7, 0)], "REJECTED", 0, 0, None),
        ([("a", "P", "ACCEPTED", 5, 6, 0), ("c", "C", "CANCEL_REJECTED_TERMINAL", 20, 21, 1), ("f", "P", "FILL", 15, 22, 1)], "FILLED", 1, 0, 15),
        ([("a", "P", "ACCEPTED", 5, 6, 0), ("x", "P", "TECHNICAL_RESET", 9, 10, 0), ("a2", "P", "ACCEPTED", 5, 11, 0)], "TECHNICAL", 0, 0, None),
        ([("a", "P", "ACCEPTED", 5, 6, 0), ("c", "C", "CANCELLED", 20, 21, 0), ("f", "P", "FILL", 19, 30, 1)], "FILLED", 1, 0, 19),
    ],
)
def test_a_clients_state(spark, events, state, executed, reserved, completed):
    own = sent(spark, ("P", "PASSIVE_LIMIT", 1), *([("C", "CANCEL", 12)] if any(e[1] == "C" for e in events) else []))
    r = commands.client_orders(own, told(spark, events)).first()
    assert (r.state, r.executed, r.reserved, r.completion_ns) == (state, executed, reserved, completed) and r.most <= 1
    assert r.n_reports == len({e[0] for e in events})


def test_the_first_delivery_of_a_report_counts(spark):
    both = told(spark, [("f", "P", "FILL", 7, 9, 1), ("f", "P", "REJECTED", 7, 8, 0)])
    assert [r.kind for r in commands.first_deliveries(both).collect()] == ["REJECTED"]


def test_halts_and_outcomes_are_put_to_the_test():
    import duckdb

    from tapeloom.plans import orders

    con = duckdb.connect()
    con.sql("create view events as select * from '/root/testdata/sf0.01/events.parquet'")
    kinds = dict(con.sql(f"select kind, count(*) from ({orders.ORACLE_SQL['reports']}) group by 1").fetchall())
    assert {"ACCEPTED", "REJECTED", "FILL", "CANCELLED", "AGGRESSIVE_UNFILLED"} <= set(kinds)
    gaps = con.sql(f"select sum(n_overtaken), sum(n_other_mid) from ({orders.ORACLE_SQL['plane_gap']})").fetchone()
    assert min(gaps) > 0
    queue = con.sql(f"select count(*), count(*) filter (q_ahead_est <> true_ahead), count(*) filter (q_depleted > 0) from ({orders.ORACLE_SQL['queue_cohort']})").fetchone()
    assert queue[0] > 100 and queue[2] > 0
    assert "halts" in worlds_sql()
