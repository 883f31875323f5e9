import json

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import batches as B
from tapeloom.operators import book, ranges
from tapeloom.plans.market import Market
from tapeloom.sources import sessions
from tapeloom.sources.schemas import RECORDS
from tapeloom.sources.synthetic import SyntheticTape

INSTRUMENT = {"instrument_id": 1, "symbol": "SYNZ6", "tick_size_fixed": 250_000_000, "multiplier": 50, "effective_time_ns": 0}


def synthetic(spark, **options):
    spark.dataSource.register(SyntheticTape)
    return spark.read.format("synthetic_tape").options(**options).load()


def test_synthetic_tape_is_seeded_and_clean(spark):
    a, b = (synthetic(spark, sessions=2, seconds=20, seed=3) for _ in range(2))
    assert a.exceptAll(b).count() == 0 and a.count() > 2000
    assert a.exceptAll(synthetic(spark, sessions=2, seconds=20, seed=4)).count() > 0
    market = Market.__new__(Market)
    market.spark, market.records, market.keep, market.made = spark, a, lambda df: df, {}
    market.numbered = B.number_batches(a)
    market.batches = B.assemble(market.numbered)
    assert market.states.filter("anomaly is not null").count() == 0
    assert market.batches.filter("quality_flags <> ''").count() == 0
    assert market.evidence.filter("invalid").count() == 0 and market.evidence.agg(F.sum("n_valid")).first()[0] > 100
    quotes = market.quotes
    assert quotes.filter("mid2 is null").count() == 0
    assert market.batches.filter("kind = 'INITIALIZATION'").count() == 2


def test_best_quotes_equal_a_plain_fold(spark):
    """The relational book against one loop over the tape."""
    rows = synthetic(spark, sessions=1, seconds=10, seed=9)
    want, orders = [], {}
    for r in rows.orderBy("source_ordinal").collect():
        if r.action == "R":
            orders.clear()
        elif r.action == "A":
            orders[r.order_id] = [r.side, r.price_fixed, r.quantity]
        elif r.action == "M":
            orders[r.order_id][1:] = [r.price_fixed, r.quantity]
        elif r.action == "C":
            orders[r.order_id][2] -= r.quantity
            if not orders[r.order_id][2]:
                del orders[r.order_id]
        if r.flags & 128:
            bid = max((p for s, p, _ in orders.values() if s == "B"), default=None)
            ask = min((p for s, p, _ in orders.values() if s == "A"), default=None)
            want.append((bid, sum(q for s, p, q in orders.values() if (s, p) == ("B", bid)), ask, sum(q for s, p, q in orders.values() if (s, p) == ("A", ask))))
    numbered = B.number_batches(rows)
    batches = B.assemble(numbered)
    epochs = book.with_epoch(numbered, batches)
    changes = book.level_changes(book.order_intervals(book.order_state(epochs), epochs))
    got = book.best_quotes(batches, book.level_depth(changes, batches)).orderBy("batch_id").collect()
    assert [(r.bid_price, r.bid_qty, r.ask_price, r.ask_qty) for r in got] == want


def _records(spark):
    rows = [("SYNTH.MBO", 1, 1, 0, i, "A", "B", 100, 1, i + 1, 10 * i, 10 * i + 1, 128, "", i, None, None, 1) for i in range(5)]
    return spark.createDataFrame(rows, RECORDS)


def test_session_folder(spark, tmp_path):
    d = f"{tmp_path}/SYN-0001"
    status = spark.createDataFrame([(1, "TRADING", 0, 1)], "instrument_id long, status string, event_time_ns long, capture_time_ns long")
    sessions.write_session(d, {"session_id": "SYN-0001", "dataset_id": "SYNTH.MBO", "start_ns": 0, "end_ns": 50, "params": {}}, INSTRUMENT, _records(spark), status)
    assert len(sessions.verify_session(spark, d)) == 4
    assert sessions.read_records(spark, d).select("session_id").distinct().collect()[0][0] == "SYN-0001"
    assert sessions.read_status(spark, d, 1).count() == 1 and sessions.read_instrument(spark, d)["multiplier"] == 50 and sessions.read_meta(spark, d)["end_ns"] == 50
    with pytest.raises(Exception, match="invalid status"):
        sessions.read_status(spark, d, 2).collect()
    with pytest.raises(Exception, match="(?i)exists"):
        sessions.write_session(d, {}, {}, _records(spark), status)
    part = next((tmp_path / "SYN-0001" / "session.json").glob("part-*"))
    part.write_text(json.dumps({"session_id": "other"}))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="checksums"):
        sessions.verify_session(spark, d)


@pytest.mark.parametrize("segment", [1, 3, 1024])
def test_levels_by_segments_are_those_of_resting_orders(spark, monkeypatch, segment):
    """Levels carried from one segment to the next, against a plain sum over the orders at each batch."""
    monkeypatch.setattr(book, "SEGMENT", segment)
    m = Market(spark, "/root/testdata/sf0.001")
    want = {}
    for r in m.resting.filter("session_id < '2024-01-04'").collect():
        q, n = want.get((r.session_id, r.batch_id, r.side, r.price_fixed), (0, 0))
        want[r.session_id, r.batch_id, r.side, r.price_fixed] = (q + r.quantity, n + 1)
    found = [r for r in m.depth().filter("session_id < '2024-01-04'").collect()]
    assert want and {(r.session_id, r.batch_id, r.side, r.price_fixed): (r.quantity, r.n_orders) for r in found} == want
    sides = {}
    for r in sorted(found, key=lambda r: r.level):
        sides.setdefault((r.session_id, r.batch_id, r.side), []).append((r.level, r.price_fixed))
    for (_, _, side), ranked in sides.items():
        assert ranked == list(enumerate(sorted((p for _, p in ranked), reverse=side == "B"), 1))


def test_running_totals_over_ranges(spark):
    rows = [("a" if k % 3 else "b", 7 * k - 50, k % 4) for k in range(60)]
    df = spark.createDataFrame(rows, "s string, o long, v long")
    got = {(r.s, r.o): r.t for r in ranges.running_total(df, ["s"], "o", "v", "t", width=16).collect()}
    assert got == {(s, o): sum(v for z, p, v in rows if z == s and p < o) for s, o, _ in rows}


@pytest.mark.parametrize("segment", [3, 1024])
def test_one_fold_of_quotes_gives_what_levels_give(spark, monkeypatch, segment):
    monkeypatch.setattr(book, "SEGMENT", segment)
    m = Market(spark, "/root/testdata/sf0.001")
    want = book.best_quotes(m.batches, m.depth(3))
    got = m.quotes.select(*want.columns)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_marks_upto_each_row(spark):
    rows = [("a" if k % 3 else "b", 7 * k - 50) for k in range(60)]
    marks = [r for k, r in enumerate(rows) if k % 5 == 0 or k in (17, 18, 19)]
    df, held = (spark.createDataFrame(x, "s string, o long") for x in (rows, marks + marks[:3]))
    for width in (16, 4096):
        got = {(r.s, r.o): r.n for r in ranges.marks_upto(df, held, ["s"], "o", "n", width).collect()}
        assert got == {(s, o): sum(z == s and p <= o for z, p in marks) for s, o in rows}


def test_records_are_worked_out_once_to_be_numbered(spark):
    """What is kept is the rows and a small table; before, the totals worked all rows out again."""
    worked = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            worked.add(p.num_rows)
            yield p

    rows = spark.range(3000).selectExpr("'s' || id % 2 as session_id", "id * 1000 as source_ordinal", "if(id % 3 = 0, 128L, 0L) as flags")
    kept = []
    numbered = B.number_batches(rows.mapInArrow(count, rows.schema), keep=lambda df: kept.append(df.localCheckpoint()) or kept[-1])
    assert worked.value == 3000 and [k.count() for k in kept] == [3000, 6]
    found = {(r.session_id, r.source_ordinal // 1000): r.batch_id for r in numbered.collect()}
    assert found == {(f"s{k % 2}", k): sum(j % 3 == 0 for j in range(k % 2, k, 2)) for k in range(3000)} and worked.value == 3000


def test_overlapping_windows_meet_by_buckets_near_their_length(spark, monkeypatch):
    """Against all pairs: windows that touch, long ones, equal starts, equal and turned ones. The query's buckets are no
    days, in which all windows of a day met."""
    import random

    from tapeloom.plans import market

    random.seed(5)
    rows = [(k, k % 2, s, s + random.choice([0, 3, 10, 400, -5])) for k, s in enumerate(random.randrange(-100, 300) for _ in range(120))]
    windows = spark.createDataFrame(rows, "id long, instrument_id long, start_ns long, end_ns long")
    want = {(i, a, b) for a, i, s, e in rows for b, j, t, u in rows if i == j and a < b and s <= u and t <= e}
    for bucket in (7, 1000):
        got = [tuple(r) for r in B.overlapping_windows(windows, bucket).select("instrument_id", "a_id", "b_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    seen, real = [], B.points_in_intervals
    monkeypatch.setattr(B, "points_in_intervals", lambda *a: seen.append(a[-1]) or real(*a))
    assert market.overlaps(spark, "/root/testdata/sf0.001").count() > 0 and seen and max(seen) <= market.HOUR
