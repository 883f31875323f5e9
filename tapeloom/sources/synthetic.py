"""A seeded order tape as a Spark data source, one partition for each session.

    spark.dataSource.register(SyntheticTape)
    spark.read.format("synthetic_tape").option("sessions", 4).option("seconds", 120).option("seed", 0).load()
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "session_id string, source_ordinal long, action string, side string, price_fixed long, quantity long, order_id long, event_time_ns long, capture_time_ns long, flags long"


class _Session(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.sessions, self.seconds, self.seed, self.rate = (int(options.get(k, d)) for k, d in (("sessions", 1), ("seconds", 60), ("seed", 0), ("rate", 150)))

    def partitions(self):
        return [_Session(k) for k in range(self.sessions)]

    def read(self, partition):
        """A random walk of adds, cancels, size changes and executions around a mid; every session opens
        with a snapshot. Only orders that rest are touched, so the tape has no anomalies."""
        import random

        rng = random.Random(f"{self.seed}:{partition.number}")
        name, now, ordinal, next_id, mid = f"SYN-{partition.number:04d}", 10**12, 0, 1, 400
        book: dict[int, list] = {}
        tick = 250_000_000

        def row(action, side, price, qty, order, flags):
            nonlocal ordinal
            ordinal += 1
            return name, ordinal - 1, action, side, price * tick, qty, order, now, now + 20_000, flags

        opening = [("B", mid - 1 - k // 3) for k in range(12)] + [("A", mid + 1 + k // 3) for k in range(12)]
        yield row("R", "N", 0, 0, 0, 32)
        for k, (side, price) in enumerate(opening):
            book[next_id] = [side, price, rng.randint(1, 9)]
            yield row("A", side, price, book[next_id][2], next_id, 32 | (128 if k == len(opening) - 1 else 0))
            next_id += 1
        end = now + self.seconds * 10**9
        while True:
            now += int(rng.expovariate(self.rate) * 1e9) + 1
            if now > end:
                return
            bids, asks = ([p for s, p, _ in book.values() if s == side] for side in "BA")
            best = {"B": max(bids, default=mid - 1), "A": min(asks, default=mid + 1)}
            kind, side = rng.random(), rng.choice("BA")
            mine = [i for i, o in book.items() if o[0] == side]
            if kind < 0.5 or len(mine) < 6:
                price = min(best["A"] - 1, best["B"] + rng.randint(-3, 1)) if side == "B" else max(best["B"] + 1, best["A"] + rng.randint(-1, 3))
                book[next_id] = [side, price, rng.randint(1, 9)]
                yield row("A", side, price, book[next_id][2], next_id, 128)
                next_id += 1
            elif kind < 0.7:
                i = rng.choice(mine)
                s, p, q = book.pop(i)
                yield row("C", s, p, q, i, 128)
            elif kind < 0.8:
                i = rng.choice(mine)
                book[i][2] = rng.randint(1, 9)
                yield row("M", book[i][0], book[i][1], book[i][2], i, 128)
            else:
                i = min((i for i in mine if book[i][1] == best[side]))
                s, p, q = book[i]
                n = rng.randint(1, q)
                yield row("T", "A" if s == "B" else "B", p, n, 0, 0)
                yield row("F", s, p, n, i, 0)
                yield row("C", s, p, n, i, 128)
                book[i][2] -= n
                if not book[i][2]:
                    del book[i]


class SyntheticTape(DataSource):
    @classmethod
    def name(cls):
        return "synthetic_tape"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
