"""Every registered query of the reference's operators against its SQL in DuckDB, at the smallest size."""

import decimal

import duckdb
import pytest

from tapeloom import plans
from tapeloom.plans import learning

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns: list[str], found):
    """Whole numbers as they are, floats to nine digits; never through pandas, which makes nullable longs floats."""
    def show(v):
        if v is None or (isinstance(v, float) and v != v):
            return "NULL"
        return f"{v:.9g}" if isinstance(v, (float, decimal.Decimal)) else str(v)

    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(show(r[k]) for k in at) for r in found)


def test_every_query_has_its_sql():
    assert set(QUERIES) - set(ORACLE) == set(learning.QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_the_tape_puts_the_queries_to_the_test(duck):
    """Most tasks can be judged, and every status, mechanism and reason comes."""
    con = duckdb.connect()
    con.sql("create view events as select * from '/root/testdata/sf0.01/events.parquet'")
    reasons = dict(con.sql(f"select reason, count(*) from ({ORACLE['unevaluable_tasks']}) group by 1").fetchall())
    assert 2 * reasons[None] > sum(reasons.values()) and len(reasons) >= 3
    found = con.sql(f"select status, mechanism, count(*), count(is_ticks), count(deadline_cost_ticks) from ({ORACLE['world_outcomes']}) group by 1, 2").fetchall()
    assert {"QUEUE_DEPLETION", "TRADE_THROUGH", "AGGRESSIVE"} <= {m for s, m, *_ in found if s == "COMPLETED_ON_TIME"}
    assert {s for s, *_ in found} == {"COMPLETED_ON_TIME", "DEADLINE_MISS", "TECHNICALLY_UNEVALUABLE"}
    assert sum(r[4] for r in found) > sum(r[2] for r in found) / 2
    assert con.sql(f"select count(markout_ticks) > count(*) / 2 from ({ORACLE['markouts']})").fetchall() == [(True,)]
