"""Connected components of an edge table, by large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi-join back that is broadcast or
that Spark can split, so a hub's edges need not meet in one task. Each round is written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import BROADCAST_ROWS, cut, uncompiled

#: Rounds over so few edges are not compiled.
FEW_EDGES = 200_000


def _joined(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` with the least neighbour of their a. Of few edges it is broadcast; else it is written first,
    so that the join shuffles both sides itself and Spark can split a hub."""
    return edges.join(F.broadcast(least) if 2 * n <= BROADCAST_ROWS else cut(least, "least"), "a")


def _pairs(edges: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """(a, b) of each of ``ends`` of every row. An explode reads ``edges`` once, where a union would plan and run all
    that makes it once for each."""
    return edges.select(F.inline(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ends))))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = _pairs(edges, ("a", "b"), ("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _joined(both, least, n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Takes edges with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return _pairs(_joined(edges, least, n), ("a", "m"), ("b", "m")).filter("a > b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component being the smallest node
    reachable. Self-loops, repeated edges and null ends are allowed; null ends are ignored.
    A node that only has a self-loop is its own component. No edges: no rows.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops = e.filter("a = b").select(F.col("a").alias("node"))
    e, seen = e.filter("a > b"), None
    n = e.count()
    with uncompiled(e.sparkSession, n <= FEW_EDGES):
        for _ in range(max_rounds if n else 0):
            # A large star has an edge for each edge, a small one no more than it was given.
            e = cut(_small_star(_large_star(e, n), n), "stars")
            now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == seen or not now[0]:
                break
            seen = now
        else:
            if n:
                raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node")).distinct().unionByName(loops).distinct()
    lone = roots.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(lone)
