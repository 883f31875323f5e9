"""Checks of the rebuilt book, as queries that return what breaks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broken_levels(depth: DataFrame) -> DataFrame:
    """Levels without quantity, without orders, or out of price order on their side."""
    from pyspark.sql import Window

    before = F.lag("price_fixed").over(Window.partitionBy("session_id", "batch_id", "side").orderBy("level"))
    wrong = F.when(F.col("side") == "B", before <= F.col("price_fixed")).otherwise(before >= F.col("price_fixed"))
    return depth.withColumn("unordered", F.coalesce(wrong, F.lit(False))).filter("quantity <= 0 or n_orders <= 0 or unordered")


def crossed_books(quotes: DataFrame) -> DataFrame:
    """Batches after which the best bid is not below the best ask."""
    return quotes.filter("bid_price >= ask_price")


def tallies(batches: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(what, kind, n): batch kinds, quality flags and book anomalies."""
    kinds = batches.groupBy(F.col("kind")).agg(F.count("*").alias("n")).select(F.lit("batch").alias("what"), "kind", "n")
    flags = batches.filter("quality_flags <> ''").select(F.explode(F.split("quality_flags", ",")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("flag").alias("what"), "kind", "n")
    bad = anomalies.groupBy(F.col("anomaly").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("anomaly").alias("what"), "kind", "n")
    return kinds.unionByName(flags).unionByName(bad)
