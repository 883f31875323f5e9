"""A client's own book: batches folded in the order in which they are delivered.

A batch that is held up on the way is overtaken by later ones, so the client's book is another than the
market's at every time until all is delivered, and orders may be cancelled there before they are added.
Records are numbered anew by delivery; the folds of the book are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators import book
from tapeloom.operators.ranges import running_total

#: Nanoseconds of deliveries that are numbered together.
RANGE_NS = 3_600_000_000_000


def delivered_batches(batches: DataFrame, held_ns: Column | None = None) -> DataFrame:
    """``batches`` in order of delivery: deliver_ns is capture_time_ns and what the batch is held up, ``place`` and
    ``records_before`` count the batches and records of the session delivered before it. Of equal times the
    earlier batch comes first. A constant delay of all batches changes no order, so one numbering serves every
    latency scenario."""
    held = F.lit(0) if held_ns is None else held_ns
    rows = batches.withColumn("deliver_ns", F.col("capture_time_ns") + held.cast("long")).withColumn("_one", F.lit(1).cast("long"))
    rows = running_total(rows, ["session_id"], "deliver_ns", "_one", "place", RANGE_NS, "batch_id")
    return running_total(rows, ["session_id"], "deliver_ns", "n_records", "records_before", RANGE_NS, "batch_id").drop("_one")


def renumbered(numbered: DataFrame, delivered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and batches numbered by delivery, as the folds of the book take them: batch_id is the place,
    source_ordinal the place of the record; market_batch_id is the batch's own number."""
    w = Window.partitionBy("session_id", "batch_id").orderBy("source_ordinal")
    keys = delivered.select("session_id", "batch_id", "place", "records_before")
    rows = numbered.join(keys, ["session_id", "batch_id"]).withColumn("source_ordinal", F.col("records_before") + F.row_number().over(w) - 1)
    records = rows.withColumn("batch_id", F.col("place")).drop("place", "records_before")
    last = F.col("records_before") + F.col("n_records") - 1
    own = delivered.withColumns({"market_batch_id": F.col("batch_id"), "first_ordinal": F.col("records_before"), "last_ordinal": last}).withColumn("batch_id", F.col("place"))
    return records, own.drop("place", "records_before")


def client_quotes(numbered: DataFrame, batches: DataFrame, held_ns: Column | None = None, keep=lambda df: df) -> DataFrame:
    """(session_id, place, batch_id, deliver_ns, bid_price, bid_qty, ask_price, ask_qty, mid2): the client's best
    prices after each batch, in order of delivery."""
    records, own = renumbered(numbered, keep(delivered_batches(batches, held_ns)))
    records, own = keep(records), keep(own)
    epochs = book.with_epoch(records, own, keep)
    intervals = book.order_intervals(keep(book.order_state(epochs)), epochs, keep)
    quotes = book.quotes_after(keep(book.level_changes(intervals)), own, "market_batch_id", "deliver_ns")
    return quotes.select("session_id", F.col("batch_id").alias("place"), F.col("market_batch_id").alias("batch_id"), "deliver_ns", "bid_price", "bid_qty", "ask_price", "ask_qty", "mid2")


def plane_gap(market: DataFrame, client: DataFrame) -> DataFrame:
    """(session_id, n_batches, n_overtaken, n_other_mid, n_other_quote): how the two planes differ after the same
    batches: how many were delivered in another place, how many left another mid or other best prices and sizes."""
    names = ["bid_price", "bid_qty", "ask_price", "ask_qty"]
    theirs = market.select("session_id", "batch_id", F.struct(*names).alias("theirs"), F.col("mid2").alias("their_mid2"))
    both = client.join(theirs, ["session_id", "batch_id"])
    return both.groupBy("session_id").agg(
        F.count("*").alias("n_batches"), F.count_if(F.col("place") != F.col("batch_id")).alias("n_overtaken"),
        F.count_if(~F.col("mid2").eqNullSafe(F.col("their_mid2"))).alias("n_other_mid"), F.count_if(~F.struct(*names).eqNullSafe(F.col("theirs"))).alias("n_other_quote"))
