"""Streams of records: batches, trailing flow and deduplication.

Sources are any readStream of the tape's columns with ``ts`` (a timestamp, for watermarks).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeloom.sources.schemas import LAST

BATCH_OUT = "session_id string, batch_id long, n_records long, first_ordinal long, last_ordinal long, proxy_time_ns long, capture_time_ns long, truncated boolean"
_STATE = "batch_id long, n long, first long, last long, proxy long, capture long"


def stream_batches(records: DataFrame) -> DataFrame:
    """Closed batches of each session, as they close. The state is the open batch's totals, not its
    records; a session that stays silent past the watermark closes its rest as truncated. Records of
    a session come in order, as its tape is one ordered source."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState):
        b, n, first, last, proxy, capture = state.get if state.exists else (0, 0, -1, -1, -1, -1)
        out = []
        if state.hasTimedOut:
            if n:
                out.append((key[0], b, n, first, last, proxy, capture, True))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("source_ordinal")
            for o, e, c, f in zip(rows["source_ordinal"], rows["event_time_ns"], rows["capture_time_ns"], rows["flags"]):
                n, first, last, proxy, capture = n + 1, o if n == 0 else first, o, max(proxy, e), max(capture, c)
                if f & LAST:
                    out.append((key[0], b, n, first, last, proxy, capture, False))
                    b, n, first, last, proxy, capture = b + 1, 0, -1, -1, -1, -1
            state.update((int(b), int(n), int(first), int(last), int(proxy), int(capture)))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 60_000)
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in BATCH_OUT.split(", ")])

    return records.withWatermark("ts", "1 minute").groupBy("session_id").applyInPandasWithState(fold, BATCH_OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_flow(records: DataFrame, window: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Sliding flow sums of each session, final when the watermark passes a window."""
    q = lambda a, s: F.coalesce(F.sum(F.when((F.col("action") == a) & (F.col("side") == s), F.col("quantity"))), F.lit(0))
    w = records.withWatermark("ts", late).groupBy("session_id", F.window("ts", window, slide))
    return w.agg((q("T", "B") - q("T", "A")).alias("trade_signed"), F.count_if(F.col("action") == "T").alias("trade_count"), q("A", "B").alias("add_bid"), q("A", "A").alias("add_ask"), q("C", "B").alias("cancel_bid"), q("C", "A").alias("cancel_ask")).select(
        "session_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "trade_signed", "trade_count", "add_bid", "add_ask", "cancel_bid", "cancel_ask"
    )


def stream_dedup(records: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key; a key is forgotten after the watermark, so the state is bounded."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into Parquet, and reads that back."""
    schema = stream.schema
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(path)
