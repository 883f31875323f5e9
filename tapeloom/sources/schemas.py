"""Schemas of a session's tables."""

from pyspark.sql import types as T

RECORDS = T.StructType(
    [
        T.StructField("dataset_id", T.StringType(), False),
        T.StructField("publisher_id", T.LongType(), False),
        T.StructField("instrument_id", T.LongType(), False),
        T.StructField("session_epoch", T.LongType(), False),
        T.StructField("source_ordinal", T.LongType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("side", T.StringType(), False),
        T.StructField("price_fixed", T.LongType(), False),
        T.StructField("quantity", T.LongType(), False),
        T.StructField("order_id", T.LongType(), False),
        T.StructField("event_time_ns", T.LongType(), False),
        T.StructField("capture_time_ns", T.LongType(), False),
        T.StructField("flags", T.LongType(), False),
        T.StructField("source_file_hash", T.StringType(), False),
        T.StructField("source_record_offset", T.LongType(), False),
        T.StructField("channel_id", T.LongType(), True),
        T.StructField("source_sequence", T.LongType(), True),
        T.StructField("schema_version", T.LongType(), False),
    ]
)
STATUS = T.StructType(
    [
        T.StructField("instrument_id", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("event_time_ns", T.LongType(), False),
        T.StructField("capture_time_ns", T.LongType(), False),
    ]
)

#: Bits of ``flags``.
LAST, SNAPSHOT, BAD_TS_RECV, MAYBE_BAD_BOOK = 128, 32, 8, 4
TICK, MULTIPLIER, PRICE_SCALE = 250_000_000, 50, 1_000_000_000
"""One tick and the contract multiplier of the fixture instrument; prices are in 1e-9 units."""

#: Delivery, compute, entry and response delays of the latency scenarios, in microseconds.
LATENCY = {
    "L0": (0, 0, 0, 0),
    "L1": (0, 50, 250, 250),
    "L2": (1000, 50, 250, 250),
    "L3": (0, 500, 250, 250),
    "L4": (0, 50, 2500, 250),
    "L5": (0, 50, 250, 2500),
    "L6": (1000, 500, 2500, 2500),
}
EPSILONS, THETAS, MARKOUT_MS = (0.0, 1e-4, 1e-3, 1e-2, 1.0), (0.0, 0.1, 0.2), (10, 100, 1000)
