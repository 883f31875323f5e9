"""What models may know at a checkpoint: names of features, who may use them, and their table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.metrics import limit_offset
from tapeloom.operators import flow
from tapeloom.operators.asof import asof
from tapeloom.sources.schemas import TICK

# The names of a study's feature columns, in their order, and of columns that no model may see.
MARKET = ["spread_ticks", "bid_qty_1", "ask_qty_1", "imbalance_1", "depth_bid_3", "depth_ask_3", "imbalance_3", "quote_age_ms", "trade_flow_signed_1s", "trade_count_1s", "cancel_qty_bid_1s", "cancel_qty_ask_1s", "add_qty_bid_1s", "add_qty_ask_1s", "mid_vol_5s", "mid_change_1s_ticks"]
MECHANICS = ["side", "limit_offset_ticks", "order_age_ms", "time_remaining_ms"]
SIGNAL = ["p_down", "p_unch", "p_up", "u_signal"]
QUEUE = ["q_ahead_est", "q_ahead_upper", "q_insertion_uncertain", "q_depleted", "q_depleted_frac"]
PROHIBITED = ["true_queue_ahead", "unreported_executed", "m0"]
PROHIBITED_PREFIXES, PROHIBITED_PARTS = ["future_"], ["oracle", "true_"]

ALLOWED = {"B3": MARKET + MECHANICS + SIGNAL + QUEUE, "B3_NO_QUEUE": MARKET + MECHANICS + SIGNAL, "PRICE": MARKET, "B2": SIGNAL + MECHANICS}


def check_allowed(names: Sequence[str], policy: str) -> None:
    """Every name must be one that ``policy`` may use; a prohibited one is named as such first."""
    allowed = ALLOWED.get(policy)
    if allowed is None:
        raise ValueError(f"no list of features for {policy!r}")
    for n in names:
        if n in PROHIBITED or n.startswith(tuple(PROHIBITED_PREFIXES)) or any(p in n for p in PROHIBITED_PARTS):
            raise ValueError(f"{n!r} shows what a client cannot know, so {policy} must not read it")
        if n not in allowed:
            raise ValueError(f"{policy} has no feature {n!r}")


def market_features(quotes: DataFrame, flows: DataFrame, near_ns: int, vol_ns: int) -> DataFrame:
    """(session_id, batch_id, obs_ns, MARKET) at each live batch as it reaches the client. ``quotes`` have obs_ns;
    ``near_ns`` and ``vol_ns`` are the windows of flows and changes, and of the volatility."""
    sums = flow.trailing_flow(flows, near_ns).drop("obs_ns")
    moves = flow.mid_moves(quotes.filter("mid2 is not null").select("session_id", "batch_id", "obs_ns", "mid2"), vol_ns, near_ns).drop("obs_ns")
    key = ["session_id", "batch_id"]
    rows = quotes.join(flow.quote_age(quotes), key).join(sums, key).join(moves, key, "left")
    own = {
        "spread_ticks": (F.col("ask_price") - F.col("bid_price")) / TICK, "bid_qty_1": F.coalesce("bid_qty", F.lit(0)), "ask_qty_1": F.coalesce("ask_qty", F.lit(0)), "imbalance_1": F.col("imbalance_1"),
        "depth_bid_3": F.col("depth_bid_3"), "depth_ask_3": F.col("depth_ask_3"), "imbalance_3": F.col("imbalance_3"), "quote_age_ms": F.col("quote_age_ms"),
        "trade_flow_signed_1s": F.col("trade_signed"), "trade_count_1s": F.col("trade_count"), "cancel_qty_bid_1s": F.col("cancel_bid"), "cancel_qty_ask_1s": F.col("cancel_ask"),
        "add_qty_bid_1s": F.col("add_bid"), "add_qty_ask_1s": F.col("add_ask"), "mid_vol_5s": F.coalesce("mid_vol", F.lit(0.0)), "mid_change_1s_ticks": F.coalesce("mid_change", F.lit(0.0)),
    }
    return rows.select(*key, "obs_ns", "bid_price", "ask_price", *(own[n].cast("double").alias(n) for n in MARKET))


def checkpoint_features(orders: DataFrame, market: DataFrame, queue: DataFrame) -> DataFrame:
    """(task_id, scenario_id, session_id, MARKET, MECHANICS, QUEUE) of resting ``orders`` (task_id, scenario_id,
    session_id, side B or A, limit, arrival_ns, checkpoint_ns, deadline_ns, asked_ns), as the client knows them
    at asked_ns. Null where no live batch has come or a side is empty."""
    probes = orders.select("task_id", "scenario_id", "session_id", "side", "limit", "arrival_ns", "checkpoint_ns", "deadline_ns", "asked_ns")
    seen = asof(probes, market.withColumn("seq", F.col("batch_id")), ["session_id"], "asked_ns", "obs_ns", "seq", ["bid_price", "ask_price", *MARKET])
    s = F.when(F.col("side") == "B", 1).otherwise(-1)
    touch = F.when(F.col("side") == "B", F.col("bid_price")).otherwise(F.col("ask_price"))
    ms = lambda a, b: (F.col(a) - F.col(b)) / 1_000_000
    own = {"side": s, "limit_offset_ticks": limit_offset(s, F.col("limit"), touch), "order_age_ms": ms("checkpoint_ns", "arrival_ns"), "time_remaining_ms": ms("deadline_ns", "checkpoint_ns")}
    rows = seen.join(queue.select("task_id", "scenario_id", *(F.col(n).cast("double").alias(n) for n in QUEUE)), ["task_id", "scenario_id"])
    return rows.select("task_id", "scenario_id", "session_id", *MARKET, *(own[n].cast("double").alias(n) for n in MECHANICS), *QUEUE)
