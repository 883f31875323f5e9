"""Arrival grids, task manifests, forward labels and markouts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.asof import asof
from tapeloom.operators.worlds import guard_ns
from tapeloom.sources.schemas import LATENCY, TICK

WARMUP_NS = DRAIN_NS = 1_000_000_000


def arrival_grid(sessions: DataFrame, horizon_ns: int) -> DataFrame:
    """(session_id, k, arrival_ns, deadline_ns): arrivals spaced max(10 s, 2 H) from a phase that the
    session's name gives, while a task and its drain end within the session."""
    spacing = max(10_000_000_000, 2 * horizon_ns)
    phase = F.conv(F.substring(F.sha2("session_id", 256), 1, 8), 16, 10).cast("long") % spacing
    first, last = F.col("start_ns") + WARMUP_NS + phase, F.col("end_ns") - horizon_ns - DRAIN_NS
    rows = sessions.withColumn("first", first).filter(F.col("first") <= last)
    at = rows.select("session_id", F.posexplode(F.sequence("first", last, F.lit(spacing))).alias("k", "arrival_ns"))
    return at.select("session_id", F.col("k").cast("long").alias("k"), "arrival_ns", (F.col("arrival_ns") + horizon_ns).alias("deadline_ns"))


def valid_horizons(ladder: Iterable[int], scenarios: Iterable[str]) -> list[int]:
    """Horizons of which half is more than the largest guard of the scenarios, in whole nanoseconds."""
    guard = max(guard_ns(*LATENCY[s][1:]) for s in scenarios)
    return [h for h in ladder if h > 2 * guard]


def delivery_probes(grid: DataFrame) -> DataFrame:
    """(session_id, k, scenario_id, at_ns): each arrival, less the delivery delay of each latency scenario."""
    scenarios = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario_id"), F.lit(v[0] * 1000).cast("long").alias("delay")) for k, v in LATENCY.items())))
    return grid.withColumn("s", scenarios).select("session_id", "k", "s.scenario_id", (F.col("arrival_ns") - F.col("s.delay")).alias("at_ns"))


def status_at(probes: DataFrame, at: str, statuses: DataFrame, time: str) -> DataFrame:
    """``probes`` with the ``status`` of the last of ``statuses`` (session_id, seq, status and ``time``)
    at or before ``at``; before any a session trades. The market's plane goes by event time and
    batch time, the client's by capture time and the probe's time less the delivery delay."""
    found = asof(probes, statuses, ["session_id"], at, time, "seq", ["status"]).drop("sample_time")
    return found.withColumn("status", F.coalesce("status", F.lit("TRADING")))


def shifted_asof(grid: DataFrame, client_mids: DataFrame) -> DataFrame:
    """The client's mid at each arrival, less the delivery delay of each latency scenario."""
    probes = delivery_probes(grid)
    return asof(probes, client_mids, ["session_id"], "at_ns", "t", "seq", ["mid2"])


def task_manifest(grid: DataFrame, mids: DataFrame, client_mids: DataFrame) -> DataFrame:
    """Two tasks for each arrival; eligible if the market's mid and each scenario's client mid are valid
    at it. The reason names the first scenario without one."""
    hist = asof(grid, mids, ["session_id"], "arrival_ns", "t", "seq", ["mid2"]).withColumnRenamed("mid2", "m0_mid2").drop("sample_time")
    lacking = shifted_asof(grid, client_mids).filter("mid2 is null").groupBy("session_id", "k").agg(F.min("scenario_id").alias("lacking"))
    rows = hist.join(lacking, ["session_id", "k"], "left").withColumn("side", F.explode(F.array(F.lit("BUY"), F.lit("SELL"))))
    reason = F.when(F.col("m0_mid2").isNull(), "NO_VALID_HISTORICAL_MID").when(F.col("lacking").isNotNull(), F.format_string("NO_CLIENT_MID[%s]", "lacking"))
    task_id = F.when(reason.isNull(), F.concat_ws(":", "session_id", F.lpad(F.col("k").cast("string"), 5, "0"), "side"))
    return rows.select(task_id.alias("task_id"), "session_id", "side", "arrival_ns", "deadline_ns", F.when(reason.isNull(), F.col("m0_mid2")).alias("m0_mid2"), reason.isNull().alias("eligible"), reason.alias("ineligible_reason"))


def price_labels(grid: DataFrame, mids: DataFrame, tau_ns: int) -> DataFrame:
    """(session_id, k, label): sign of mid(t + tau) - mid(t); null past the last sample, or where either
    state is invalid. Zero moves stay."""
    last = mids.groupBy("session_id").agg(F.max("t").alias("last_t"))
    now = asof(grid, mids, ["session_id"], "arrival_ns", "t", "seq", ["mid2"]).withColumnRenamed("mid2", "mid_now").drop("sample_time")
    then = asof(now.withColumn("at_ns", F.col("arrival_ns") + tau_ns), mids, ["session_id"], "at_ns", "t", "seq", ["mid2"])
    move = F.signum((F.col("mid2") - F.col("mid_now")).cast("double")).cast("int")
    return then.join(last, "session_id", "left").select("session_id", "k", F.when(F.col("at_ns") <= F.col("last_t"), move).alias("label"))


def markouts(fills: DataFrame, mids: DataFrame, intervals_hit, horizons_ns: list[int], max_age_ns: int) -> DataFrame:
    """A row for each fill (fill_id, session_id, side, fill_ns, price_fixed) and horizon, with
    markout_ticks or missing_reason: past the last sample, across lost continuity, no valid state, or a
    reference too old, in this order. ``intervals_hit`` adds ``reason`` to (session_id, arrival_ns,
    deadline_ns)."""
    rows = fills.withColumn("horizon_ns", F.explode(F.array(*(F.lit(h).cast("long") for h in horizons_ns)))).withColumn("target_ns", F.col("fill_ns") + F.col("horizon_ns"))
    judged = intervals_hit(rows.select("session_id", F.col("fill_ns").alias("arrival_ns"), F.col("target_ns").alias("deadline_ns")).distinct())
    rows = rows.join(judged.select("session_id", F.col("arrival_ns").alias("fill_ns"), F.col("deadline_ns").alias("target_ns"), F.col("reason").alias("lost")), ["session_id", "fill_ns", "target_ns"], "left")
    last = mids.groupBy("session_id").agg(F.max("t").alias("last_t"))
    state = asof(rows, mids, ["session_id"], "target_ns", "t", "seq", ["mid2"]).drop("sample_time").withColumnRenamed("mid2", "state_mid2")
    rows = asof(state, mids, ["session_id"], "target_ns", "t", "seq", ["mid2"], skip_null="mid2").join(last, "session_id", "left")
    age = F.col("target_ns") - F.col("sample_time")
    reason = (
        F.when(F.col("last_t").isNull() | (F.col("target_ns") > F.col("last_t")), "OUTSIDE_COVERAGE").when(F.col("lost").isNotNull(), "SOURCE_DISCONTINUITY")
        .when(F.col("state_mid2").isNull(), "INVALID_STATE").when(age > max_age_ns, "STALE_REFERENCE")
    )
    value = F.col("side") * (F.col("mid2") - 2 * F.col("price_fixed")) / (2.0 * TICK)
    return rows.withColumn("missing_reason", reason).select("fill_id", "session_id", "side", "horizon_ns", "target_ns", F.when(F.col("missing_reason").isNull(), value).alias("markout_ticks"), "missing_reason")


def summarize_markouts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts, and means and medians of the defined values. A null key is a group; a null session counts
    as a session."""
    v = F.col("markout_ticks")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_completed"), F.count(v).alias("n_defined"), F.count_if(v.isNull()).alias("n_missing"),
        (F.count_distinct("session_id") + F.max(F.col("session_id").isNull().cast("long"))).alias("n_sessions"), F.avg(v).alias("mean_markout_ticks"), F.median(v).alias("median_markout_ticks"),
    )
