"""Stretches of lost continuity, and tasks that cannot be evaluated for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.ranges import windows_over_intervals

#: Nanoseconds of a join bucket of windows and intervals.
BUCKET_NS = 3_600_000_000_000


def judged_batches(batches: DataFrame, anomalies: DataFrame, evidence: DataFrame) -> DataFrame:
    """Batches with ``reason`` (why continuity is lost, else null) and ``clean_init``."""
    bad = anomalies.select("session_id", "batch_id").distinct().withColumn("anomalous", F.lit(True))
    rows = batches.join(bad, ["session_id", "batch_id"], "left").join(evidence.select("session_id", "batch_id", "invalid"), ["session_id", "batch_id"], "left")
    anomalous, invalid, flagged = F.coalesce("anomalous", F.lit(False)), F.coalesce("invalid", F.lit(False)), F.col("quality_flags") != ""
    reason = F.when(flagged, F.concat(F.lit("QUALITY_FLAGS:"), F.col("quality_flags"))).when(F.col("has_clear"), "CLEAR_RECORD").when(anomalous, "BOOK_ANOMALY").when(invalid, "INVALID_EXECUTION_EVIDENCE")
    init = F.col("kind") == "INITIALIZATION"
    return rows.select("session_id", "batch_id", "proxy_time_ns", init.alias("init"), (init & ~flagged & ~anomalous & ~invalid).alias("clean_init"), reason.alias("reason"))


def invalid_intervals(judged: DataFrame) -> DataFrame:
    """(session_id, start_ns, end_ns, reason): from the first corrupt batch to the next clean
    initialization, or past the session's end. Islands are numbered by the clean initializations
    before them, so no batch is compared with another."""
    w = Window.partitionBy("session_id").orderBy("batch_id")
    rows = judged.withColumn("island", F.sum(F.col("clean_init").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("corrupt", F.col("reason").isNotNull() & ~F.col("clean_init"))
    islands = rows.groupBy("session_id", "island").agg(
        F.min(F.when(F.col("corrupt"), F.struct("batch_id", "proxy_time_ns", "reason"))).alias("first"),
        F.min(F.when(F.col("clean_init"), F.col("proxy_time_ns"))).alias("opened_ns"),
        F.max("proxy_time_ns").alias("last_ns"),
    )
    of = Window.partitionBy("session_id").orderBy("island")
    session_end = F.max("last_ns").over(Window.partitionBy("session_id"))
    ended = islands.withColumn("next_ns", F.lead("opened_ns").over(of)).withColumn("session_end", session_end).filter("first is not null")
    return ended.select("session_id", F.col("first.proxy_time_ns").alias("start_ns"), F.coalesce("next_ns", F.greatest("session_end", "first.proxy_time_ns") + 1).alias("end_ns"), F.col("first.reason").alias("reason"))


def unevaluable(tasks: DataFrame, intervals: DataFrame, judged: DataFrame) -> DataFrame:
    """Each task (session_id, arrival_ns, deadline_ns) with ``reason``: that of the first interval by
    start which its window meets, else SNAPSHOT_RESET for an initialization inside, else null."""
    keys = ["session_id", "arrival_ns", "deadline_ns"]
    usable = intervals.filter("end_ns > start_ns").select("session_id", "start_ns", "end_ns", "reason")
    windows = tasks.select(*keys).distinct()
    hit = windows_over_intervals(windows, usable, ["session_id"], "arrival_ns", "deadline_ns", "start_ns", "end_ns", BUCKET_NS).groupBy(*keys).agg(F.min_by("reason", "start_ns").alias("hit"))
    resets = judged.filter("init").select("session_id", F.col("proxy_time_ns").alias("start_ns"), (F.col("proxy_time_ns") + 1).alias("end_ns"))
    reset = windows_over_intervals(windows, resets, ["session_id"], "arrival_ns", "deadline_ns", "start_ns", "end_ns", BUCKET_NS).filter("arrival_ns < start_ns").select(*keys).distinct().withColumn("reset", F.lit("SNAPSHOT_RESET"))
    return tasks.join(hit, keys, "left").join(reset, keys, "left").withColumn("reason", F.coalesce("hit", "reset")).drop("hit", "reset")


QUALITY_SQL = """
judged as (
  select b.session_id, b.batch_id, b.proxy_time_ns, b.kind = 'INITIALIZATION' as init,
    b.kind = 'INITIALIZATION' and quality_flags = '' and a.batch_id is null and not coalesce(e.invalid, false) as clean_init,
    case when quality_flags <> '' then 'QUALITY_FLAGS:' || quality_flags when has_clear then 'CLEAR_RECORD' when a.batch_id is not null then 'BOOK_ANOMALY' when e.invalid then 'INVALID_EXECUTION_EVIDENCE' end as reason
  from batches b left join (select distinct session_id, batch_id from states where anomaly is not null) a on a.session_id = b.session_id and a.batch_id = b.batch_id
    left join evidence e on e.session_id = b.session_id and e.batch_id = b.batch_id),
opened as (
  select *, (select min(c.batch_id) from judged c where c.session_id = j.session_id and c.clean_init and c.batch_id > j.batch_id) as close_id,
    coalesce((select max(c.batch_id) from judged c where c.session_id = j.session_id and c.clean_init and c.batch_id <= j.batch_id), -1) as open_id
  from judged j where reason is not null and not clean_init),
bad as (
  select o.session_id, o.proxy_time_ns as start_ns, coalesce(c.proxy_time_ns, greatest(o.proxy_time_ns, (select max(m.proxy_time_ns) from judged m where m.session_id = o.session_id)) + 1) as end_ns, o.reason
  from (select * from opened qualify row_number() over (partition by session_id, open_id order by batch_id) = 1) o
    left join judged c on c.session_id = o.session_id and c.batch_id = o.close_id)
"""
