"""As-of joins over ranges of time: probes and samples are united and each probe looks back.

A range's rows are sorted alone. What the ranges before it leave behind is their last sample, carried on as a row
of its own, so no task has a whole key. The state variant returns the last sample's value, null included; the valid
variant skips nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.ranges import bucket_of

#: Nanoseconds of a range; those of a day are 24.
RANGE_NS = 3_600_000_000_000


def thinned(samples: DataFrame, times: DataFrame, by: list[str], at: str, time: str, seq: str, values: list[str], skip_null: str | None = None, width: int = RANGE_NS) -> DataFrame:
    """Those of ``samples`` that a probe at one of ``times`` (by, at; few, and broadcast) can find: within a range, the
    last of each stretch between two of them. As-of joins of such probes over these give what they give over all,
    without a shuffle of all."""
    s = samples.filter(F.col(skip_null).isNotNull()) if skip_null else samples
    held = F.struct(F.col(time).alias("_t"), F.col(seq).cast("long").alias("_seq"))
    s = s.filter(F.col(time).isNotNull()).select(*by, bucket_of(time, width).alias("_range"), held.alias("_at"), F.struct(*dict.fromkeys([*values, time, seq])).alias("_row"))
    marks = times.filter(F.col(at).isNotNull()).select(*by, bucket_of(at, width).alias("_range"), F.col(at).cast("long").alias("_p")).groupBy(*by, "_range").agg(F.collect_set("_p").alias("_marks"))
    before = F.coalesce(F.size(F.filter("_marks", lambda m: m < F.col("_at._t"))), F.lit(0))
    rows = s.join(F.broadcast(marks), [*by, "_range"], "left").withColumn("_stretch", F.when(F.col("_marks").isNull(), 0).otherwise(before))
    return rows.groupBy(*by, "_range", "_stretch").agg(F.max_by("_row", "_at").alias("_row")).select(*by, "_row.*")


def asof(probes: DataFrame, samples: DataFrame, by: list[str], at: str, time: str, seq: str, values: list[str], skip_null: str | None = None, width: int = RANGE_NS) -> DataFrame:
    """``probes`` with the ``values`` of the last sample at or before ``at``; of equal times the last
    ``seq`` counts. With ``skip_null``, samples where that value is null are passed over. Probes
    before all samples, or at no time, get nulls. Samples are read twice, probes once.
    """
    held = F.struct(*values, F.col(time).alias("sample_time"))
    s = samples.filter(F.col(skip_null).isNotNull()) if skip_null else samples
    s = s.filter(F.col(time).isNotNull()).select(*by, bucket_of(time, width).alias("_range"), F.col(time).alias("_t"), F.lit(0).alias("_src"), F.col(seq).cast("long").alias("_seq"), held.alias("_held"))
    ends = s.groupBy(*by, "_range").agg(F.max_by("_held", F.struct("_t", "_seq")).alias("_held"))
    # A range's last sample stands in all ranges up to the next that has samples, the last of all in those after it.
    until = F.lead("_range").over(Window.partitionBy(*by).orderBy("_range"))
    ends = ends.withColumn("_until", until)
    carried = ends.filter("_until is not null").select(*by, F.explode(F.sequence(F.col("_range") + 1, F.col("_until"))).alias("_range"), F.lit(-1).alias("_src"), "_held")
    final = ends.filter("_until is null").select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_range").alias("_final"), F.col("_held").alias("_rest"))
    # Probes at no time are spread, and find nothing before them.
    spread = -1 - F.pmod(F.xxhash64(*probes.columns), F.lit(1024))
    p = probes.withColumns({"_range": F.coalesce(bucket_of(at, width), spread), "_t": F.col(at), "_src": F.when(F.col(at).isNull(), -2).otherwise(1)})
    w = Window.partitionBy(*by, "_range").orderBy(F.when(F.col("_src") == -1, None).otherwise(F.col("_t")).asc_nulls_first(), "_src", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(s, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True).withColumn("_last", F.last("_held", ignorenulls=True).over(w)).filter(F.col("_src").isin(1, -2))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & (F.col(c) == F.col(f"_by{k}"))
    found = both.join(final, same & (F.col("_range") > F.col("_final")), "left")
    last = F.when(F.col("_t").isNotNull(), F.coalesce("_last", "_rest"))
    return found.withColumn("_last", last).select(*probes.columns, *(F.col(f"_last.{v}").alias(v) for v in values), F.col("_last.sample_time").alias("sample_time"))
