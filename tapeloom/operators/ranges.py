"""Range joins as equi-joins over buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(at: Column | str, width: int) -> Column:
    """The bucket of ``width`` that a whole number lies in, without going through doubles."""
    at = F.col(at) if isinstance(at, str) else at
    return F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width))


def running_total(rows: DataFrame, by: list[str], order: str, value: str, name: str, width: int = 1 << 20, *ties: str, keep=None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same ``by`` (never null) before each, by ``order``
    and then by ``ties``.

    Sums run within ranges of ``width`` of ``order``, and totals of the ranges before are added, so no
    task sorts a whole key. With ``keep``, which writes a table, the rows are worked out once and read for the totals.
    """
    cut = rows.withColumn("_bucket", bucket_of(order, width))
    past = lambda keys, *at: Window.partitionBy(*keys).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0).cast("long"))
    own = cut.withColumn("_own", zero(value, past([*by, "_bucket"], order, *ties)))
    if keep is not None:
        own = cut = keep(own)
    sums = cut.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    before = sums.select(*by, "_bucket", zero("_sum", past(by, "_bucket")).alias("_before"))
    if keep is not None:
        before = keep(before)
    return own.join(before, [*by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_before", "_own")


def marks_upto(rows: DataFrame, marks: DataFrame, by: list[str], at: str, name: str, width: int, keep=lambda df: df) -> DataFrame:
    """``rows`` with ``name``: how many of the distinct ``marks`` (by, at; each at a row's place) lie at or before each.

    A range of ``width`` has the marks in it and the number of those before it. Where that table is small, which
    Spark knows if ``keep`` writes it, no row is shuffled.
    """
    cell = bucket_of(at, width).alias("_cell")
    held = marks.groupBy(*by, cell).agg(F.array_sort(F.collect_set(at)).alias("_marks"))
    cells = rows.select(*by, cell).distinct().join(held, [*by, "_cell"], "left")
    before = F.sum(F.when(F.col("_marks").isNull(), 0).otherwise(F.size("_marks"))).over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = keep(cells.select(*by, "_cell", "_marks", F.coalesce(before, F.lit(0)).cast("long").alias("_before")))
    own = F.when(F.col("_marks").isNull(), 0).otherwise(F.size(F.filter("_marks", lambda m: m <= F.col(at))))
    return rows.withColumn("_cell", cell).join(cells, [*by, "_cell"]).withColumn(name, F.col("_before") + own).drop("_cell", "_marks", "_before")


def points_in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, bucket: int) -> DataFrame:
    """Rows of ``points`` with each interval [start, end) of the same ``by`` that holds ``at``.

    An interval meets the points of the buckets it runs through, so the join's keys stay narrow
    however long a session is. Choose a bucket near the usual interval.
    """
    cells = intervals.withColumn("_bucket", F.explode(F.sequence(bucket_of(start, bucket), bucket_of(F.col(end) - 1, bucket))))
    return points.withColumn("_bucket", bucket_of(at, bucket)).join(cells, [*by, "_bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def points_in_mixed_intervals(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, short: int, bucket: int) -> DataFrame:
    """What ``points_in_intervals`` gives, for many points and intervals that are mostly ``short`` at most: those meet
    the points of buckets of that width, longer ones the points of a ``bucket``."""
    wide = F.col(end) - F.col(start) > short
    through = lambda width: F.sequence(bucket_of(start, width), bucket_of(F.col(end) - 1, width))
    cells = intervals.withColumn("_wide", wide).withColumn("_bucket", F.explode(F.when(F.col("_wide"), through(bucket)).otherwise(through(short))))
    cell = lambda of, width: F.struct(F.lit(of).alias("_wide"), bucket_of(at, width).alias("_bucket"))
    placed = points.withColumn("_cell", F.explode(F.array(cell(False, short), cell(True, bucket)))).select("*", "_cell.*").drop("_cell")
    return placed.join(cells, [*by, "_wide", "_bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_wide", "_bucket")


def windows_over_intervals(windows: DataFrame, intervals: DataFrame, by: list[str], lo: str, hi: str, start: str, end: str, bucket: int) -> DataFrame:
    """Rows of ``windows`` [lo, hi] with each interval [start, end) that overlaps; a pair comes once."""
    w = windows.withColumn("_bucket", F.explode(F.sequence(bucket_of(lo, bucket), bucket_of(hi, bucket))))
    i = intervals.withColumn("_bucket", F.explode(F.sequence(bucket_of(start, bucket), bucket_of(F.col(end) - 1, bucket))))
    first = bucket_of(F.greatest(lo, start), bucket)
    return w.join(i, [*by, "_bucket"]).filter((F.col(lo) < F.col(end)) & (F.col(hi) >= F.col(start)) & (first == F.col("_bucket"))).drop("_bucket")
