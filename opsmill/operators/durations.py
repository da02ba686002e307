"""Durations of tests over days: quantiles that can be merged, and changes of the median.

A sketch counts durations in buckets whose width follows their size: a duration keeps its
leading ``BITS`` binary digits, so that a bucket's least value is less than its others by at
most one part in 2 ** (BITS - 1). Buckets keep the order of durations, hence a quantile of the sketch
is the bucket of the exact one: never above it, and below it by at most that part. Sketches
are rows ``(test, day, low, n)``; sketches of days, runs or sources are merged by
adding up, and the rows of a test and day are bounded by the number of buckets (some
thousands at most), however many runs there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 7


def bucket(duration: Column) -> Column:
    """The least duration of a duration's bucket; negative ones count as 0."""
    value = F.greatest(duration.cast("bigint"), F.lit(0).cast("bigint"))
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), drop).cast("bigint")
    return value - value % unit


def sketch_days(results: DataFrame, day: Column | None = None) -> DataFrame:
    """``(test, day, low, n)`` of result rows ``(test, run_ts, duration)``; a missing duration is left out."""
    day = F.to_date("run_ts") if day is None else day
    return (
        results.where(F.col("duration").isNotNull())
        .groupBy("test", day.alias("day"), bucket(F.col("duration")).alias("low"))
        .agg(F.count("*").alias("n"))
    )


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches added up by ``keys``."""
    return sketches.groupBy(*keys, "low").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, keys: list[str], hundredths: dict[str, int]) -> DataFrame:
    """A row per ``keys``: how many durations, and the quantiles by name (in hundredths).

    A quantile is the least duration that so many hundredths of all are at most.
    """
    upto = Window.partitionBy(*keys).orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    counted = sketches.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(Window.partitionBy(*keys))})
    return counted.groupBy(*keys).agg(
        F.max("_all").alias("runs"),
        *[F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * p, F.col("low"))).alias(name) for name, p in hundredths.items()],
    )


def _median(sketch: str, runs: str) -> Column:
    """The least duration that half of all are at most, of an array of ``(low, n)`` in any order."""

    def step(state: Column, bucket: Column) -> Column:
        upto = state["upto"] + bucket["n"]
        reached = (state["upto"] * 2 < F.col(runs)) & (upto * 2 >= F.col(runs))
        return F.struct(upto.alias("upto"), F.when(reached, bucket["low"]).otherwise(state["low"]).alias("low"))

    none = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("bigint").alias("low"))
    return F.aggregate(F.array_sort(sketch), none, step, lambda state: state["low"])


def median_changes(sketches: DataFrame, days: int = 7, percent: int = 150, least: int = 5) -> DataFrame:
    """Days on which a test's median over the next ``days`` (that day included) departs from that over the days before.

    ``(test, day, before, after, change)`` where the larger median is at least ``percent`` hundredths of the smaller
    and both sides have ``least`` runs; of adjoining days of one direction only the first is
    a change. A day's sketch is one row, and a day takes the sketches of the days around it from a window: no row
    is copied, and what a task holds at once is the sketches of that many days, however many runs they are of.
    """
    sketch = F.collect_list(F.struct("low", "n")).alias("_sketch")
    known = F.col("test").isNotNull() & F.col("day").isNotNull()
    daily = sketches.where(known).groupBy("test", "day").agg(sketch, F.sum("n").alias("_runs"))
    in_order = Window.partitionBy("test").orderBy(F.unix_date("day"))
    earlier, later = in_order.rangeBetween(-days, -1), in_order.rangeBetween(0, days - 1)
    around = daily.select(
        "test", "day",
        F.flatten(F.collect_list("_sketch").over(earlier)).alias("_earlier"), F.sum("_runs").over(earlier).alias("_before"),
        F.flatten(F.collect_list("_sketch").over(later)).alias("_later"), F.sum("_runs").over(later).alias("_after"),
    )
    both = around.select(
        "test", "day", _median("_earlier", "_before").alias("before"), _median("_later", "_after").alias("after"),
        "_before", "_after",
    )
    enough = (F.col("_before") >= least) & (F.col("_after") >= least)
    slower = enough & (F.col("after") * 100 >= F.col("before") * percent) & (F.col("after") > F.col("before"))
    faster = enough & (F.col("before") * 100 >= F.col("after") * percent) & (F.col("before") > F.col("after"))
    marked = both.withColumn("change", F.when(slower, "slower").when(faster, "faster").otherwise("same"))
    # One row per test and day, in the order of days.
    last = F.lag("change").over(Window.partitionBy("test").orderBy("day"))
    found = marked.withColumn("_last", last).where((F.col("change") != "same") & ~F.col("change").eqNullSafe(F.col("_last")))
    return found.select("test", "day", "before", "after", "change")
