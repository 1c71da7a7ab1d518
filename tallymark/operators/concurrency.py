"""How many intervals run at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: An interval lasts at least a minute.
LEAST = 60_000_000
#: Starts and ends are swept by buckets of an hour.
BUCKET = 3_600_000_000


def sweep(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Peak concurrency and, in microseconds, time covered, time with two or more, and the integral.

    A sweep over starts and ends: at one instant starts come before ends. Every
    hour of a key is swept by itself, from the level that the hours before left,
    so a key's points never meet in one task; only its hours' sums do.
    """
    rows = intervals.where(f"{start} is not null and {end} is not null")
    ends = F.greatest(F.col(end), F.col(start) + LEAST)
    points = rows.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(ends.alias("t"), F.lit(-1).alias("d")))).alias("p")).select(*keys, F.floor(F.col("p.t") / BUCKET).alias("hour"), "p.t", "p.d")
    hours = points.groupBy(*keys, "hour").agg(F.sum("d").alias("change"), F.min("t").alias("first"))
    by_hour = Window.partitionBy(*keys).orderBy("hour")
    carried = F.coalesce(F.sum("change").over(by_hour.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select(*keys, "hour", carried.alias("carried"), F.lead("first").over(by_hour).alias("next"))
    order = Window.partitionBy(*keys, "hour").orderBy("t", F.desc("d"))
    level = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("carried")
    # Ties leave the order of equal rows open, but between them no time passes.
    held = points.join(hours, [*keys, "hour"]).select(*keys, level.alias("level"), (F.coalesce(F.lead("t").over(order), F.col("next")) - F.col("t")).alias("held"))
    return held.groupBy(*keys).agg(
        F.max("level").alias("peak"),
        F.coalesce(F.sum(F.when(F.col("level") >= 1, F.col("held"))), F.lit(0)).alias("covered"),
        F.coalesce(F.sum(F.when(F.col("level") >= 2, F.col("held"))), F.lit(0)).alias("multi"),
        F.coalesce(F.sum(F.col("level") * F.col("held")), F.lit(0)).alias("integral"),
    )
