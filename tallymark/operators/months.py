"""Months: buckets of sessions, merges over hosts and re-scans, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How measures merge over the hosts of a month, and over months to a lifetime.
HOSTS = {"sessions": F.sum, "volume": F.sum, "projects": F.max, "active_days": F.max, "streak": F.max, "night": F.max}
LIFE = {"sessions": F.sum, "volume": F.sum, "projects": F.max, "active_days": F.sum, "streak": F.max, "night": F.sum}


def volume_by_start(sessions: DataFrame, start: str, volume: Column, keys: list[str] | None = None) -> DataFrame:
    """Sessions and their volume, in the month in which a session begins."""
    return sessions.where(F.col(start).isNotNull()).groupBy(*(keys or []), F.date_format(start, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("sessions"), F.sum(volume).cast("long").alias("volume"))


def days_by_own(activity: DataFrame, day: Column, keys: list[str] | None = None) -> DataFrame:
    """Distinct days, each in its own month: a month may have days and no session begun."""
    days = activity.select(*(keys or []), day.alias("d")).where("d is not null").distinct()
    return days.groupBy(*(keys or []), F.date_format("d", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("active_days"))


def buckets(volumes: DataFrame, days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Both rules in one row per month."""
    on = [*(keys or []), "month"]
    return volumes.join(days, on, "full").select(*on, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sessions", "volume", "active_days")))


def merge_rescans(stored: DataFrame, scanned: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """A month scanned again never shrinks: each measure at its maximum; months of either stay."""
    return stored.select(*keys, *measures).unionByName(scanned.select(*keys, *measures)).groupBy(*keys).agg(*(F.max(m).alias(m) for m in measures))


def merge_hosts(snapshots: DataFrame, measures: list[str]) -> DataFrame:
    """Hosts of a month: volumes add up; projects, days, streaks and nights take the maximum."""
    return snapshots.groupBy("month").agg(F.count(F.lit(1)).alias("hosts"), *(HOSTS[m](m).cast("long").alias(m) for m in measures))


def lifetime(timeline: DataFrame, measures: list[str]) -> DataFrame:
    """Months to one row: volumes, days and nights add up; projects and streaks take the maximum."""
    return timeline.agg(F.count(F.lit(1)).alias("months"), *(LIFE[m](m).cast("long").alias(m) for m in measures))


def change(timeline: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Each month's change against the month before, in whole percent; null without one above 0."""
    w = Window.partitionBy(*keys).orderBy("month")
    pct = {f"{m}_pct": F.when(F.lag(m).over(w) > 0, F.floor((F.col(m) - F.lag(m).over(w)) * 100.0 / F.lag(m).over(w) + 0.5)).cast("long") for m in measures}
    return timeline.select(*keys, "month", *(c.alias(n) for n, c in pct.items()))


def trend(timeline: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Months tracked and the least-squares slope of a measure over them."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("month")) - 1
    return timeline.select(*keys, "month", F.col(measure).alias("y"), nth.alias("x")).groupBy(*keys).agg(F.count(F.lit(1)).alias("months"), F.max("month").alias("latest"), F.round(F.regr_slope("y", "x"), 4).alias("slope"))


def own_rank(timeline: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """The latest month among a key's own months, of at least three: percent below it, or best."""
    every = timeline.groupBy(*keys).agg(F.max_by(measure, "month").alias("latest"), F.count(measure).alias("months"), F.max(measure).alias("best"))
    below = timeline.join(every, keys).where(F.col(measure) < F.col("latest")).groupBy(*keys).agg(F.count(F.lit(1)).alias("below"))
    out = every.where("months >= 3").join(below, keys, "left")
    return out.select(*keys, "months", (F.col("latest") >= F.col("best")).alias("is_best"), F.floor(F.coalesce("below", F.lit(0)) * 100.0 / F.col("months") + 0.5).cast("long").alias("above_pct"))


def tail(timeline: DataFrame, keys: list[str], months: int) -> DataFrame:
    """The last ``months`` months of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("month")))
    return timeline.withColumn("nth", nth).where(F.col("nth") <= months).drop("nth")
