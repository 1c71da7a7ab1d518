"""Sessions on the clock: active time, streaks, days, hours.

Every function takes the names of its key, time and day columns and returns
one row per key (or per hour, month, day). Minutes are whole minutes since the
epoch; active time is in minutes or microseconds, as integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
#: A gap longer than this counts as this much.
GAP_CAP = 15


def micros(ts: str) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def minute(ts: str) -> Column:
    """Minutes since the epoch."""
    return F.floor(micros(ts) / MINUTE)


def capped(gap: Column, cap: int = GAP_CAP) -> Column:
    """An aggregate of distinct minutes: the gaps before them, each up to ``cap``; a lone minute is one."""
    return F.when(F.count(F.lit(1)) == 1, F.lit(1)).otherwise(F.coalesce(F.sum(F.when(gap.isNotNull(), F.least(gap, F.lit(cap)))), F.lit(0))).cast("long")


def capped_minutes(df: DataFrame, keys: list[str], ts: str, cap: int = GAP_CAP) -> DataFrame:
    """Active minutes: distinct minutes in order, each gap counted up to ``cap``; a lone minute is one."""
    at = df.where(F.col(ts).isNotNull()).select(*keys, minute(ts).alias("m")).distinct()
    gap = F.col("m") - F.lag("m").over(Window.partitionBy(*keys).orderBy("m"))
    return at.select(*keys, gap.alias("gap")).groupBy(*keys).agg(capped(F.col("gap"), cap).alias("active_minutes"))


def threshold_micros(df: DataFrame, keys: list[str], ts: str, minutes: int = GAP_CAP) -> DataFrame:
    """Active microseconds: gaps between stamps of at most ``minutes`` count, longer ones do not at all."""
    at = df.where(F.col(ts).isNotNull()).select(*keys, micros(ts).alias("t"))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t"))
    counted = F.when((F.col("gap") > 0) & (F.col("gap") <= minutes * MINUTE), F.col("gap")).otherwise(0)
    return at.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.sum(counted).cast("long").alias("active_micros"))


def islands(df: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """Runs of days without a gap: first_day, last_day, days."""
    days = df.select(*keys, day.alias("d")).where("d is not null").distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("d"))
    return days.select(*keys, "d", F.date_sub("d", nth).alias("run")).groupBy(*keys, "run").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("run")


def streaks(df: DataFrame, keys: list[str], day: Column, today: Column) -> DataFrame:
    """Longest streak; the current one with a day's grace, and strictly up to ``today``."""
    runs = islands(df, keys, day)
    last = F.max_by(F.struct("last_day", "days"), "last_day")
    return runs.groupBy(*keys).agg(
        F.max("days").alias("longest"),
        F.when(F.datediff(today, last["last_day"]) <= 1, last["days"]).otherwise(F.lit(0)).cast("long").alias("current_grace"),
        F.coalesce(F.max(F.when((F.col("first_day") <= today) & (F.col("last_day") >= today), F.datediff(today, F.col("first_day")) + 1)), F.lit(0)).cast("long").alias("current_strict"),
    )


def hour_histogram(df: DataFrame, ts: str) -> DataFrame:
    """Events by hour of the day: always 24 rows."""
    seen = df.groupBy(F.hour(ts).cast("long").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    hours = df.sparkSession.range(24).withColumnRenamed("id", "hour")
    return hours.join(seen, F.col("hour") == F.col("h"), "left").select("hour", F.coalesce("n", F.lit(0)).alias("events"))


def weekend_ratio(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Events, those on Saturdays and Sundays, and their share in basis points (rounded down)."""
    weekend = F.dayofweek(ts).isin(1, 7)
    return df.groupBy(*keys).agg(F.count(ts).alias("events"), F.count_if(weekend).alias("weekend_events")).withColumn("weekend_bp", F.floor(F.try_divide(F.col("weekend_events") * 10000, F.col("events"))).cast("long"))


def night_minutes(df: DataFrame, keys: list[str], ts: str, before: int = 6) -> DataFrame:
    """Distinct minutes with an event before that hour, by month."""
    rows = df.where(F.hour(ts) < before).select(*keys, F.date_format(ts, "yyyy-MM").alias("month"), minute(ts).alias("m"))
    return rows.distinct().groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("night_minutes"))


def span(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The accumulated session: first and last instant, events, distinct minutes and days."""
    return df.groupBy(*keys).agg(F.min(micros(ts)).alias("first_micros"), F.max(micros(ts)).alias("last_micros"), F.count(F.lit(1)).alias("events"), F.count_distinct(minute(ts)).alias("minutes"), F.count_distinct(F.to_date(ts)).alias("days"))


def calendar_strip(df: DataFrame, day: Column, days: int = 90) -> DataFrame:
    """The last ``days`` days up to the latest, each with its events, zero where there were none."""
    counts = df.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    last = counts.agg(F.max("d").alias("last")).where("last is not null")
    strip = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return strip.join(counts, F.col("day") == F.col("d"), "left").select("day", F.coalesce("n", F.lit(0)).alias("events"))


def gap_sessions(df: DataFrame, keys: list[str], ts: str, minutes: int = 15) -> DataFrame:
    """Sessions that close after a gap of ``minutes``: start, end, events of each."""
    w = F.session_window(F.col(ts).cast("timestamp"), f"{minutes} minutes")
    return df.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max(micros(ts)).alias("end_micros")).select(*keys, F.unix_micros("w.start").alias("start_micros"), "end_micros", "events")
