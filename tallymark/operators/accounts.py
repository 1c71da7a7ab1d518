"""Accounts: fold usage to them and floor it with a vendor's frozen counter.

A counter is what the vendor had counted up to a date; days after that date
come on top, once per account however many profiles it has. The floor is the
greater of that sum and of what was measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(usage: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Sums of the counters by keys, with the number of rows."""
    return usage.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *(F.sum(c).cast("long").alias(c) for c in counters))


def latest_counter(counters: DataFrame, order: str) -> DataFrame:
    """One counter per account: the last by ``order``."""
    return counters.groupBy("account").agg(F.max_by(F.struct("counter", "last_computed"), order).alias("c")).select("account", "c.*")


def floor(days: DataFrame, counters: DataFrame) -> DataFrame:
    """Each account's measured sum, its sum after the counter's date, and its floor.

    ``days`` has account, day and value; ``counters`` has one row per account
    with counter and last_computed. Accounts of either side are kept.
    """
    met = days.join(counters, "account", "full")
    after = F.sum(F.when(F.col("day") > F.col("last_computed"), F.col("value")))
    sums = met.groupBy("account").agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("measured"), F.coalesce(after, F.lit(0)).cast("long").alias("after"), F.first("counter", ignorenulls=True).alias("counter"))
    return sums.select("account", "measured", "after", "counter", F.when(F.col("counter").isNull(), F.col("measured")).otherwise(F.greatest(F.col("counter") + F.col("after"), "measured")).cast("long").alias("floor"))


def floor_total(floors: DataFrame) -> DataFrame:
    """Sums over all accounts: measured, and floored where there is a floor."""
    return floors.agg(F.sum("measured").cast("long").alias("measured"), F.sum(F.coalesce("floor", "measured")).cast("long").alias("floored"))


def claim_once(profiles: DataFrame, account: str, order: list[str], value: str) -> DataFrame:
    """An account's value on its first profile only, null on the others."""
    nth = F.row_number().over(Window.partitionBy(account).orderBy(*order))
    return profiles.withColumn(value, F.when(nth == 1, F.col(value)))


def larger_vector(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Of two counter vectors the one of larger sum, whole."""
    first = sum(a.values(), F.lit(0)) >= sum(b.values(), F.lit(0))
    return {k: F.when(first, a[k]).otherwise(b[k]) for k in a}
