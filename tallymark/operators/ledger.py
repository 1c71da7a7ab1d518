"""An append-only ledger of session totals, observed again with every scan.

Columns: cli, session_id, version, pos (place in the ledger), total, counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import kept

KEY = ["cli", "session_id"]


def lifetime(rows: DataFrame, counters: list[str]) -> DataFrame:
    """Each session's counters: the maximum of each over rows of its newest version.

    A version is as new as the last row of the ledger that carries it.
    """
    # Rows are summed up first, in one scan and by hashing: rows of one version would meet in one task of a join.
    best = kept(rows.groupBy(*KEY, "version").agg(F.max("pos").alias("pos"), *(F.max(c).alias(c) for c in counters)), "versions")
    newest = best.groupBy(F.col("version").alias("newest")).agg(F.max("pos").alias("rank"))
    named = best.where("cli is not null and session_id is not null")
    ranked = named.join(F.broadcast(newest), F.col("version").eqNullSafe(F.col("newest"))).select(*KEY, *counters, "rank")
    # Versions of one rank count together. Numbers only, which are hashed, where a maximum of structs would sort every row.
    ranked = ranked.groupBy(*KEY, "rank").agg(*(F.max(c).alias(c) for c in counters))
    return ranked.groupBy(*KEY).agg(*(F.max_by(c, "rank").alias(c) for c in counters))


def append_plan(ledger: DataFrame, scan: DataFrame) -> DataFrame:
    """Rows of a scan to append: totals above 0 that exceed all before them of the same session and version.

    Rows of one scan see the rows before them.
    """
    keys = [*KEY, "version"]
    had = ledger.groupBy(*keys).agg(F.max("total").alias("had"))
    before = F.max("total").over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    fresh = scan.withColumn("before", before).join(had, keys, "left")
    return fresh.where("total > 0 and total > coalesce(before, 0) and total > coalesce(had, 0)").drop("before", "had")


def compacted(rows: DataFrame) -> DataFrame:
    """One row for each session and version: its last place, everything else at its maximum.

    It says what all the rows say: a version is as new as its last row, a
    session's counters are maxima over its newest version, and an observation is
    appended if it exceeds the total of its version.
    """
    keys = [*KEY, "version"]
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in others)).select(*rows.columns)


def compare(ledger: DataFrame, disk: DataFrame) -> DataFrame:
    """Sessions of the ledger by where they are: ``ledger_only`` or ``both``."""
    known = ledger.select(*KEY).distinct()
    there = disk.select(*KEY).distinct().withColumn("there", F.lit(True))
    return known.join(there, KEY, "left").groupBy(F.when(F.col("there"), "both").otherwise("ledger_only").alias("place"), "cli").agg(F.count(F.lit(1)).alias("sessions"))
