"""Machines and their registry: roll-ups over several levels, and who is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hierarchy(usage: DataFrame, levels: list[str], measures: list[str]) -> DataFrame:
    """Totals at each prefix of ``levels`` in one pass; ``level`` counts the levels named (0: all)."""
    depth = sum((F.lit(1) - F.grouping(c).cast("int") for c in levels), F.lit(0))
    return usage.rollup(*levels).agg(F.count(F.lit(1)).alias("n_rows"), *(F.sum(m).cast("long").alias(m) for m in measures), depth.cast("int").alias("level"))


def matrix(usage: DataFrame, rows: str, columns: str, measure: str) -> DataFrame:
    """Sums by two dimensions, in long form."""
    return usage.groupBy(rows, columns).agg(F.sum(measure).cast("long").alias(measure))


def machine_floor(days: DataFrame, counters: DataFrame, other: DataFrame) -> DataFrame:
    """Each machine's floor: its accounts' counters plus later days, or what was measured, plus other tools' sessions.

    ``days`` has machine, account, day, value; ``counters`` has machine, account,
    counter, last_computed; ``other`` has machine and value.
    """
    met = days.join(counters, ["machine", "account"], "left")
    by_account = met.groupBy("machine", "account").agg(F.sum("value").alias("measured"), F.coalesce(F.sum(F.when(F.col("day") > F.col("last_computed"), F.col("value"))), F.lit(0)).alias("after"), F.max("counter").alias("counter"))
    floored = F.greatest("measured", F.coalesce(F.col("counter") + F.col("after"), "measured"))
    ours = by_account.groupBy("machine").agg(F.sum("measured").cast("long").alias("measured"), F.sum(floored).cast("long").alias("floored"))
    more = other.groupBy("machine").agg(F.sum("value").cast("long").alias("other"))
    return ours.join(more, "machine", "full").select("machine", F.coalesce("measured", F.lit(0)).alias("measured"), F.coalesce("other", F.lit(0)).alias("other"), (F.coalesce("floored", F.lit(0)) + F.coalesce("other", F.lit(0))).alias("floor"))


def never_scanned(roster: DataFrame, seen: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Roster rows whose every key is missing from the column of ``seen`` that it maps to."""
    out = roster
    for mine, theirs in keys.items():
        there = seen.select(F.col(theirs).alias(mine)).where(F.col(mine).isNotNull()).distinct()
        out = out.join(there, mine, "left_anti")
    return out.select(*roster.columns)


def prefix_relabel(short: DataFrame, registry: DataFrame, prefix: str, full: str, label: str, order: str) -> DataFrame:
    """The label of the first registry row, by ``order``, whose ``full`` begins with ``prefix``.

    Prefixes of one length are met by an equi-join on the cut-off key, so the
    join is hashed instead of comparing every pair; lengths are few.
    """
    lengths = short.select(F.length(prefix).alias("size")).where("size is not null").distinct()
    cut = registry.crossJoin(F.broadcast(lengths)).where(F.length(full) >= F.col("size")).select(F.substring(F.col(full), F.lit(1), F.col("size")).alias(prefix), label, order)
    found = cut.groupBy(prefix).agg(F.min_by(label, order).alias(label))
    return short.join(found, prefix, "left").select(*short.columns, label)


#: Parts of so many characters find the texts that a needle may stand in.
GRAM = 4


def grams(text: Column, size: int) -> Column:
    """The distinct parts of ``size`` characters of a text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    parts = F.transform(starts, lambda at: F.substring(text, at, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def _sought(needles: DataFrame, needle: str, haystack: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Needles with the part they are sought by, parts with the texts that hold them, and the distinct texts.

    A needle is sought by the rarest of its parts of :data:`GRAM` characters, in
    the texts that have that part, and verified there. A text is written out once
    a character, whatever needles there are, and once more for each length of
    needles shorter than a part. Only parts that some needle has are counted.
    """
    low = haystack.where(F.col(text).isNotNull()).select(F.lower(text).alias("low")).distinct()
    low = low.withColumn("at", F.xxhash64("low"))
    sought = needles.where(F.length(needle) > 0).select(F.lower(needle).alias("low_needle")).distinct()
    size = F.least(F.length("low_needle"), F.lit(GRAM))
    asked = sought.select("low_needle", size.alias("size")).withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length("low_needle") - F.col("size") + 1), lambda at: F.substring(F.col("low_needle"), at, F.col("size")))))
    wanted = asked.select("gram").distinct()
    sizes = sorted(r["size"] for r in sought.select(size.alias("size")).distinct().collect())
    written = low.select("at", F.explode(F.flatten(F.array(*(grams(F.col("low"), n) for n in sizes))) if sizes else F.array().cast("array<string>")).alias("gram"))
    held = written.join(wanted, "gram", "left_semi")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    ranked = asked.join(counts, "gram", "left").groupBy("low_needle").agg(F.min_by(F.struct("gram", "texts"), F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("best"))
    return ranked.where(F.col("best.texts").isNotNull()).select("low_needle", F.col("best.gram").alias("gram")), held, low


def contained(needles: DataFrame, needle: str, haystack: DataFrame, text: str) -> DataFrame:
    """The distinct lower-case needles that stand in some text as a part of it, without regard to case."""
    rare, held, low = _sought(needles, needle, haystack, text)
    # A needle no longer than a part stands wherever that part does.
    short = rare.where(F.length("low_needle") <= GRAM).select("low_needle")
    met = rare.where(F.length("low_needle") > GRAM).join(held, "gram").select("low_needle", "at").join(low, "at")
    return short.unionByName(met.where(F.col("low").contains(F.col("low_needle"))).select("low_needle")).distinct()


def not_contained(needles: DataFrame, needle: str, haystack: DataFrame, text: str) -> DataFrame:
    """Needles that stand in no text as a part of it, without regard to case; empty and null ones are left out."""
    there = contained(needles, needle, haystack, text)
    kept = needles.where(F.length(needle) > 0)
    return kept.join(there, F.lower(needle) == F.col("low_needle"), "left_anti").select(*needles.columns)


def without_fragments(haystack: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Rows whose text holds none of a table of needles, without regard to case; rows without a text hold none.

    Needles may be as many as texts: they meet by the parts that :func:`contained` seeks them by.
    """
    rare, held, low = _sought(needles, needle, haystack, text)
    met = rare.join(held, "gram").join(low, "at").where(F.col("low").contains(F.col("low_needle")))
    return haystack.join(met.select("low").distinct(), F.lower(text) == F.col("low"), "left_anti").select(*haystack.columns)


def longest_prefix(paths: DataFrame, path: str, known: DataFrame, folder: str) -> DataFrame:
    """``paths`` with the longest known folder that is the path or contains it.

    A path is looked up by each of its own folders, so the join is an equi-join.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = known.select(F.col(folder)).distinct()
    met = paths.select(path).distinct().select(path, F.explode(above).alias(folder)).join(folders, folder)
    best = met.groupBy(path).agg(F.max_by(folder, F.length(folder)).alias(folder))
    return paths.join(best, path, "left")


def distinct_over(usage: DataFrame, dimensions: list[str], sums: list[str]) -> DataFrame:
    """Distinct values over the whole fleet (not summed by machine), and sums."""
    return usage.agg(*(F.count_distinct(d).alias(f"n_{d}") for d in dimensions), *(F.sum(s).cast("long").alias(s) for s in sums))


def unequal_parts(parts: DataFrame, wholes: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """The gate before writing: keys whose parts do not add up to the whole. Must be empty."""
    added = parts.groupBy(*keys).agg(F.sum(measure).alias("added"))
    stated = wholes.groupBy(*keys).agg(F.sum(measure).alias("stated"))
    return added.join(stated, keys, "full").where(~F.col("added").eqNullSafe(F.col("stated")))
