"""Counting facts that are observed more than once.

A streamed message is written again and again with growing counters, profiles
are copied, files are scanned anew. Each identity has its own rule: a message
counts its maximum, a copied row its first sight, a cumulative counter its
last value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators import scans
from tallymark.session import kept


def _lone(ident: str) -> Column:
    """A key of its own for each row without identity, so that such rows neither meet nor need a second scan."""
    return F.when(F.col(ident).isNull(), F.monotonically_increasing_id())


def max_per_id(df: DataFrame, ident: str, counters: list[str]) -> DataFrame:
    """Each identity's counters at their maximum; rows without identity stand for themselves."""
    best = df.groupBy(ident, _lone(ident).alias("__lone")).agg(*(F.max(F.greatest(F.lit(0), c)).alias(c) for c in counters))
    return best.drop("__lone")


def _credit(ident: str, own: Column, before: Column) -> Column:
    """By how much a row raises its identity's maximum so far; rows without identity count whole."""
    own, zero = F.coalesce(own, F.lit(0)), F.lit(0)
    return F.when(F.col(ident).isNull(), F.greatest(own, zero)).otherwise(F.greatest(own - F.greatest(F.coalesce(before, zero), zero), zero))


def running_credits(df: DataFrame, ident: str, order: list[str], counters: list[str], segment: list[str] | None = None) -> DataFrame:
    """Rows with each counter replaced by its credit: all counters in one window.

    With ``segment``, columns that cut ``order`` into stretches, the rows of one
    identity do not meet in one task, however many they are.
    """
    if segment:
        before = {f"__before_{c}": ("max", F.col(c)) for c in counters}
        rows = scans.prefix_scan(df, [ident], segment, order, before, inclusive=False)
        return rows.withColumns({c: _credit(ident, F.col(c), F.col(f"__before_{c}")) for c in counters}).drop(*before)
    keyed = df.withColumn("__lone", _lone(ident))
    so_far = Window.partitionBy(ident, "__lone").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return keyed.withColumns({c: _credit(ident, F.col(c), F.max(c).over(so_far)) for c in counters}).drop("__lone")


def running_credit(df: DataFrame, ident: str, order: list[str], counter: str, segment: list[str] | None = None) -> DataFrame:
    """Rows with ``credit``: by how much each raises its identity's maximum so far.

    The credits of an identity sum to its maximum, and each goes to the row
    (hence the session) that raised it.
    """
    return running_credits(df.withColumn("credit", F.col(counter)), ident, order, ["credit"], segment)


def credits_by(df: DataFrame, ident: str, owner: str, order: list[str], counters: list[str], segment: list[str]) -> DataFrame:
    """Each owner's sum of its rows' credits (:func:`running_credits`).

    The credits of an identity that one owner has alone come to its maximum, in
    whatever order; only identities that several owners share are scanned in
    order. Which these are is kept, as it is used twice.
    """
    keyed = df.withColumn("__lone", _lone(ident))
    most = keyed.groupBy(ident, owner, "__lone").agg(*(F.max(F.greatest(F.lit(0), c)).alias(c) for c in counters)).drop("__lone")
    pairs = df.where(F.col(ident).isNotNull()).select(ident, owner).distinct()
    shared = kept(pairs.groupBy(ident).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(ident), "shared")
    alone = most.join(shared, ident, "left_anti").select(owner, *counters)
    raised = running_credits(df.join(shared, ident, "left_semi"), ident, order, counters, segment).select(owner, *counters)
    return alone.unionByName(raised).groupBy(owner).agg(*(F.sum(c).cast("long").alias(c) for c in counters))


def last_wins(df: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """A cumulative counter's session totals: the values of the row that comes last."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v")).select(*keys, "v.*")


def first_wins(df: DataFrame, ident: str, order: Column) -> DataFrame:
    """One row per identity, the first by ``order``; all rows without identity.

    An aggregation rather than a window: copies are dropped before the shuffle.
    """
    columns = df.columns
    keyed = df.withColumn("__lone", _lone(ident))
    return keyed.groupBy(ident, "__lone").agg(F.min_by(F.struct(*columns), order).alias("__r")).select("__r.*")


def forward_fill(df: DataFrame, part: list[str], order: list[str], value: str, fallback: Column, segment: list[str] | None = None) -> DataFrame:
    """``value`` where it is missing becomes the last one seen in the part, else ``fallback``.

    With ``segment``, columns that cut a part's order into stretches, a part is
    no one task: see :func:`tallymark.operators.scans.prefix_scan`. Only parts in
    which a value is missing are scanned, and what is filled in is kept.
    """
    if segment:
        missing = F.col(value).isNull()
        lacking = kept(df.where(missing).select(*(F.col(p).alias(f"__lacks_{p}") for p in part)).distinct(), "lacking")
        if lacking.isEmpty():
            return df
        same = reduce(lambda a, b: a & b, (F.col(p).eqNullSafe(F.col(f"__lacks_{p}")) for p in part))
        rows = scans.prefix_scan(df.join(lacking, same, "left_semi"), part, segment, order, {"__seen": ("last", F.col(value))})
        filled = rows.where(missing).withColumn(value, F.coalesce("__seen", fallback)).select(*df.columns)
        return df.where(~missing).unionByName(kept(filled, "filled"))
    seen = F.last(value, ignorenulls=True).over(Window.partitionBy(*part).orderBy(*order))
    return df.withColumn(value, F.coalesce(seen, fallback))


def subset_split(total: Column, part: Column) -> tuple[Column, Column]:
    """A counter that includes another one: what is left of it, and the part bounded by it."""
    return F.greatest(F.lit(0), total - part), F.least(part, total)


def strict_int(value: Column) -> Column:
    """A JSON number that is whole, as long; strings, fractions and junk are 0.

    ``value`` is a VARIANT.
    """
    number = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    double = F.try_variant_get(value, "$", "double")
    return F.when(number & (double == F.floor(double)), double.cast("long")).otherwise(F.lit(0))


def finite(value: Column) -> Column:
    """A value coerced to double; junk, infinities and NaN are 0."""
    double = value.try_cast("double")
    return F.when(double.isNotNull() & ~F.isnan(double) & (F.abs(double) < float("inf")), double).otherwise(F.lit(0.0))


def whole(value: Column) -> Column:
    """A value coerced to double that must then be whole, as long; else 0."""
    double = finite(value)
    return F.when(double == F.floor(double), double.cast("long")).otherwise(F.lit(0))
