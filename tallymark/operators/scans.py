"""Prefix scans over parts of any size: no task holds a whole part.

A running value over a file, a message id or a session is a window, and a window
takes its part in one task. Here a part is cut into segments that follow each
other: each is scanned by itself, its outcome is one row, outcomes are scanned
in turn, and what comes from the segments before is joined to the rows. So a log
that splits on reading stays split.

The input is used twice; give a table that is kept, not one that is parsed anew.
Nulls are keys like others. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import kept

#: How a running value is taken: over rows in a window, and from two neighbouring stretches.
KINDS = {
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, here: F.coalesce(here, before)),
    "max": (F.max, lambda before, here: F.greatest(before, here)),
    "min": (F.min, lambda before, here: F.least(before, here)),
    "sum": (F.sum, lambda before, here: F.coalesce(before + here, here, before)),
}


def _outcome(kind: str, value: Column, order: list[str]) -> Column:
    """A segment's outcome, as an aggregate that is combined before the shuffle."""
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return KINDS[kind][0](value)


def prefix_scan(df: DataFrame, part: list[str], segment: list[str], order: list[str], values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """``df`` with running values, each over the rows of its part up to its own, or before it.

    ``values`` maps a new column to its kind (:data:`KINDS`) and what is taken.
    Segments are ordered by their columns; rows of one come, in ``order``, after
    all rows of the segments before it.
    """
    taken = {name: f"__{name}" for name in values}
    rows = df.withColumns({taken[name]: value for name, (_, value) in values.items()})
    group = [*part, *(s for s in segment if s not in part)]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(*part).orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)
    outcomes = rows.groupBy(*group).agg(*(_outcome(kind, F.col(taken[name]), order).alias(taken[name]) for name, (kind, _) in values.items()))
    carries = outcomes.select(*(F.col(g).alias(f"__key_{g}") for g in group), *(KINDS[kind][0](taken[name]).over(earlier).alias(f"__carry_{name}") for name, (kind, _) in values.items()))
    found = rows.withColumns({taken[name]: KINDS[kind][0](taken[name]).over(inside) for name, (kind, _) in values.items()})
    same = reduce(lambda a, b: a & b, (found[g].eqNullSafe(F.col(f"__key_{g}")) for g in group))
    met = found.join(carries, same, "left")
    others = [c for c in df.columns if c not in values]
    return met.select(*others, *(KINDS[kind][1](F.col(f"__carry_{name}"), F.col(taken[name])).alias(name) for name, (kind, _) in values.items()))


def even_segments(df: DataFrame, *order: str, pieces: int = 64, name: str = "segment") -> DataFrame:
    """``df``, kept, with a segment number that rises with ``order``; segments hold about as many rows each.

    Spark's range partitioning draws the bounds from a sample, so a burst of rows
    at one time makes more segments there, not a larger one. Only rows that are
    equal in all of ``order`` stay together. It is written once, for bounds drawn
    anew would be others.
    """
    dealt = df.repartitionByRange(pieces, *order).withColumn(name, F.spark_partition_id())
    return kept(dealt, "segments")
