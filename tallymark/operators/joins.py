"""Joins on order: the last row at or before a time, and intervals that overlap.

Neither compares every pair, and neither holds a key in one task. Null keys meet
null keys; rows of a null time or end meet nothing. Empty tables give empty
results, or rows without a partner.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators import scans
from tallymark.session import kept

#: Stretches of time, of as many rows each, into which an as-of join cuts both sides.
PIECES = 64
#: Each level of an overlap join has buckets so many times as wide as the one below.
FACTOR = 8


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str], tie: str | None = None, strictly: bool = False, within: int | None = None, pieces: int = PIECES) -> DataFrame:
    """``left`` with ``since`` and ``values`` of the last ``right`` row of its keys at or before ``at``; null if there is none.

    ``at`` and ``since`` are whole numbers, such as microseconds. Of rows of one
    time the one of greatest ``tie`` counts. ``strictly``: before, not at.
    ``within``: no longer before than that. Both sides become one table in which
    the last value seen is carried on, in segments of time, so that a key of any
    size is many tasks.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    extra = [tie] if tie else []
    carried = list(dict.fromkeys([since, *values]))
    mine = left.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(at).cast("long").alias("__at"), F.lit(0 if strictly else 1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(F.struct(*carried)).schema[0].dataType).alias("__right"), *(none(right, t).alias("__tie") for t in extra))
    theirs = right.where(F.col(since).isNotNull()).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(since).cast("long").alias("__at"), F.lit(1 if strictly else 0).alias("__side"), F.lit(None).cast(mine.schema["__left"].dataType).alias("__left"), F.struct(*carried).alias("__right"), *(F.col(t).alias("__tie") for t in extra))
    names = [f"__k{i}" for i in range(len(keys))]
    order = ["__at", "__side", *(["__tie"] if tie else [])]
    both = scans.even_segments(mine.unionByName(theirs), *order, pieces=pieces, name="__segment")
    seen = scans.prefix_scan(both, names, ["__segment"], order, {"__seen": ("last", F.col("__right"))}).where("__left is not null")
    near = F.col("__left")[at].isNotNull()
    if within is not None:
        near = near & (F.col("__at") - F.col("__seen")[since].cast("long") <= within)
    return seen.select("__left.*", *(F.when(near, F.col("__seen")[c]).alias(c) for c in carried))


def _level(start: Column, end: Column, width: int) -> Column:
    """The lowest level whose buckets are no narrower than the interval."""
    return F.greatest(F.lit(0), F.ceil(F.log((end - start + 1) / F.lit(float(width))) / F.log(F.lit(float(FACTOR))) - 1e-9)).cast("int")


def _buckets(df: DataFrame, start: Column, end: Column, width: int, levels: DataFrame) -> DataFrame:
    """Each interval at its own level and at those above it that are in use, once for each bucket it lies in: one or two."""
    size = F.lit(float(width)) * F.pow(F.lit(float(FACTOR)), F.col("__at_level"))
    own = df.withColumns({"__start": start.cast("long"), "__end": end.cast("long")}).where("__start <= __end").withColumn("__level", _level(F.col("__start"), F.col("__end"), width))
    raised = own.join(F.broadcast(levels), F.col("__at_level") >= F.col("__level"))
    return raised.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__start") / size), F.floor(F.col("__end") / size))))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], left_id: list[str], right_id: list[str], width: int) -> DataFrame:
    """Pairs of intervals (closed, whole numbers) with equal keys that overlap, each once: left_id, right_id and keys.

    Time is cut into buckets of ``width``, and at each higher level of
    :data:`FACTOR` times that. An interval is dealt out at the level of its own
    length and above, into two buckets at most; a pair meets at the level of the
    longer one, in the bucket where the later of them begins. So neither long
    intervals nor a wrong ``width`` make many rows, and what is made besides the
    pairs is in proportion to the intervals.
    """
    level = lambda df, ends: df.where(F.col(ends[0]) <= F.col(ends[1])).select(_level(F.col(ends[0]).cast("long"), F.col(ends[1]).cast("long"), width).alias("__at_level")).distinct()
    levels = level(left, left_ends).union(level(right, right_ends)).distinct()
    deal = lambda df, ends, names, mark: _buckets(df.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.struct(*names).alias("__id"), *(F.col(e) for e in dict.fromkeys(ends))), F.col(ends[0]), F.col(ends[1]), width, levels).select(*(F.col(c).alias(f"{c}{mark}") for c in (*(f"__k{i}" for i in range(len(keys))), "__id", "__start", "__end", "__level", "__at_level", "__bucket")))
    a, b = deal(left, left_ends, left_id, "_a"), deal(right, right_ends, right_id, "_b")
    col = F.col
    same = reduce(lambda x, y: x & y, [col(f"__k{i}_a").eqNullSafe(col(f"__k{i}_b")) for i in range(len(keys))], (col("__at_level_a") == col("__at_level_b")) & (col("__bucket_a") == col("__bucket_b")))
    size = F.lit(float(width)) * F.pow(F.lit(float(FACTOR)), col("__at_level_a"))
    meet = (col("__at_level_a") == F.greatest("__level_a", "__level_b")) & (col("__start_a") <= col("__end_b")) & (col("__start_b") <= col("__end_a"))
    once = F.floor(F.greatest("__start_a", "__start_b") / size) == col("__bucket_a")
    found = a.join(b, same & meet & once)
    return found.select(*(col(f"__k{i}_a").alias(k) for i, k in enumerate(keys)), *(col("__id_a")[c].alias(f"left_{c}") for c in left_id), *(col("__id_b")[c].alias(f"right_{c}") for c in right_id))


def overlap_counts(df: DataFrame, keys: list[str], who: str, start: str, end: str, width: int) -> DataFrame:
    """keys, who, start, others, last_start: how many intervals of equal keys and another ``who`` overlap each one, and the last start of these.

    Intervals are closed whole numbers, none of one ``who`` and keys overlap each
    other, and no name is null. Pairs are counted, not made: those that begin by
    an interval's end, less those that end before it begins. The last of the
    former that is another's counts if it begins inside. Only where none does,
    the intervals that hold the start are looked up as pairs; such starts lie
    further apart than their intervals are long, so they are few.
    """
    mine = df.select(*keys, who, F.col(start).cast("long").alias("__start"), F.col(end).cast("long").alias("__end")).where("__start <= __end")
    points = mine.select("*", F.explode(F.array(F.struct(F.col("__start").alias("t"), F.lit(0).alias("side")), F.struct(F.col("__end").alias("t"), F.lit(1).alias("side")))).alias("p")).select("*", F.col("p.t").alias("__t"), F.col("p.side").alias("__side")).drop("p")
    order = ["__t", "__side", who]
    cut = scans.even_segments(points, *order, name="__segment")
    begins = F.col("__side") == 0
    seen = {"__begun": ("sum", F.when(begins, 1).otherwise(0)), "__ended": ("sum", F.col("__side")), "__last": ("last", F.when(begins, F.struct(F.col("__t").alias("t"), F.col(who).alias("who"))))}
    scanned = kept(scans.prefix_scan(cut, keys, ["__segment"], order, seen, inclusive=False), "begun")
    # The last start that is not by who made the last one.
    turned = F.when(begins & (F.col("__last.who") != F.col(who)), F.col("__last"))
    both = scans.prefix_scan(scanned, keys, ["__segment"], order, {"__other": ("last", turned)})
    near = F.when(F.col("__last.who") != F.col(who), F.col("__last.t")).otherwise(F.col("__other.t"))
    ids = [*keys, who, "__start", "__end"]
    others = F.max(F.when(~begins, F.col("__begun"))) - F.coalesce(F.max(F.when(begins, F.col("__ended"))), F.lit(0)) - 1
    found = kept(both.groupBy(*ids).agg(others.cast("long").alias("others"), F.max(F.when(~begins, near)).alias("last_start")).where("others > 0"), "counted")
    inside = found.where("last_start >= __start").drop("__end")
    without = found.where("last_start is null or last_start < __start").select(*ids, "others")
    pairs = overlaps(without, mine, keys, ("__start", "__start"), ("__start", "__end"), [who, "__start"], [who, "__start"], width).where(F.col(f"left_{who}") != F.col(f"right_{who}"))
    last = pairs.groupBy(*keys, F.col(f"left_{who}").alias(who), F.col("left___start").alias("__start")).agg(F.max("right___start").alias("last_start"))
    rest = without.drop("__end").join(last, [*keys, who, "__start"]).select(*inside.columns)
    return inside.unionByName(rest).withColumnRenamed("__start", start)
