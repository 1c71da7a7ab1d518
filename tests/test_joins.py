"""As-of and overlap joins against every pair, with nulls, ties, long intervals and one key that has most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import joins

LEFT, RIGHT = "k string, at long, name long", "k string, since long, v long, tie long"


def rows_of(seed, n):
    rng = random.Random(seed)
    key = lambda: rng.choice(["a"] * 6 + ["b", "c", None])
    left = [(key(), rng.choice([None, *range(0, 4000, 7)]), i) for i in range(n)]
    right = [(key(), rng.choice([None, *range(0, 4000, 13)]), rng.choice([None, rng.randint(0, 99)]), i) for i in range(n)]
    return left, right


@pytest.mark.parametrize("strictly, within", [(False, None), (True, None), (False, 40), (True, 0)])
@pytest.mark.parametrize("keyed", [True, False])
def test_as_of_equals_every_pair(spark, strictly, within, keyed):
    left, right = rows_of(1, 250)

    def last(k, at):
        fit = [(s, t, v) for rk, s, v, t in right if (rk == k or not keyed) and s is not None and at is not None and (s < at if strictly else s <= at)]
        best = max(fit, default=None)
        return (best[0], best[2]) if best and (within is None or at - best[0] <= within) else (None, None)

    got = joins.as_of(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"] if keyed else [], "at", "since", ["v"], "tie", strictly, within, pieces=9)
    assert got.columns == ["k", "at", "name", "since", "v"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [(k, at, i, *last(k, at)) for k, at, i in left]


def test_as_of_without_rows(spark):
    left, right = (spark.createDataFrame(x, s) for x, s in zip(rows_of(2, 20), (LEFT, RIGHT), strict=True))
    assert joins.as_of(left.limit(0), right, ["k"], "at", "since", ["v"]).count() == 0
    alone = joins.as_of(left, right.limit(0), ["k"], "at", "since", ["v"])
    assert alone.count() == 20 and alone.where("since is not null or v is not null").count() == 0


SPANS = "k string, s long, e long, id long"


def spans(seed, n):
    """Points, short and very long intervals, negative times, some that end before they begin."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randint(-3000, 3000)
        out.append((rng.choice(["a"] * 4 + ["b", None]), rng.choice([start] * 9 + [None]), start + rng.choice([0, 1, 7, 8, 63, 64, 65, 500, 4096, 100_000, -5]), i))
    return out


@pytest.mark.parametrize("width", [1, 8, 10_000])
def test_overlaps_equal_every_pair(spark, width):
    a, b = spans(3, 160), spans(4, 170)
    got = joins.overlaps(spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS), ["k"], ("s", "e"), ("s", "e"), ["id"], ["id"], width)
    want = [(k, i, j) for k, s, e, i in a for m, t, f, j in b if k == m and None not in (s, t) and s <= e and t <= f and s <= f and t <= e]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
    none = spark.createDataFrame([], SPANS)
    assert joins.overlaps(none, none, ["k"], ("s", "e"), ("s", "e"), ["id"], ["id"], width).count() == 0


def test_a_long_interval_is_dealt_out_in_few_rows(spark):
    df = spark.createDataFrame([(0, 10**12)] + [(i, i + 1) for i in range(1000)], "s long, e long")
    levels = df.select(joins._level(F.col("s"), F.col("e"), 2).alias("__at_level")).distinct()
    dealt = joins._buckets(df, F.col("s"), F.col("e"), 2, levels)
    assert levels.count() == 2 and dealt.count() <= 2 * 2 * 1001
    # A key that all share: what meets besides the pairs is bounded by the buckets, not by the key.
    one = spark.range(3000).select(F.lit("x").alias("k"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 3).alias("e"), "id")
    pairs = joins.overlaps(one, one, ["k"], ("s", "e"), ("s", "e"), ["id"], ["id"], 4)
    assert pairs.where("left_id = right_id").count() == 3000 == pairs.count()


def test_overlap_counts_equal_every_pair(spark):
    """counts and last starts without the pairs; equal ends, long intervals over quiet times, one who alone."""
    rng = random.Random(6)
    rows = []
    for who in range(25):
        at = rng.randint(-50, 50)
        while at < 400:
            end = at + rng.choice([0, 1, 3, 5, 40, 300])
            rows.append((who % 2 if who else None, who, at, end))
            at = end + rng.choice([1, 2, 10, 150])
    rows += [(7, 99, 0, 5), (8, 1, 0, 1000), (8, 2, 10, 900), (8, 3, 500, 501), (8, 4, 501, 501), (8, 5, 1001, 1002)]
    got = joins.overlap_counts(spark.createDataFrame(rows, "k long, w long, s long, e long"), ["k"], "w", "s", "e", 4)
    assert got.columns == ["k", "w", "s", "others", "last_start"]
    want = []
    for k, w, s, e in rows:
        met = [t for m, v, t, f in rows if m == k and v != w and t <= e and s <= f]
        if met:
            want.append((k, w, s, len(met), max(met)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
