"""Roll-ups that are kept, not made anew: partial results that merge.

A measure is one of

* ``sum``, ``count``, ``max``, ``min``: a number that merges by itself;
* ``set``: its distinct values, exact, kept as rows of their own;
* ``sketch``: its distinct values as a HyperLogLog sketch of fixed size.

A partial table has a row a group, so groups of rows seen apart, on several
machines or in several batches, add up to what one pass over all rows gives, and
finer groups add up to coarser ones without a look at the rows. A sketch of
``2 ** lg_k`` registers has a relative standard error of 1.04 / 2 ** (lg_k / 2).

Null values count for nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.sources.commits import Committed, Version

NUMBERS = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "max": (F.max, F.max), "min": (F.min, F.min)}
LG_K = 12


@dataclass(frozen=True)
class Measure:
    kind: str
    value: Column | str
    lg_k: int = LG_K

    @property
    def column(self) -> Column:
        return F.col(self.value) if isinstance(self.value, str) else self.value


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a sketch's estimate."""
    return 1.04 / 2 ** (lg_k / 2)


def numbers(rows: DataFrame, keys: list[str], measures: dict[str, Measure]) -> DataFrame:
    """A row a group: numbers and sketches of its rows."""
    aggs = []
    for name, m in measures.items():
        if m.kind == "sketch":
            aggs.append(F.hll_sketch_agg(m.column, m.lg_k).alias(name))
        elif m.kind != "set":
            aggs.append(NUMBERS[m.kind][0](m.column).alias(name))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)


def members(rows: DataFrame, keys: list[str], measures: dict[str, Measure]) -> DataFrame:
    """The distinct values of each group's sets: keys, measure, member (as string)."""
    sets = F.array(*(F.struct(F.lit(name).alias("measure"), m.column.cast("string").alias("member")) for name, m in measures.items() if m.kind == "set"))
    return rows.select(*keys, F.explode(sets).alias("__s")).select(*keys, "__s.*").where("member is not null").distinct()


def merged(parts: DataFrame, keys: list[str], measures: dict[str, Measure]) -> DataFrame:
    """Partial rows of equal groups as one row each; also for coarser groups."""
    aggs = []
    for name, m in measures.items():
        if m.kind == "sketch":
            aggs.append(F.hll_union_agg(name).alias(name))
        elif m.kind != "set":
            aggs.append(NUMBERS[m.kind][1](name).alias(name))
    return parts.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), *aggs)


def finished(parts: DataFrame, sets: DataFrame | None, keys: list[str], measures: dict[str, Measure]) -> DataFrame:
    """What the partial tables say by ``keys``, which may be coarser than theirs: numbers, sizes of sets, estimates."""
    flat = parts if keys else parts.withColumn("__all", F.lit(1))
    keys_ = keys or ["__all"]
    out = merged(flat, keys_, measures).withColumns({n: F.hll_sketch_estimate(n) for n, m in measures.items() if m.kind == "sketch"})
    names = [n for n, m in measures.items() if m.kind == "set"]
    if names and sets is not None:
        flat_sets = sets if keys else sets.withColumn("__all", F.lit(1))
        distinct = flat_sets.select(*keys_, "measure", "member").distinct()
        sizes = distinct.groupBy(*keys_).agg(*(F.count_if(F.col("measure") == n).alias(n) for n in names))
        mine = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys_), *names)
        same = None
        for k in keys_:
            here = F.col(k).eqNullSafe(F.col(f"__{k}"))
            same = here if same is None else same & here
        out = out.join(mine, same, "left").drop(*(f"__{k}" for k in keys_)).fillna(0, names)
    return out.drop("__all")


class Kept:
    """Partial tables below ``path``, kept up to date by what is added.

    Groups are by ``keys``; ``part`` is the key by which the tables are laid out,
    such as a month. Adding rows reads and writes anew only the parts that they
    touch, not the rows added before, and not the other parts.
    """

    def __init__(self, spark, path: str, keys: list[str], part: str, measures: dict[str, Measure]):
        self.table, self.keys, self.part, self.measures = Committed(spark, path), keys, part, measures

    def add(self, rows: DataFrame, tag: tuple[str, int] | None = None) -> bool:
        """Merge rows into what is kept; those of a tag count once."""
        fresh, sets = numbers(rows, self.keys, self.measures), members(rows, self.keys, self.measures)

        def step(base: Version) -> list[dict] | None:
            staged = self.table.stage(fresh, "fresh", self.part)
            parts = [f["part"] for f in staged]
            if not parts:
                return None
            new = self.table.read("fresh", Version(0, staged))
            had = self.table.read("numbers", base, parts)
            both = merged(had.unionByName(new) if had is not None else new, self.keys, self.measures)
            folders = base.without("numbers", parts) + self.table.stage(both, "numbers", self.part)
            if any(m.kind == "set" for m in self.measures.values()):
                held = self.table.read("members", base, parts)
                every = held.unionByName(sets).distinct() if held is not None else sets
                folders = [f for f in folders if f["name"] != "members" or f["part"] not in parts] + self.table.stage(every, "members", self.part)
            self.table._delete({f["folder"].rpartition("/")[0] for f in staged})
            return folders

        return self.table.change(step, tag)

    def result(self, keys: list[str] | None = None) -> DataFrame | None:
        """The roll-up by the groups, or by some of their keys, from partial rows only."""
        parts = self.table.read("numbers")
        keys = self.keys if keys is None else keys
        return None if parts is None else finished(parts, self.table.read("members"), keys, self.measures)
