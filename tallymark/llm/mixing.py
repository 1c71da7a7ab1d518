"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a pseudo-random order, are dealt into blocks of
equal size. With weight w the source's block i has release time floor(i / w)
and deadline ceil((i + 1) / w) in slots; in every slot the released block of
earliest deadline runs. So after any number of slots t a source has run less
than one block more or less than w * t. Weights are exact fractions: nothing is
rounded and nothing adds up, however long the run and however many the sources.

The time line is cut into spans of ``span`` slots, one task walking one span.
When a span begins at time T, every source has run floor(w * T) blocks or one
more, its open block, which was released before T and may wait until after it.
Which open blocks have run by then, the schedule from the beginning decides;
:func:`begun` finds it without walking there. A released block that waits at T
and has waited since before s is one of those that waited at s, and how many
those are follows from the weights alone (released by s, less s slots). So of
the open blocks those of earliest deadline have run, as far as for every s
before T the ones left over fit into the number that waited at s. The last
times at which few blocks waited are all that a span must know of the spans
before it: a number for each source, found span by span in a first pass and
handed on as running maxima. Spans join to exactly the schedule of one walk.

Documents meet their slots by an equi-join on (source, rank). The run lasts
until every source has shown all its documents; a source that is through
earlier starts over (``epoch`` counts from 0), so no document is left out and
the weights hold to the end. A rank inside a source is the rank inside one of
many hash ranges plus the sizes of the ranges before, summed in two steps, so
no task holds a source. The driver and each task hold one entry a source.

Cases: a null source is a source of its own. Rows of null id and repeated rows
are documents like others. Text is not read. Sources not named in ``weights``
are an error. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallymark.llm.store import arrow_batch, materialise

BLOCK = 8
#: Slots that one task walks at a time.
SPAN = 1 << 16
#: Target weights default to each source's number of documents to this power.
SMOOTHING = 0.7
#: Documents in a hash range are about so many.
RANGE = 2_000
DEALT = "at long, block long, slot long"
LOWS = "span long, waiting long, last long"
#: Slots sent on at once.
TOGETHER = 1 << 15
#: Tasks that walk spans, at most; each takes one span after the other.
TASKS = 4096


def whole(weights: list) -> list[int]:
    """Integers in exactly the proportion of the weights."""
    if any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact))
    return [int(w * scale) for w in exact]


def dealt(weights: list, blocks: list[int], done: list[int] | None = None, slot: int = 0, until: float = math.inf) -> Iterator[tuple[int, int]]:
    """Source and its block of each slot, earliest deadline first, until every source has run its ``blocks``.

    The walk begins at ``slot``, by when sources have run ``done`` blocks, and ends before ``until`` at the latest.
    """
    weights = whole(weights)
    total = sum(weights)
    done = list(done) if done else [0] * len(weights)
    left = sum(d < n for d, n in zip(done, blocks))
    waiting = [(d * total // w, k) for k, (d, w) in enumerate(zip(done, weights))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    while left and slot < until:
        while waiting and waiting[0][0] <= slot:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[k] + 1) * total // weights[k]), k))
        k = heapq.heappop(ready)[1]
        yield k, done[k]
        done[k] += 1
        left -= done[k] == blocks[k]
        heapq.heappush(waiting, (done[k] * total // weights[k], k))
        slot += 1


def lows(weights: list[int], first: int, last: int) -> list[int]:
    """For each v below the number of sources the last time from ``first`` to ``last`` at which at most v released blocks waited; -1 if none."""
    total = sum(weights)
    released = np.zeros(last - first, dtype=np.int64)
    waits = -first
    for w in weights:
        block = -(-w * first // total)
        waits += block
        while (slot := block * total // w) < last:
            released[slot - first] += 1
            block += 1
    at = np.full(len(weights), -1, dtype=np.int64)
    np.maximum.at(at, waits + np.concatenate([[0], np.cumsum(released - 1)]), np.arange(first, last + 1))
    return np.maximum.accumulate(at).tolist()


def begun(weights: list[int], slot: int, low: list[int]) -> list[int]:
    """Blocks that each source has run when ``slot`` begins; ``low`` are the :func:`lows` of all time before."""
    total = sum(weights)
    done = [w * slot // total for w in weights]
    room = slot - sum(done)
    unsure = sorted(((b * total // w, -(-(b + 1) * total // w), k) for k, (b, w) in enumerate(zip(done, weights)) if w * slot % total), reverse=True)
    run: list[tuple[int, int]] = []
    for n, (release, deadline, k) in enumerate(unsure, 1):
        heapq.heappush(run, (-deadline, -k))
        before = unsure[n][0] if n < len(unsure) else -1
        if before < release:
            # Those released from before + 1 on: no more than slots are left by what had to run in them.
            while len(run) > room + bisect_left(low, before + 1) - (len(unsure) - n):
                heapq.heappop(run)
    for _, k in run:
        done[-k] += 1
    return done


def ranked(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, source and rank in the source by hash of the id, from 0."""
    rows = docs.select("doc_id", "source", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    rows = rows.withColumn("part", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int"))
    # Sizes before a range: of the groups of ranges before its own, and of the ranges before it in its group.
    wide = math.isqrt(ranges) + 1
    so_far = lambda n, *by: F.coalesce(F.sum(n).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("many", F.floor(F.col("part") / wide))
    groups = sizes.groupBy(F.col("source").alias("gs"), F.col("many").alias("g")).agg(F.sum("n").alias("gn")).withColumn("base", so_far("gn", "gs", "g"))
    sizes = sizes.withColumn("inner", so_far("n", "source", "many", "part")).join(groups, F.col("source").eqNullSafe(F.col("gs")) & (F.col("many") == F.col("g")))
    sizes = sizes.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.col("base") + F.col("inner")).alias("offset"))
    inside = rows.withColumn("nth", F.row_number().over(Window.partitionBy("source", "part").orderBy("h", "doc_id")) - 1)
    met = inside.join(sizes, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return met.select("doc_id", "source", (F.col("offset") + F.col("nth")).cast("long").alias("rank"))


def shown(docs: DataFrame, sizes: dict, names: list, slots: DataFrame, block: int) -> DataFrame:
    """The documents that the blocks of ``slots`` (at, block, slot) show; ``at`` is a source's place in ``names``.

    Each place of a block asks for one rank of its source, so a document that is
    shown very often is as many rows, not a long one, and Spark's skew rule can
    split their join.
    """
    sources = docs.sparkSession.createDataFrame([(s, k, sizes[s]) for k, s in enumerate(names)], f"s {docs.schema['source'].dataType.simpleString()}, at long, size long")
    nth = F.col("block") * block + F.col("place")
    places = slots.join(sources.select("at", "size"), "at").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(block - 1).cast("long"))))
    places = places.select("at", "block", "slot", "place", (nth % F.col("size")).alias("rank"), F.floor(nth / F.col("size")).alias("epoch"))
    order = ranked(docs, max(1, -(-sum(sizes.values()) // RANGE)))
    order = order.join(sources.select("s", "at"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "at", "rank")
    return places.join(order, ["at", "rank"]).select("slot", "place", "doc_id", "source", "block", "epoch")


def schedule(spark: SparkSession, weights: list[int], blocks: list[int], span: int = SPAN) -> DataFrame:
    """at (the source's place in the lists), block and slot of every slot until each source has run its ``blocks``."""
    total = sum(weights)
    slots = max((-(-n * total // w) for n, w in zip(blocks, weights)), default=0)
    spans = -(-slots // span)
    tasks = max(1, min(spans, TASKS))
    low_schema, dealt_schema = (to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (LOWS, DEALT))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                low = lows(weights, n * span, min(slots, (n + 1) * span))
                yield arrow_batch(low_schema, [n] * len(low), list(range(len(low))), low)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, low in zip(*(batch.column(c).to_pylist() for c in ("span", "low"))):
                at = n * span
                run = dealt(weights, blocks, begun(weights, at, [v["last"] for v in low]) if n else None, at, at + span)
                while held := list(islice(run, TOGETHER)):
                    yield arrow_batch(dealt_schema, [k for k, _ in held], [b for _, b in held], list(range(at, at + len(held))))
                    at += len(held)

    found = materialise(spark.range(0, spans, 1, tasks).mapInArrow(first_pass, LOWS), "waiting")
    before = F.max("last").over(Window.partitionBy("waiting").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    known = found.select("span", F.struct("waiting", before.alias("last")).alias("low")).groupBy("span").agg(F.sort_array(F.collect_list("low")).alias("low"))
    # As many tasks as asked for: by their few bytes they would be put together.
    return known.repartition(tasks, "span").mapInArrow(walk, DEALT)


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """A row per scheduled document: slot, place (in the slot's block), doc_id, source, block, epoch.

    Ordered by (slot, place) it is the mixed stream. ``weights`` maps a source to
    its target weight; by default they are sizes to the power ``SMOOTHING``.
    """
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if weights is not None and (unknown := [s for s in sizes if s not in weights]):
        raise ValueError(f"no weight for {unknown[:5]}")
    names = sorted(sizes, key=lambda k: (k is not None, k))
    exact = whole([weights[s] if weights is not None else sizes[s] ** SMOOTHING for s in names])
    slots = schedule(docs.sparkSession, exact, [-(-sizes[s] // block) for s in names], span)
    return shown(docs, sizes, names, slots, block)
