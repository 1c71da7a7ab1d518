"""Vector search, exact: cosine top-k and a second ranking."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length; 1 for the zero vector."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


#: Query vectors go to every task together up to so many; more go in blocks of vectors, one block a task at a time.
TOGETHER = 4096
#: For more queries than this, vectors are dealt evenly over so many tasks a core.
FEW, DEALT = 64, 2
#: Rows scored at once; scores taken in exact order at once.
ROWS, HITS = 1024, 1 << 18
#: By so much may a score be below another one and not be below it when both are rounded.
SLACK = 2e-6


def unit(a: Column) -> Column:
    """The vector in double precision at length 1; the zero vector as it is."""
    # The length is bound as an element of an array: written into the inner function it would be taken anew for every component.
    return F.get(F.transform(F.array(norm(a)), lambda size: F.transform(a, lambda x: x.cast("double") / size)), 0)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors most like each query vector: (query_id, rank, id, score); ties by id.

    ``queries`` has query_id and query. They are counted first: a stated set of
    up to ``TOGETHER`` goes to the vectors, which are read once for it, and each
    task keeps the k best of each query before they meet. A larger set is dealt
    into blocks of that size, and each block meets all vectors in the same way.
    Lengths are taken once a vector, not once a pair.
    """
    asked = queries.count()
    rows = vectors.select(F.col(ident).alias("id"), F.col(vector).alias("v"))
    if asked > FEW:
        # The work is vectors times queries, so vectors are dealt evenly, however few files hold them.
        rows = rows.repartition(DEALT * vectors.sparkSession.sparkContext.defaultParallelism)
    return scanned(rows.select("id", unit(F.col("v")).alias("v")), queries.select("query_id", unit(F.col("query")).alias("query")), k, asked)


def scanned(rows: DataFrame, asked: DataFrame, k: int, n_asked: int) -> DataFrame:
    """The k best rows (id, v) for each query (query_id, query), all at length 1: query_id, rank, id, score.

    Rows that also have a ``cell`` meet only queries whose ``cells`` hold it.
    """
    blocks = 1 + n_asked // TOGETHER
    context = rows.sparkSession.sparkContext
    schema = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("id", rows.schema["id"].dataType), StructField("score", DoubleType())])
    parts = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        sent = context.broadcast(mine.toArrow().combine_chunks())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = Best(sent.value, k)
            for batch in batches:
                best.see(batch)
            yield from best.seen(to_arrow_schema(schema))

        parts.append(best_k(rows.mapInArrow(run, schema), k))
    return reduce(DataFrame.unionByName, parts)


def matrix(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``size`` as rows, and which rows are such: others, or those with a null in them, are rows of zeros."""
    values, ends = column.values, np.asarray(column.offsets)
    held = np.asarray(column.is_valid()) & (np.diff(ends) == size)
    whole = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))])
    held &= whole[ends[1:]] == whole[ends[:-1]]
    out = np.zeros((len(column), size))
    if held.any():
        out[held] = values.to_numpy(zero_copy_only=False)[ends[:-1][held, None] + np.arange(size)[None, :]]
    return out, held


def rounded(scores: np.ndarray) -> np.ndarray:
    """Doubles at six decimals as Spark's ``round`` has them, which rounds what a double is written as, halves up."""
    scaled = scores * 1e6
    with np.errstate(invalid="ignore"):
        out = np.where(np.isfinite(scores), np.floor(scaled + 0.5) / 1e6, scores) + 0.0
        near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)
    for i in near:
        out[i] = float(Decimal(repr(float(scores[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) + 0.0
    return out


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``x`` with those of ``y``, summed in the order of the components, as :func:`product` does."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * y[:, i]
    return out


class Best:
    """The k rows of highest score of each query, of those seen.

    Scores are taken by matrix product; those that may be among the k best, by
    the slack that rounding leaves, are taken again in exact order and rounded.
    A score is null where a vector is, or where lengths differ, and NaN is above
    all numbers, as Spark orders them; here they are infinities.
    """

    def __init__(self, asked: pa.Table, k: int):
        self.k, self.names = k, asked["query_id"]
        vectors = one(asked["query"])
        lengths = np.where(np.asarray(vectors.is_valid()), np.diff(np.asarray(vectors.offsets)), 0)
        self.groups = []
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            self.groups.append((at, *matrix(vectors.take(pa.array(at)), int(size))))
        self.least = np.full(len(asked), -np.inf)
        self.full = np.zeros(len(asked), dtype=bool)
        self.kept: pa.Table | None = None
        self.waiting: list[pa.Table] = []
        self.n_waiting = 0
        if "cells" in asked.column_names:
            cells = one(asked["cells"])
            of = np.repeat(np.arange(len(cells)), np.diff(np.asarray(cells.offsets)))
            held = np.asarray(cells.flatten())
            self.probed = np.zeros((len(cells), int(held.max(initial=-1)) + 1), dtype=bool)
            self.probed[of, held] = True

    def see(self, batch: pa.RecordBatch) -> None:
        """Take rows: id, v, and cell, if cells are probed."""
        ids, column = batch.column("id"), batch.column("v")
        if "cell" in batch.schema.names:
            cells = np.asarray(batch.column("cell"))
            bounds = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        else:
            cells, bounds = None, [0, len(ids)]
        for at, mine, good in self.groups:
            rows, held = matrix(column, mine.shape[1])
            for begin, end in zip(bounds, bounds[1:]):
                take = slice(None)
                if cells is not None and begin < end:
                    take = self.probed[at, cells[begin]] if cells[begin] < self.probed.shape[1] else np.zeros(len(at), dtype=bool)
                for low in range(begin, end, ROWS):
                    high = min(low + ROWS, end)
                    self._score(ids.slice(low, high - low), rows[low:high], held[low:high], at[take], mine[take], good[take])

    def _score(self, ids: pa.Array, rows: np.ndarray, held: np.ndarray, at: np.ndarray, mine: np.ndarray, good: np.ndarray) -> None:
        if not len(at):
            return
        with np.errstate(invalid="ignore", over="ignore"):
            scores = mine @ rows.T
            scores[np.isnan(scores)] = np.inf
            scores[~good] = -np.inf
            scores[:, ~held] = -np.inf
            least = self.least[at].copy()
            if len(ids) > self.k and not self.full[at].all():
                least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            which, row = np.nonzero(scores >= (least - SLACK)[:, None])
            for low in range(0, len(which), HITS):
                q, r = which[low : low + HITS], row[low : low + HITS]
                found = rounded(exact(mine[q], rows[r]))
                found = np.where(good[q] & held[r], np.where(np.isnan(found), np.inf, found), -np.inf)
                self.waiting.append(pa.table({"q": at[q], "id": ids.take(pa.array(r)), "score": found}))
                self.n_waiting += len(q)
                if self.n_waiting > max(self.k * len(self.least), HITS) or not self.full[at].all():
                    self._prune()

    def _prune(self) -> None:
        every = pa.concat_tables([*([self.kept] if self.kept is not None else []), *self.waiting])
        order = pc.sort_indices(every, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start")
        every = every.take(order)
        q = every["q"].to_numpy()
        first = np.searchsorted(q, q, side="left")
        nth = np.arange(len(q)) - first
        last = nth == self.k - 1
        self.least[q[last]] = every["score"].to_numpy()[last]
        self.full[q[last]] = True
        self.kept, self.waiting, self.n_waiting = every.filter(pa.array(nth < self.k)), [], 0

    def seen(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """query_id, id and score of everything kept."""
        if self.waiting:
            self._prune()
        if self.kept is None:
            return
        score = self.kept["score"].to_numpy()
        score = pa.array(np.where(score == np.inf, np.nan, score), mask=score == -np.inf, from_pandas=False)
        yield from pa.table([self.names.take(self.kept["q"]), self.kept["id"], score], names=schema.names).cast(schema).to_batches(max_chunksize=HITS)


def one(column: pa.ChunkedArray) -> pa.Array:
    """A column in one piece."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def product(a: Column, b: Column) -> Column:
    """Inner product of vectors in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def best_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, then id; Spark limits each partition's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def rerank(found: DataFrame, score: Column, k: int) -> DataFrame:
    """The first k of each query by a second score; ties by id."""
    return best_k(found.select("query_id", "id", score.alias("score")), k)


def documents(turns: DataFrame, keys: list[str], order: str, role: str, text: str, tools: Column | None = None, most: int = 1024, most_tools: int = 20) -> DataFrame:
    """What is indexed of a session: its first human turn, cut to ``most`` characters, and its tools."""
    first = F.min_by(F.when(F.col(role) == "user", F.col(text)), F.when((F.col(role) == "user") & F.col(text).isNotNull(), F.col(order)))
    out = turns.groupBy(*keys).agg(F.substring(first, 1, most).alias("snippet"), F.count(F.lit(1)).alias("turns"), *([F.slice(F.sort_array(F.collect_set(tools)), 1, most_tools).alias("tools")] if tools is not None else []))
    return out
