"""Approximate vector search: cells of like vectors, of which a query reads the nearest.

Centres are fitted by k-means on a bounded sample of unit vectors; every vector
is then given the cell of its nearest centre, so the index holds all rows. A
query ranks the centres exactly, reads the vectors of the nearest cells, and ranks
these exactly. What it misses lies in cells it did not read; more ``probes``, less
missed. Vectors are laid out by cell; the queries' probes, a stated set, go to
them, so neither a cell with most vectors nor a query makes one task larger.
Null vectors are not indexed. An empty table gives an empty index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tallymark.operators.search import DEALT, ROWS, matrix, one, rounded, scanned, unit
from tallymark.session import kept

#: Centres are fitted on about so many vectors at most; more centres than that make none of use.
SAMPLE, MOST_CELLS = 100_000, 4096
SEED = 7


@dataclass(frozen=True)
class Cells:
    vectors: DataFrame
    centres: DataFrame
    n_cells: int


def build(rows: DataFrame, ident: str, vector: str, n_cells: int | None = None) -> Cells:
    """The index of all vectors, kept in the shared folder; by default about as many cells as the root of their number."""
    spark = rows.sparkSession
    units = kept(rows.where(F.col(vector).isNotNull()).select(F.col(ident).alias("id"), unit(F.col(vector)).alias("v")), "units")
    n = units.count()
    n_cells = max(1, min(n_cells or math.isqrt(n), MOST_CELLS, n))
    if n < 2 or n_cells < 2:
        centre = units.limit(1).select(F.lit(0).alias("cell"), F.col("v").alias("centre"))
        return Cells(units.withColumn("cell", F.lit(0)), centre, 1)
    taken = units.sample(fraction=min(1.0, SAMPLE / n), seed=SEED) if n > SAMPLE else units
    fitted = KMeans(k=n_cells, seed=SEED, maxIter=10, featuresCol="f", predictionCol="cell").fit(taken.select(array_to_vector("v").alias("f")))
    centres = kept(spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fitted.clusterCenters())], "cell int, centre array<double>"), "centres")
    dealt = fitted.transform(units.withColumn("f", array_to_vector("v"))).select("id", "v", F.col("cell").cast("int").alias("cell"))
    # Ranges of cell and id: a cell lies together, and one with most vectors in several ranges. Bounds are drawn from what is kept.
    ranges = kept(dealt, "dealt").repartitionByRange(DEALT * spark.sparkContext.defaultParallelism, "cell", "id")
    return Cells(kept(ranges.sortWithinPartitions("cell"), "cells"), centres, len(fitted.clusterCenters()))


def _asked(index: Cells, queries: DataFrame, n_probes: int) -> DataFrame:
    """Queries at length 1 with their nearest cells, ties by cell: query_id, query, cells.

    All centres go to each task of the queries; there are ``MOST_CELLS`` at most.
    """
    asked = queries.select("query_id", unit(F.col("query")).alias("query"))
    schema = StructType([*asked.schema.fields, StructField("cells", ArrayType(IntegerType()))])
    sent = index.vectors.sparkSession.sparkContext.broadcast(index.centres.select("cell", unit(F.col("centre")).alias("v")).orderBy("cell").toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, column = sent.value["cell"].to_numpy().astype(np.int32), one(sent.value["v"])
        size = len(column[0]) if len(column) else 0
        centres, _ = matrix(column, size)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                mine, good = matrix(part.column("query"), size)
                with np.errstate(invalid="ignore", over="ignore"):
                    scores = np.zeros((len(mine), len(centres)))
                    for i in range(size):
                        scores += mine[:, i, None] * centres[None, :, i]
                    scores = rounded(scores.ravel()).reshape(scores.shape)
                scores[np.isnan(scores)] = np.inf
                scores[~good] = -np.inf
                near = names[np.argsort(-scores, axis=1, kind="stable")[:, :n_probes]]
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, cells], names=schema.names)

    return asked.mapInArrow(run, schema)


def probes(index: Cells, queries: DataFrame, n_probes: int) -> DataFrame:
    """The nearest cells of each query: query_id, cell."""
    return _asked(index, queries, n_probes).select("query_id", F.explode("cells").alias("cell"))


def topk(index: Cells, queries: DataFrame, k: int, n_probes: int) -> DataFrame:
    """The k vectors found most like each query (query_id, query): query_id, rank, id, score; ties by id.

    A cell's vectors meet the queries that probe it where they lie, block of queries by block.
    """
    return scanned(index.vectors, _asked(index, queries, n_probes), k, queries.count())


def share_read(index: Cells, queries: DataFrame, n_probes: int) -> DataFrame:
    """How much of the index each query reads: query_id, share."""
    sizes = index.vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    return probes(index, queries, n_probes).join(sizes, "cell", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).crossJoin(F.broadcast(total)).select("query_id", (F.col("n") / F.col("total")).alias("share"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Of each query's exact answers the share that was found: query_id, recall."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
