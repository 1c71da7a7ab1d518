"""Hard negatives by exact integer inner products, several candidates to one wide integer.

Components become integers, floor(scale * x). For a chunk of candidates they are
biased to be at least 0 and those of several candidates are put into separated
fields of one wide integer (Kronecker packing). Multiplying that integer by an
anchor's component multiplies all fields at once, and the sum over components
holds one candidate's product in each field as long as no field can run over,
which the widths are chosen for. So scores are exact, not rounded, and ties are
ties. The wide integers are of 53 bits and held in doubles, whose matrix product
is what hardware does fastest; where components are too large for two fields of
53 bits, Python's integers take all candidates of a chunk at once instead.

Anchors are a stated set that goes to all rows in blocks of bounded size. A
block takes two scans of all rows: the first scores rows of an anchor's own label
and keeps each task's best, which gives the block's positives; the second
scores rows of other labels against the windows that the positives set. Tasks
give out some rows for each anchor, whatever they read, so neither a label with
most rows nor a vector that very many rows share makes one task larger.

Cases: rows with a null label, vector or component, or a component that is not
finite, take no part, and neither do rows of null id, for results name rows by
id. Rows of the anchor's id are not other rows; otherwise repeated rows are
rows like others, and a repeated anchor is answered for each of its rows.
Vectors of different lengths are compared over the components that both have.
Scores beyond the range of a long are held at its ends. Equal scores go by id.
Other columns are ignored, whatever they are called. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallymark.llm.store import Scratch, arrow_batch

#: Components become floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LOW to HIGH percent of the positive's.
LOW, HIGH = 50, 95
#: An anchor block has so many components at most; anchors and candidates scored at once.
BLOCK, ANCHORS, CANDIDATES = 1 << 19, 256, 4096
#: Bits of integers that doubles hold exactly; components up to this size share fields.
WIDE, USUAL = 53, 1 << 16
#: No score: no long of a result is as small.
NONE = np.iinfo(np.int64).min + 1
LONG = (1 << 63) - 2

FOUND = "anchor long, id long, score long"
MINED = "anchor long, anchor_id long, slot int, positive_id long, positive_score long, negative_id long, negative_score long"


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as doubles, or as Python integers where doubles do not hold them exactly."""
    x = np.asarray(x, dtype=np.float64)
    if not x.size or np.abs(x).max() * scale < 2.0**WIDE:
        return np.floor(x * scale)
    return np.array([[math.floor(v * scale) if abs(v) < 1e300 else int(v) * scale for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner product of each anchor with each row, exact; whole numbers in both."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), dtype=np.int64)
    sizes = np.abs(rows).max(axis=1)
    large = sizes > USUAL
    if large.any() and not large.all():
        out = np.empty((len(anchors), len(rows)), dtype=np.int64)
        out[:, ~large] = products(anchors, rows[~large])
        out[:, large] = products(anchors, rows[large])
        return out
    least_a, least_c = int(anchors.min()), int(rows.min())
    most_a, most_c = int(anchors.max()), int(rows.max())
    field = (anchors.shape[1] * max(most_a - least_a, 1) * (most_c - least_c)).bit_length() or 1
    plain = (anchors.shape[1] * max(most_a, -least_a) * max(most_c, -least_c)).bit_length()
    if max(field, plain + 1) > WIDE:
        return wide_products(anchors, rows, least_a, least_c, field)
    anchors, rows = anchors.astype(np.float64), rows.astype(np.float64)
    fields = min(WIDE // field, len(rows))
    groups = -(-len(rows) // fields)
    biased = np.zeros((fields * groups, rows.shape[1]))
    biased[: len(rows)] = rows - least_c
    packed = sum(biased[j * groups : (j + 1) * groups] * 2.0 ** (field * j) for j in range(fields))
    held = ((anchors - least_a) @ packed.T).astype(np.int64)
    out = np.concatenate([(held >> (field * j)) & ((1 << field) - 1) for j in range(fields)], axis=1)[:, : len(rows)]
    # (a - A)(c - C) sums to ac - A sum(c) - C sum(a) + dAC.
    return out + (least_a * rows.sum(axis=1)[None, :] + least_c * anchors.sum(axis=1)[:, None]).astype(np.int64) - anchors.shape[1] * least_a * least_c


def wide_products(anchors: np.ndarray, rows: np.ndarray, least_a: int, least_c: int, field: int) -> np.ndarray:
    """:func:`products` by one integer for all rows, as wide as that takes."""
    step = -(-field // 8)
    mine, theirs = ([list(map(int, r)) for r in x] for x in (anchors, rows))
    packed = [int.from_bytes(b"".join((r[k] - least_c).to_bytes(step, "little") for r in theirs), "little") for k in range(rows.shape[1])]
    sums = [sum(r) for r in theirs]
    out = np.empty((len(mine), len(theirs)), dtype=np.int64)
    for i, a in enumerate(mine):
        held = sum(p * (x - least_a) for p, x in zip(packed, a)).to_bytes(step * len(theirs), "little")
        rest = least_c * sum(a) - len(a) * least_a * least_c
        out[i] = [max(-LONG, min(LONG, int.from_bytes(held[j * step : (j + 1) * step], "little") + least_a * s + rest)) for j, s in enumerate(sums)]
    return out


class Best:
    """The k highest scores seen for each place, with their ids; equal scores by id."""

    def __init__(self, places: int, k: int):
        self.scores = np.full((places, k), NONE, dtype=np.int64)
        self.ids = np.zeros((places, k), dtype=np.int64)

    def see(self, places: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take scores (a row a place; :data:`NONE`: no candidate) of ids that ascend. Changes ``scores``."""
        k = self.scores.shape[1]
        if not scores.shape[1]:
            return
        first = scores.argmax(axis=1)
        top = scores[np.arange(len(places)), first]
        better = np.flatnonzero((top > NONE) & (top >= self.scores[places, -1]))
        if not better.size:
            return
        places, scores, at = places[better], scores[better], np.arange(better.size)
        found = np.empty((2, better.size, k), dtype=np.int64)
        for j in range(k):
            here = scores.argmax(axis=1)
            found[0, :, j], found[1, :, j] = scores[at, here], ids[here]
            scores[at, here] = NONE
        both, names = np.concatenate([self.scores[places], found[0]], axis=1), np.concatenate([self.ids[places], found[1]], axis=1)
        order = np.lexsort((names, -both), axis=1)[:, :k]
        self.scores[places], self.ids[places] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    def seen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, id and score of everything kept."""
        place, j = np.nonzero(self.scores > NONE)
        return place, self.ids[place, j], self.scores[place, j]


class Block:
    """Anchors that meet all rows together."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, scale: int):
        self.ids, self.labels, self.vectors, self.scale = ids, labels, whole(vectors, scale), scale

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids (ascending), labels and whole components of rows, some thousand at a time."""
        for batch in batches:
            for start in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(start, CANDIDATES)
                ids, labels = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                yield ids[order], labels[order], whole(matrix(part.column(2), self.vectors.shape[1]), self.scale)[order]

    def positives(self, batches: Iterator[pa.RecordBatch], k: int) -> Best:
        """The best other rows of each anchor's label."""
        best = Best(len(self.ids), k)
        for ids, labels, rows in self.chunks(batches):
            for label in np.intersect1d(self.labels, labels):
                theirs = np.flatnonzero(labels == label)
                mine = np.flatnonzero(self.labels == label)
                for m in np.array_split(mine, -(-mine.size // ANCHORS)):
                    scores = products(self.vectors[m], rows[theirs])
                    scores[self.ids[m][:, None] == ids[theirs][None, :]] = NONE
                    best.see(m, scores, ids[theirs])
        return best

    def negatives(self, batches: Iterator[pa.RecordBatch], k: int, least: np.ndarray, most: np.ndarray) -> Best:
        """For each anchor and positive the best rows of other labels with scores from ``least`` to ``most``.

        Both have a row an anchor and a column a positive; places are counted
        through them, row by row.
        """
        slots = least.shape[1]
        best = Best(least.size, k)
        asked = np.flatnonzero((least <= most).any(axis=1))
        for ids, labels, rows in self.chunks(batches):
            for m in np.array_split(asked, -(-asked.size // ANCHORS) or 1):
                scores = products(self.vectors[m], rows)
                scores[(self.labels[m][:, None] == labels[None, :]) | (self.ids[m][:, None] == ids[None, :])] = NONE
                for slot in range(slots):
                    inside = (scores >= least[m, slot][:, None]) & (scores <= most[m, slot][:, None])
                    best.see(m * slots + slot, np.where(inside, scores, NONE), ids)
        return best


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of ``width`` components: cut, or filled with 0."""
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[place < width], place[place < width]] = flat[place < width]
    return out


def usable(rows: DataFrame, ident: str, label: Column, vector: str) -> DataFrame:
    """id, label and vector of the rows that take part."""
    out = rows.select(F.col(ident).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)


def ranked(found: DataFrame, by: list[str], score: str, ident: str, k: int) -> DataFrame:
    """The k rows of highest score of each group, with ``rank``; Spark limits each task's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), ident))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that a negative scores; an empty window where there is no positive."""
    least = [[-(-low * s // 100) for s in row] for row in scores.tolist()]
    most = [[high * s // 100 for s in row] for row in scores.tolist()]
    none = scores == NONE
    return np.where(none, 1, np.array(least, dtype=np.int64).reshape(scores.shape)), np.where(none, 0, np.array(most, dtype=np.int64).reshape(scores.shape))


def mine(rows: DataFrame, is_anchor: Column, label: Column, ident: str = "vec_id", vector: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best ``positives`` other rows of the same
    label. For each of them the best ``negatives`` rows of other labels are
    given whose score is from ``low`` to ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    taking = usable(rows, ident, label, vector)
    asked = usable(rows.where(is_anchor), ident, label, vector)
    n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-n * width // BLOCK))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)))
    dealt.repartition("block").write.partitionBy("block").parquet(f"{scratch.path}/anchors")
    anchors = spark.read.schema(dealt.schema).parquet(f"{scratch.path}/anchors")
    found_schema, mined_schema = (to_arrow_schema(StructType.fromDDL(x)) for x in (FOUND, MINED))
    for number in range(blocks):
        mine_now = anchors.where(F.col("block") == number).select("id", "label", "vector").toArrow().combine_chunks()
        ids, labels = (mine_now.column(c).to_numpy() for c in (0, 1))
        lists = mine_now.column(2).chunk(0) if len(ids) else pa.array([], pa.list_(pa.float64()))
        block = spark.sparkContext.broadcast(Block(ids, labels, matrix(lists, width), scale))

        def first(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            yield arrow_batch(found_schema, *block.value.positives(batches, positives).seen())

        best = ranked(taking.mapInArrow(first, FOUND), ["anchor"], "score", "id", positives).toArrow()
        at, rank = best.column("anchor").to_numpy(), best.column("rank").to_numpy() - 1
        names, scores = np.zeros((len(ids), positives), dtype=np.int64), np.full((len(ids), positives), NONE, dtype=np.int64)
        names[at, rank], scores[at, rank] = best.column("id").to_numpy(), best.column("score").to_numpy()
        sent = spark.sparkContext.broadcast((names, scores, *windows(scores, low, high)))

        def second(batches: Iterator[pa.RecordBatch], block=block, sent=sent) -> Iterator[pa.RecordBatch]:
            names, scores, least, most = sent.value
            place, found, score = block.value.negatives(batches, negatives, least, most).seen()
            anchor, slot = np.divmod(place, positives)
            yield arrow_batch(mined_schema, anchor, block.value.ids[anchor], slot.astype(np.int32), names[anchor, slot], scores[anchor, slot], found, score)

        out = ranked(taking.mapInArrow(second, MINED), ["anchor", "slot"], "negative_score", "negative_id", negatives)
        out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(f"{scratch.path}/mined")
        block.destroy()
        sent.destroy()
    scratch.drop("anchors")
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(f"{scratch.path}/mined")
