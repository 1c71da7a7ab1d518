"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every three bytes in a row of the UTF-8 text are hashed to one of 128 buckets.
The quartiles of the 128 counts turn each bucket into two bits, and the length
on a logarithmic scale into one byte: 66 hexadecimal digits. Two digests
differ by the sum of their buckets' steps plus their difference in length,
which is bounded; likeness is one less its share of the bound.

Cases: a null text is empty; an empty text's digest is all zeros. Equal texts
have equal digests. Texts of any length are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallymark.llm.store import arrow_batch

BUCKETS = 128
PIECE = 1 << 20
#: Steps that a length difference counts at most, and steps a doubling counts.
LENGTH_MOST, PER_DOUBLING = 64, 8
#: Ranges of ids hold about so many characters of text at most.
CHARS = 64_000_000
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def counts(data: bytes) -> np.ndarray:
    """How many byte triplets fall into each bucket."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(0, len(data) - 2), PIECE):
        b = np.frombuffer(data, dtype=np.uint8, count=min(PIECE + 2, len(data) - at), offset=at).astype(np.uint32)
        code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
        total += np.bincount(code >> np.uint32(25), minlength=BUCKETS)
    return total


def fingerprint(text: str | None) -> str:
    """The digest as 66 hexadecimal digits: length byte, then two bits a bucket."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return "0" * 66
    found = counts(data)
    ranked = np.sort(found)
    quartiles = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    level = (found[:, None] > quartiles[None, :]).sum(1).astype(np.uint8).reshape(-1, 4)
    packed = level[:, 0] << 6 | level[:, 1] << 4 | level[:, 2] << 2 | level[:, 3]
    length = min(255, round(PER_DOUBLING * np.log2(1 + len(data))))
    return f"{length:02x}{packed.tobytes().hex()}"


@cache
def _steps() -> np.ndarray:
    """Sum of the steps between the four levels of two bytes."""
    levels = np.stack([np.arange(256) >> s & 3 for s in (6, 4, 2, 0)])
    return np.abs(levels[:, :, None] - levels[:, None, :]).sum(0)


def difference(a: str, b: str) -> int:
    """From 0 to 448: bucket steps, at most 3 each, and length steps, at most 64."""
    x, y = (np.frombuffer(bytes.fromhex(v), dtype=np.uint8) for v in (a, b))
    return int(_steps()[x[1:], y[1:]].sum()) + min(LENGTH_MOST, abs(int(x[0]) - int(y[0])))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for the furthest."""
    return 1 - difference(a, b) / (3 * BUCKETS + LENGTH_MOST)


def ranges_of(docs: DataFrame) -> tuple[DataFrame, list[tuple[int, int | None]]]:
    """Rows with the ``part`` of their id's range, and each part's least id in order.

    The ranges' bounds are quantiles of the ids; both number as many as partitions do.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("place"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    wanted = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // CHARS + 1)
    bounds = rows.where("doc_id is not null").approxQuantile("place", [k / wanted for k in range(1, wanted)], 0.2 / wanted)
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="place", outputCol="part").transform(rows) if len(splits) > 2 else rows.withColumn("part", F.lit(0.0))
    dealt = dealt.select(F.col("part").cast("int").alias("part"), "doc_id", "text")
    heads = dealt.groupBy("part").agg(F.min("doc_id").alias("id"), F.bool_or(F.col("doc_id").isNull()).alias("none")).collect()
    return dealt, sorted((r["part"], None if r["none"] else r["id"]) for r in heads)


def edited_digests(docs: DataFrame) -> DataFrame:
    """Each document's digest, its edited text's digest and likenesses: see the query op6.

    The edited text is the text with its last quarter of code points replaced by
    the first as many of the next document by ascending id, the first after the
    last. Rows of equal id follow each other by text; null ids come first.
    """
    dealt, heads = ranges_of(docs)
    # A range's last row needs the row that begins the next range, the last range the first row of all.
    follows = {p: heads[(k + 1) % len(heads)] for k, (p, _) in enumerate(heads)}
    copies = [(follower[1], p) for p, follower in follows.items()]
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(copies, "head long, to int")) if copies else None
    rows = dealt.select("part", F.lit(False).alias("after"), "doc_id", "text")
    if table:
        # Of rows with a head's id the first by text is the one that follows.
        again = dealt.join(table, F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("to", "doc_id").agg(F.min("text").alias("text")).select(F.col("to").alias("part"), F.lit(True).alias("after"), "doc_id", "text")
        rows = rows.unionByName(again)
    # By range, a part a task: by hash some tasks would have several parts and some none.
    rows = rows.repartitionByRange(max(1, len(heads)), "part").sortWithinPartitions("part", "after", F.col("doc_id").asc_nulls_first(), "text")
    arrow = to_arrow_schema(StructType.fromDDL(EDITED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, id, text, digest
        for batch in batches:
            out = []
            for part, after, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "after", "doc_id", "text")), strict=True):
                print_ = fingerprint(text)
                if held and held[0] == part:
                    out.append(compare(held[1], held[2], held[3], text, print_))
                held = None if after else (part, doc, text, print_)
            yield arrow_batch(arrow, *(zip(*out, strict=True) if out else [[]] * 7))

    return rows.mapInArrow(run, EDITED)


def compare(doc: int | None, text: str, print_: str, following: str, next_print: str) -> tuple:
    """A row of :data:`EDITED`."""
    n = len(text)
    edited = text[: n - n // 4] + following[: n // 4]
    edited_print = fingerprint(edited)
    return doc, n, sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_, edited_print, likeness(print_, edited_print), likeness(print_, next_print)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    schema = "doc_id long, fingerprint string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield arrow_batch(arrow, batch.column("doc_id"), [fingerprint(t) for t in batch.column("text").to_pylist()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
