"""Substring dedup by hashing lines and paragraphs: of equal ones the earliest stays.

A text's units are its clauses: anything but blanks, hyphens and apostrophes
between two words, such as a comma or a line break, ends a unit. From each unit on,
the shortest run of whole units with at least ``min_words`` words is a
paragraph. Paragraphs are normalised to their words without regard to case,
hashed, and grouped over all documents; the occurrence of least (doc_id, offset)
stays and the others are cut out of their texts. So lines and paragraphs that
repeat whole are found, wherever they stand. A passage whose ends lie inside
longer clauses is found only if ``min_words`` words of whole clauses remain in
it; ``passages`` finds every one. Cuts are code point offsets of the text as
given, from a paragraph's first word up to the next word after it; cuts that
touch are one.

Texts are read and cut inside their own tasks, in time linear in a text. The
first place of a digest that repeats comes from a partial aggregation and is
written; the join with it has a shuffle on either side, so Spark's skew rule
splits a digest that is in very many documents. Texts are shuffled once, to
meet their cuts.

Cases: a null text stays null and an empty one empty. Rows without an id are
given back as they are and count nowhere. Rows with one id are versions of one
document: a paragraph that stays in it stays in each of them. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tallymark.llm.store import Scratch, arrow_batch, fresh
from tallymark.llm.words import code_points, mix, words_of

#: Words of the shortest paragraph.
MIN_WORDS = 45
INSIDE = np.array([ord(c) for c in " -'\u2019"], dtype=np.uint32)
PARAGRAPH = "doc_id long, digest long, span long, again boolean"
#: Base of the polynomial hash of words.
BASE = 0x100000001B3


def prefix_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of word hashes times powers of the base, and the powers' inverses."""
    n = hashes.size + 1
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, BASE, dtype=np.uint64))), dtype=np.uint64)
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, pow(BASE, -1, 1 << 64), dtype=np.uint64))), dtype=np.uint64)
    return np.concatenate(([np.uint64(0)], np.cumsum(hashes * powers[:-1], dtype=np.uint64))), back


def paragraphs(text: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end offset and digest of each paragraph; the words are given by ``words_of``."""
    n = hashes.size
    if n < min_words:
        return (np.empty(0, np.int64),) * 3
    stops = np.concatenate(([0], np.cumsum(~np.isin(code_points(text), INSIDE))))
    first = np.concatenate(([0], 1 + np.flatnonzero(stops[starts[1:]] > stops[ends[:-1]])))
    last = np.append(first[1:], n)
    unit = np.searchsorted(last, first + min_words)
    first = first[unit < last.size]
    stop = last[unit[unit < last.size]]
    sums, back = prefix_hashes(hashes)
    digest = mix(mix((sums[stop] - sums[first]) * back[first]) + (stop - first).astype(np.uint64)).view(np.int64)
    return starts[first], np.append(starts, len(text))[stop], digest


def repeated_inside(digests: np.ndarray) -> np.ndarray:
    """Which of one text's digests stand in it before."""
    again = np.ones(digests.size, dtype=bool)
    again[np.unique(digests, return_index=True)[1]] = False
    return again


def found_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, digest, span (start * 2**32 + end), and whether it stands in its text before, of each paragraph."""
    arrow = to_arrow_schema(StructType.fromDDL(PARAGRAPH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [paragraphs(t, *w, min_words) for t, w in zip(texts, words_of(texts), strict=True)]
            if not found:
                continue
            counts = np.array([f[0].size for f in found])
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(counts.size), counts)))
            starts, ends, digests = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3))
            yield arrow_batch(arrow, ids, digests, (starts << 32) + ends, np.concatenate([repeated_inside(f[2]) for f in found]).astype(bool))

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, PARAGRAPH)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per paragraph that is not the earliest of its digest: doc_id, span, first_doc."""
    held = Scratch(docs.sparkSession, "paragraphs")
    found = held.table(found_paragraphs(docs, min_words), "found")
    first = held.table(found.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    return found.join(first, "digest").where("doc_id <> first_doc or again").select("doc_id", "span", "first_doc")


def merged(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch made one; the spans are sorted."""
    out: list[tuple[int, int]] = []
    for a, b in cuts:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the spans, which are in order."""
    kept, at = [], 0
    for start, end in cuts:
        kept.append(text[at:start])
        at = end
    return "".join(kept) + text[at:]


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, names: tuple[str, str] = ("cut_starts", "cut_ends")) -> DataFrame:
    """``docs`` with later repeats cut from ``text``, and two columns called ``names``.

    The new columns are the cuts' offsets in the text as given, in order; they
    take the place of columns of those names.
    """
    spans = repeated_spans(docs, min_words).groupBy("doc_id").agg(F.array_sort(F.collect_set("span")).alias("cuts"))
    ident, cuts = fresh(docs, "cut_doc"), fresh(docs, "cuts")
    spans = spans.select(F.col("doc_id").alias(ident), F.col("cuts").alias(cuts))
    given = [c for c in docs.columns if c not in names]
    met = docs.join(spans.hint("merge"), F.col("doc_id").cast("long") == F.col(ident), "left").select(*given, cuts)
    ints = ArrayType(IntegerType())
    schema = StructType([*(StructField(f.name, f.dataType) for f in docs.schema if f.name in given), StructField(names[0], ints), StructField(names[1], ints)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rows with one id share their spans; a shorter text has none beyond its end.
            texts = batch.column("text").to_pylist()
            spans = [merged([(x >> 32, x & 0xFFFFFFFF) for x in found or () if t is not None and x & 0xFFFFFFFF <= len(t)]) for t, found in zip(texts, batch.column(cuts).to_pylist(), strict=True)]
            texts = [t and cut(t, s) for t, s in zip(texts, spans, strict=True)]
            yield arrow_batch(arrow, *(texts if c == "text" else batch.column(c) for c in given), [[a for a, _ in s] for s in spans], [[b for _, b in s] for s in spans])

    return met.mapInArrow(run, schema)


def emptied_dropped(out: DataFrame, starts: str) -> DataFrame:
    """Rows but those left without any text by the cuts that begin at the column ``starts``."""
    emptied = (F.size(starts) > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return out.where(~F.coalesce(emptied, F.lit(False)))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with later repeats cut; documents left without any text by it are dropped."""
    names = fresh(docs, "cut_starts"), fresh(docs, "cut_ends")
    return emptied_dropped(remove_repeats(docs, names=names), names[0]).select(*docs.columns)
