"""Substring dedup at any word: of equal stretches of over 50 words the earliest stays.

A window is a run of ``LEAST`` words, wherever it begins and ends; words are
compared without regard to case. The occurrence of a window of least (doc_id,
place) stays, and every other one is cut. So of any stretch of at least
``LEAST`` words that stands in two places, the later place loses every word,
whether its ends stand inside clauses or it has no punctuation at all. Where a
window overlaps its own earlier occurrence, only what lies beyond that is cut.

Not every window is written. Each has an anchor, its least run of ``ANCHOR``
words by hash, which equal windows share and neighbouring windows mostly share
too: one row for about sixteen words. Texts that hold an anchor which stands
elsewhere as well meet those anchors, and the windows around them, these alone,
are hashed, grouped and cut. Nothing is extended or sampled, so the result is
that of comparing all windows. A text whose words are those of an earlier
document, told by 128 bits of their digest, has all its windows there: it is
cut whole, and only the earliest copy's windows are written.

Both groupings are partial aggregations. Their results, the repeated digests
only, are written before rows join them, so both sides of a join are shuffles of
their own and Spark's skew rule splits a digest that is in very many documents.
Texts are shuffled twice, to meet their anchors and to meet their cuts. Work is
linear in a text.

Cases: a null text stays null and an empty one empty. A row without an id is
judged by itself: what its text says again is cut, and as it is neither earlier
nor later than another row, it counts nowhere else. Rows with one id are versions
of one document: a window that stays in it stays in each of them. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tallymark.llm.linededup import cut, emptied_dropped, merged, prefix_hashes, repeated_inside
from tallymark.llm.store import Scratch, arrow_batch, fresh
from tallymark.llm.words import mix, words_of

#: Passages of over 50 words.
LEAST = 51
#: Words of an anchor.
ANCHOR = 20
#: Rows of texts' own digests have no mark, and the digest's second half as run.
ANCHORS = "doc_id long, digest long, run long, mark int"
WINDOWS = "doc_id long, digest long, span long, lead int"


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A digest of each run of k words."""
    sums, back = prefix_hashes(hashes)
    return mix(mix((sums[k:] - sums[:-k]) * back[: sums.size - k]) + np.uint64(k))


def anchors(hashes: np.ndarray, least: int = LEAST, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest of each anchor and the first and last window that it is the anchor of."""
    if hashes.size < least:
        return (np.empty(0, np.int64),) * 3
    runs = run_hashes(hashes, k)
    # The leftmost of the least runs in a window; its place never goes back.
    seen = np.lib.stride_tricks.sliding_window_view(runs, least - k + 1)
    at = np.arange(seen.shape[0]) + seen.argmin(axis=1)
    first = np.concatenate(([0], 1 + np.flatnonzero(np.diff(at))))
    return runs[at[first]].view(np.int64), first, np.append(first[1:], at.size) - 1


def text_digest(hashes: np.ndarray) -> np.ndarray:
    """128 bits of a text's words, as two integers."""
    return np.frombuffer(blake2b(hashes.tobytes(), digest_size=16).digest(), dtype=np.int64)


def whole(hashes: np.ndarray) -> int:
    """The span that is all of a text; its mark, 25 bits, tells versions of a document apart."""
    return (int(text_digest(hashes)[1]) >> 39 & 0x1FFFFFF) << 38


def anchor_rows(hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Digest, run (first window * 2**32 + last) and mark of a text's anchors, with a row for the text itself.

    Anchors of equal texts have equal marks; where one stands in its text again
    the mark is another.
    """
    digests, first, last = anchors(hashes)
    if not digests.size:
        return digests, digests, digests, np.empty(0, bool)
    own = text_digest(hashes)
    again = repeated_inside(digests)
    marks = np.where(again, ~own[1], own[1]).astype(np.int32)
    return np.append(digests, own[0]), np.append((first << 32) + last, own[1]), np.append(marks, 0), np.append(np.zeros(digests.size, bool), True)


def windows(hashes: np.ndarray, runs: list[int], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest and place of the windows in ``runs``, and how many of its words are in its own earlier occurrence.

    That number is null (-1) for a window that does not stand in the text before.
    """
    n = hashes.size - least + 1
    wanted = np.zeros(max(n, 0) + 1, dtype=np.int64)
    for run in runs:
        first, last = run >> 32, run & 0xFFFFFFFF
        if last < n:
            wanted[first] += 1
            wanted[last + 1] -= 1
    at = np.flatnonzero(np.cumsum(wanted)[:-1])
    if not at.size:
        return (np.empty(0, np.int64),) * 3
    digests = run_hashes(hashes, least)[at].view(np.int64)
    _, index, inverse = np.unique(digests, return_index=True, return_inverse=True)
    before = at[index][inverse.ravel()]
    return digests, at, np.where(before < at, np.maximum(before + least - at, 0), -1)


def found_anchors(docs: DataFrame) -> DataFrame:
    """doc_id and :func:`anchor_rows` of each text."""
    arrow = to_arrow_schema(StructType.fromDDL(ANCHORS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchor_rows(w[2]) for w in words_of(batch.column("text").to_pylist())]
            if not found:
                continue
            counts = np.array([f[0].size for f in found])
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(counts.size), counts)))
            digests, runs, marks, texts = (np.concatenate([f[j] for f in found]) for j in range(4))
            yield arrow_batch(arrow, ids, digests.astype(np.int64), runs.astype(np.int64), pa.array(marks.astype(np.int32), mask=texts.astype(bool)))

    return docs.mapInArrow(run, ANCHORS)


def found_windows(met: DataFrame) -> DataFrame:
    """doc_id, digest, span (mark * 2**38 + place * 2**6 + LEAST) and lead of the windows in ``runs``.

    Texts whose :func:`whole` span is in ``copies`` have none.
    """
    arrow = to_arrow_schema(StructType.fromDDL(WINDOWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            held = []
            for w, runs, copies in zip(words_of(texts), batch.column("runs").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                mark = whole(w[2])
                held.append((w[2], mark, [] if mark in copies else runs))
            found = [windows(h, runs) for h, _, runs in held]
            if not found:
                continue
            counts = np.array([f[0].size for f in found])
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(counts.size), counts)))
            digests, at, lead = (np.concatenate([f[j] for f in found]).astype(np.int64) for j in range(3))
            marks = np.repeat(np.array([mark for _, mark, _ in held], dtype=np.int64), counts)
            yield arrow_batch(arrow, ids, digests, marks + (at << 6) + LEAST, lead)

    return met.mapInArrow(run, WINDOWS)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id and span of each window, or part of one, that is not the earliest of its digest."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    held = Scratch(docs.sparkSession, "passages")
    anchored = held.table(found_anchors(rows), "anchors")
    texts, places = anchored.where("mark is null"), anchored.where("mark is not null")
    same = held.table(texts.groupBy("digest", "run").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc"), "same")
    mark = F.shiftleft(F.shiftrightunsigned("run", 39), 38)
    copies = held.table(texts.join(same, ["digest", "run"]).where("doc_id > first_doc").select("doc_id", mark.alias("span")), "copies")
    often = held.table(places.groupBy("digest").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).where("least < most").select("digest"), "often")
    none = F.lit(None).cast("long")
    asked = places.join(often, "digest").select("doc_id", "run", none.alias("span")).unionByName(copies.select("doc_id", none.alias("run"), "span"))
    runs = asked.groupBy("doc_id").agg(F.collect_set("run").alias("runs"), F.collect_set("span").alias("copies")).where("size(runs) > 0")
    found = held.table(found_windows(rows.join(runs.hint("merge"), "doc_id").select("doc_id", "text", "runs", "copies")), "windows")
    held.drop("anchors", "same", "often")
    first = held.table(found.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    later = found.join(first, "digest").where("doc_id <> first_doc or lead >= 0")
    # A part begins so many words later and is so many words shorter.
    return later.select("doc_id", F.when(F.col("doc_id") == F.col("first_doc"), F.col("span") + F.col("lead") * 63).otherwise(F.col("span")).alias("span")).unionByName(copies)


def cuts_of(text: str | None, spans: list[int] | None) -> list[tuple[int, int]]:
    """Offsets of the cuts that the spans make in this version of the text."""
    if not text or not spans:
        return []
    starts, _, hashes = next(words_of([text]))
    own = whole(hashes)
    held = [(0, starts.size)] if own in spans else sorted((s >> 6 & 0xFFFFFFFF, (s >> 6 & 0xFFFFFFFF) + (s & 63)) for s in spans if s >> 38 == own >> 38)
    ends = np.append(starts, len(text))
    return [(int(starts[a]), int(ends[b])) for a, b in merged(held)]


def own_cuts(text: str | None) -> list[tuple[int, int]]:
    """Offsets of the cuts that a text's own repeats make in it, as if there were no other text."""
    if not text:
        return []
    starts, _, hashes = next(words_of([text]))
    _, at, lead = windows(hashes, [max(hashes.size - LEAST, 0)])
    ends = np.append(starts, len(text))
    return [(int(starts[a]), int(ends[b])) for a, b in merged(sorted((a + n, a + LEAST) for a, n in zip(at.tolist(), lead.tolist(), strict=True) if n >= 0))]


def remove_passages(docs: DataFrame, names: tuple[str, str] = ("cut_starts", "cut_ends")) -> DataFrame:
    """``docs`` with later repeats cut from ``text``, and two columns called ``names``.

    The new columns are the cuts' offsets in the text as given, in order; they
    take the place of columns of those names.
    """
    spans = repeated_spans(docs).groupBy("doc_id").agg(F.collect_set("span").alias("cuts"))
    ident, cuts = fresh(docs, "cut_doc"), fresh(docs, "cuts")
    spans = spans.select(F.col("doc_id").alias(ident), F.col("cuts").alias(cuts))
    given = [c for c in docs.columns if c not in names]
    met = docs.join(spans.hint("merge"), F.col("doc_id").cast("long") == F.col(ident), "left").select(*given, cuts)
    ints = ArrayType(IntegerType())
    schema = StructType([*(StructField(f.name, f.dataType) for f in docs.schema if f.name in given), StructField(names[0], ints), StructField(names[1], ints)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = batch.column("doc_id").is_valid().to_pylist()
            spans = [cuts_of(t, found) if k else own_cuts(t) for t, found, k in zip(texts, batch.column(cuts).to_pylist(), known, strict=True)]
            texts = [t and cut(t, s) for t, s in zip(texts, spans, strict=True)]
            yield arrow_batch(arrow, *(texts if c == "text" else batch.column(c) for c in given), [[a for a, _ in s] for s in spans], [[b for _, b in s] for s in spans])

    return met.mapInArrow(run, schema)


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with later repeats cut; documents left without any text by it are dropped."""
    names = fresh(docs, "cut_starts"), fresh(docs, "cut_ends")
    return emptied_dropped(remove_passages(docs, names), names[0]).select(*docs.columns)
