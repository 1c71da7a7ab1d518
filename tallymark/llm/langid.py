"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every character that is no letter becomes a blank and
runs of blanks become one; n-grams of one to three characters are hashed into
``2**bits`` buckets. Fitting counts buckets by language in Spark; the smoothed
log-probability matrix (buckets by languages, a size that does not depend on
the corpus) is broadcast and whole texts are scored in batches: the n-grams of
many texts are laid end to end, their matrix rows gathered and summed by text.

Cases: a null text, or one without a letter, is ``und`` with score 0. With no
labelled row every text is ``und``. Equal scores go to the first language by
name. Repeated rows are predicted alike. Very long texts are scored in pieces
that overlap by two characters, so the sums are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tallymark.llm.store import arrow_batch, fresh
from tallymark.llm.words import code_points, lowered

UNKNOWN = "und"
#: Characters scored at once, and n-gram sizes.
PIECE = 1 << 15
SIZES = (1, 2, 3)
#: Labels beyond this are no languages; the matrix is broadcast.
MOST_LANGUAGES = 1000


@dataclass(frozen=True)
class Model:
    """Languages by name and log P(bucket | language), with log P(language)."""

    languages: tuple[str, ...]
    matrix: np.ndarray
    prior: np.ndarray


def letters(text: str) -> np.ndarray:
    """Lower-case code points with single blanks for all that is no letter; empty if there is no letter."""
    low, _, is_letter = lowered(code_points(text))
    if not is_letter.any():
        return np.empty(0, dtype=np.uint32)
    low = np.where(is_letter, low, np.uint32(32))
    blank = ~is_letter
    keep = np.ones(low.size, dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    low = low[keep]
    blanks = np.full(1, 32, dtype=np.uint32)
    return np.concatenate((blanks[: int(low[0] != 32)], low, blanks[: int(low[-1] != 32)]))


def grams(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the place where each starts, and its size.

    A code point of 0 parts texts: no n-gram spans it.
    """
    c = codes.astype(np.uint64)
    buckets, places, sizes = [], [], []
    h = np.zeros(c.size, dtype=np.uint64)
    whole = np.ones(c.size, dtype=bool)
    for n in range(1, max(SIZES) + 1):
        size = max(0, c.size - n + 1)
        h = (h[:size] + c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        h ^= h >> np.uint64(29)
        whole = whole[:size] & (codes[n - 1 :] != 0)
        if n in SIZES:
            at = np.flatnonzero(whole & (codes[:size] != 32)) if n == 1 else np.flatnonzero(whole)
            buckets.append(((h[at] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64))
            places.append(at)
            sizes.append(np.full(at.size, n))
    return np.concatenate(buckets), np.concatenate(places), np.concatenate(sizes)


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of many texts end to end, where each part starts, and whose it is."""
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0
    gap = np.zeros(1, dtype=np.uint32)
    for i, text in enumerate(texts):
        codes = letters(text) if text else gap[:0]
        for at in range(0, codes.size, PIECE):
            part = codes[max(0, at - max(SIZES) + 1) : at + PIECE]
            held += [part, gap]
            owners.append(i if at == 0 else -i - 1)
            size += part.size + 1
            if size >= PIECE:
                yield _joined(held, owners)
                held, owners, size = [], [], 0
    if held:
        yield _joined(held, owners)


def _joined(held: list[np.ndarray], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([h.size for h in held]).reshape(-1, 2).sum(1)
    return np.concatenate(held), np.concatenate(([0], np.cumsum(sizes)[:-1])), np.array(owners)


def gram_parts(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the texts' n-grams, each n-gram once, and the text of each."""
    for codes, starts, owners in pieces(texts):
        buckets, places, sizes = grams(codes, bits)
        part = np.searchsorted(starts, places, side="right") - 1
        owner = owners[part]
        again = owner < 0
        # A later piece repeats the last two characters of the one before it:
        # n-grams wholly inside that overlap were counted there.
        if again.any():
            keep = ~again | (places - starts[part] + sizes > max(SIZES) - 1)
            buckets, owner = buckets[keep], owner[keep]
        yield buckets, np.where(owner < 0, -owner - 1, owner)


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The best language of each text and its posterior probability."""
    n = len(texts)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    sums = np.zeros((n, len(model.languages)))
    seen = np.zeros(n, dtype=np.int64)
    bits = int(model.matrix.shape[0]).bit_length() - 1
    for buckets, owner in gram_parts(texts, bits):
        if not buckets.size:
            continue
        seen += np.bincount(owner, minlength=n)
        # Owners rise within an n-gram size: a few runs, each summed at once.
        runs = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        np.add.at(sums, owner[runs], np.add.reduceat(model.matrix[buckets], runs, axis=0))
    sums += model.prior
    best = sums.argmax(1)
    posterior = 1 / np.exp(sums - sums[np.arange(n), best][:, None]).sum(1)
    return [model.languages[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)], np.where(seen > 0, posterior, 0.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", bits: int = 16, smoothing: float = 0.5, max_per_language: int = 4000) -> Model:
    """Fit on rows of non-null text and language.

    ``max_per_language`` bounds the fitted rows: of a language with more, those
    whose text's hash falls into a share of that expected size are taken. The
    bucket counts that reach the driver number at most buckets times languages.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; is {lang!r} the column of language labels?")
    if not sizes:
        return Model((), np.zeros((1 << bits, 0)), np.zeros(0))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    chosen: Column = F.lit(True)
    for name, size in sizes.items():
        if size > max_per_language:
            chosen = chosen & ((F.col("lang") != name) | (draw < int((1 << 30) * max_per_language / size)))
    schema = StructType([StructField("lang", StringType()), StructField("bucket", LongType()), StructField("n", LongType())])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(name, []).append(body)
            for name, bodies in by.items():
                held.setdefault(name, np.zeros(1 << bits, dtype=np.int64))
                for buckets, _ in gram_parts(bodies, bits):
                    held[name] += np.bincount(buckets, minlength=1 << bits)
        for name, counts in held.items():
            at = np.flatnonzero(counts)
            yield arrow_batch(arrow, [name] * at.size, at, counts[at])

    counts = rows.where(chosen).mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = tuple(sorted(sizes))
    matrix = np.full((1 << bits, len(names)), smoothing)
    found = counts.toArrow()
    place = {name: k for k, name in enumerate(names)}
    matrix[found.column("bucket").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] += found.column("n").to_numpy()
    total = np.array([sizes[n] for n in names], dtype=float)
    return Model(names, np.log(matrix / matrix.sum(0)), np.log(total / total.sum()))


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns with the language and score, called ``names``; other columns are not read."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    read = fresh(df, "text_read")
    kept = df.select(*keep, F.col(text).alias(read))
    schema = StructType([*(kept.schema[c] for c in keep), StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = score(sent.value, batch.column(read).to_pylist())
            yield arrow_batch(arrow, *(batch.column(c) for c in keep), languages, scores)

    return kept.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from fitting: crc32 of its id modulo 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_identified(docs: DataFrame, least_score: float = 0.5, model: Model | None = None) -> DataFrame:
    """The documents whose language is recognised with at least ``least_score``.

    Without a ``model`` one is fitted on the documents themselves. Columns are those given.
    """
    model = model or fit(docs)
    names = fresh(docs, "lang_pred"), fresh(docs, "score")
    sent = predict(docs, model, keep=tuple(docs.columns), names=names)
    return sent.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least_score)).select(*docs.columns)


def identify(docs: DataFrame) -> DataFrame:
    """Predictions for all ``docs``, learnt from those that are not held out."""
    return predict(docs, fit(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
