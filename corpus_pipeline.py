"""A corpus pipeline of the package's operators, from documents to a mixed stream.

Counted as part of the subpackage ``llm``. Every stage takes and returns
documents; the last returns the stream's order: slot, place and document.

Cases, in every stage: columns other than doc_id, text, lang, source and n_chars
pass through whatever they are called, an empty table gives an empty one, and
repeated rows are rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontam, langid, mixing, neardup, passages
from tallymark.llm.store import materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter or a clear language go, also null texts."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of least id; null texts and rows without an id stay."""
    return neardup.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with later repeats of passages of over 50 words cut; n_chars follows the text.

    Texts of which nothing is left go. Null texts stay as they are; a row without an id is judged by itself,
    so it loses its own repeats.
    """
    out = passages.without_passages(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row judged by itself, with or without an id."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order in which documents are shown, by target weights of their sources; a null source is a source."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
]

#: Naive Bayes, sketches and alignments are no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
