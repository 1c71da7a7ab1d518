"""Token counts as delta-maintained rollups.

Documents are counted once by each tokenizer version. What happens to them
afterwards are changes: an insert adds a count, a delete takes it away, a
revision takes the old count away and adds the new one. A batch of changes is
summed to signed deltas by (source, lang, tokenizer) and committed below its
batch id; totals are the sums of the committed deltas, so a batch costs what
its changes cost, not what the corpus does. A batch id commits once: a second
attempt, or a retry after a crash, changes nothing.

Cases: a null text has no tokens and no characters but counts as a document.
Null sources and languages are groups of their own. Repeated rows count as
often as they occur. An empty batch commits and changes nothing. A batch whose
writing broke off is not read and is written anew; of two writers of one batch
id one commits.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from tallymark.llm.store import arrow_batch, delete, folders, fresh, path_exists, rename_once

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level BPE splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BPE, WORDS = "byte_bpe_50k", "words_v1"
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]


@cache
def encoding(path: str):
    """The tokenizer whose ranks are in a file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(docs: DataFrame, ranks: str = RANKS, keep: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """``keep`` columns, n_chars and a count by tokenizer version: columns BPE and WORDS."""
    read = fresh(docs, "text_read")
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias(read))
    schema = StructType([*(rows.schema[c] for c in keep), *(StructField(c, LongType()) for c in ("n_chars", BPE, WORDS))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks).encode_ordinary
        for batch in batches:
            texts = batch.column(read).to_pylist()
            yield arrow_batch(arrow, *(batch.column(c) for c in keep), [len(t) for t in texts], [len(encode(t)) for t in texts], [len(t.split()) for t in texts])

    return rows.mapInArrow(run, schema)


def by_tokenizer(counted: DataFrame) -> DataFrame:
    """A row per document and tokenizer version: ``tokenizer``, ``n_tokens`` for the count columns."""
    others = [c for c in counted.columns if c not in (BPE, WORDS)]
    pairs = F.array(*(F.struct(F.lit(c).alias("tokenizer"), F.col(c).alias("n_tokens")) for c in (BPE, WORDS)))
    return counted.select(*others, F.explode(pairs).alias("t")).select(*others, "t.tokenizer", "t.n_tokens")


def inserts(counts: DataFrame) -> DataFrame:
    """Signed changes that add the counts."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long"), F.col("n_chars").cast("long"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed changes that take the counts away."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).cast("long").alias("n_tokens"), (-F.col("n_chars")).cast("long").alias("n_chars"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed changes that put new counts in the place of old ones."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals kept as committed deltas in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batch(self, batch_id: str) -> str:
        if not batch_id or not all(c.isalnum() or c in "-_" for c in batch_id):
            raise ValueError("a batch id consists of letters, digits, - and _")
        return f"{self.path}/batch={batch_id}"

    def committed(self, batch_id: str) -> bool:
        """Whether the batch's deltas count."""
        return path_exists(self.spark, self._batch(batch_id))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False if that batch had been committed, or another writer was first.

        The deltas are written aside and renamed to the batch's folder, in one
        step and only if it does not exist.
        """
        if self.committed(batch_id):
            return False
        deltas = changes.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where(" or ".join(f"{c} <> 0" for c in SUMS))
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        deltas.write.parquet(aside)
        if rename_once(self.spark, aside, self._batch(batch_id)):
            return True
        delete(self.spark, aside)
        return False

    def deltas(self) -> DataFrame | None:
        """All committed deltas with their batch, one scan however many there are; None before the first."""
        if not path_exists(self.spark, self.path):
            return None
        sums = ", ".join(f"{c} long" for c in SUMS)
        found = self.spark.read.schema(f"source string, lang string, tokenizer string, {sums}, batch string").parquet(self.path)
        return found if "batch" in found.columns else None

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return sorted(name.removeprefix("batch=") for name in folders(self.spark, self.path) if name.startswith("batch="))

    def totals(self) -> DataFrame:
        """The rollup: sums of the committed deltas, without groups that have come to nothing."""
        found = self.deltas()
        if found is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long")
        sums = found.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return sums.where(" or ".join(f"{c} <> 0" for c in SUMS))
