"""Line dedup by common lines, natively: per-document keep bitmaps instead of texts.

A text's lines are cut at newlines. A line's key is the line without white space
at its ends and with A-Z in lower case. Keys of at least ``least_chars`` code
points that stand in at least ``min_documents`` documents are common; common
lines are dropped, all of them or all but their first occurrence.

(hash of the key, document, position) of each line is dealt out by ranges of all
three and sorted so. Ranges of hash and document split a line that most documents
have, so no task holds a hot key. Streaming a range in order, the first occurrence
of a key in each document is kept; these are counted range by range before the
counts of a key meet. Lines of common keys come back as runs of dropped lines,
the run-length form of a bitmap with a 0 for each of them. Texts are read, but
only hashes and runs are shuffled here; a caller who wants texts joins the runs.
Hashes are of 128 bits.

Cases: a null or empty text is one empty line. A document is an id with its text,
so repeated rows are one document; a null id is an id. Keys shorter than
``least_chars`` are never common. Other columns are ignored, whatever they are
called. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.store import Scratch

MIN_DOCUMENTS, LEAST_CHARS = 10, 1
# White space at the ends of a line, and letters without regard to case.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line: Column) -> Column:
    """The line as it is compared; of ASCII lines, lower() changes just A-Z, and is faster."""
    bare = F.trim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_hash(text: Column) -> Column:
    """Tells texts of one document id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines_of(docs: DataFrame, ident: str, text: str, least_chars: int) -> DataFrame:
    """doc, th (hash of the text), pos, and the key's hash as two longs, of each line with a key long enough."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(ident).alias("doc"), text_hash(F.col(text)).alias("th"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    rows = rows.select("doc", "th", "pos", key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return rows.select("doc", "th", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def common(lines: DataFrame, min_documents: int) -> DataFrame:
    """h, g, documents and first (doc, th, pos) of the keys in enough documents."""
    group = ["h", "g", "doc", "th"]
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("pos"))
    firsts = lines.repartitionByRange(*group).withColumn("nth", nth).where("nth = 1")
    counted = firsts.groupBy("h", "g").agg(F.count(F.lit(1)).alias("documents"), F.min(F.struct("doc", "th", "pos")).alias("first"))
    return counted.where(F.col("documents") >= min_documents)


def bitmaps(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_documents: int = MIN_DOCUMENTS, least_chars: int = LEAST_CHARS, keep_first: bool = False) -> DataFrame:
    """doc, th, n_dropped and ``dropped``, the runs (at, size) of dropped lines, of each document that loses lines.

    Lines count from 0. A document that is not in the result keeps all lines.
    """
    scratch = Scratch(docs.sparkSession, "linebits")
    lines = scratch.table(lines_of(docs, ident, text, least_chars), "lines")
    gone = lines.join(scratch.table(common(lines, min_documents), "common"), ["h", "g"])
    if keep_first:
        gone = gone.where(~F.struct("doc", "th", "pos").eqNullSafe(F.col("first")))
    in_doc = Window.partitionBy("doc", "th").orderBy("pos")
    gone = gone.select("doc", "th", "pos").withColumn("rank", F.dense_rank().over(in_doc))
    runs = gone.groupBy("doc", "th", (F.col("pos") - F.col("rank")).alias("run")).agg(F.min("pos").alias("at"), (F.max("pos") - F.min("pos") + 1).alias("size"))
    return runs.groupBy("doc", "th").agg(F.sum("size").cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("at", "size"))).alias("dropped"))


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The lines outside the dropped runs; all for a null. ``lines`` should be a column of its own, read once a run."""
    end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(dropped, i - 1)["at"] + F.get(dropped, i - 1)["size"])
    begin = lambda i: F.coalesce(F.get(dropped, i)["at"], F.size(lines))
    parts = F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda i: F.slice(lines, end(i) + 1, begin(i) - end(i)))
    return F.when(dropped.isNull(), lines).otherwise(F.flatten(parts))


def without_common_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_lines, n_dropped and ``kept``, the text of the lines that stay, of every row."""
    found = bitmaps(docs, ident, text, **how)
    rows = docs.select(F.col(ident).alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    met = rows.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("th")), "left")
    return met.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.array_join(kept_lines(F.col("lines"), F.col("dropped")), "\n").alias("kept"))
