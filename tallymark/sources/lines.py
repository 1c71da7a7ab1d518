"""Reading line-oriented logs as ordered rows of JSON values.

Logs are read line by line, so a file of any size splits into tasks. Only
stores that are one JSON document a file are read whole.
"""

from __future__ import annotations

import fnmatch
import io
import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallymark.sources.walk import TOGETHER, _files, below

#: Places of rows in a partition, the low bits of Spark's row ids.
PLACE = (1 << 33) - 1


def plain(path: Column) -> Column:
    """A path or URI without scheme and doubled slashes at its beginning."""
    return F.regexp_replace(path, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/+", "/")


def _plain(root: str) -> str:
    head, mark, tail = root.partition(":/")
    return "/" + (tail if mark else head).strip("/")


def resolved(roots: list[str]) -> list[str]:
    """The roots without repeats; links of a local file system are followed, so a linked profile counts once."""
    out: dict[str, str] = {}
    for root in roots:
        real = os.path.realpath(root) if root.startswith("/") else root
        out.setdefault(_plain(real), real)
    return list(out.values())


#: Tasks that list a store's folders, by core.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTERS = 4


#: Bytes up to which a log is read whole, and tasks that read whole files, by core.
SMALL = 1 << 20
READERS = 32
FILE = "_metadata.file_path"

#: Bytes of a file that are read at once, and tasks that read listed files, by core.
STRETCH = 1 << 23
TASKS = 8
MARK = b"\xef\xbb\xbf"


def _readers(spark: SparkSession) -> int:
    """Spark makes a task of some dozens of small files; put together, tasks stay few however many files there are."""
    return READERS * spark.sparkContext.defaultParallelism


def _contents(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Whole files: path, bytes (their number), content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select(F.col(FILE).alias("path"), F.col("_metadata.file_size").alias("bytes"), "content")


@contextmanager
def _few_listers(spark: SparkSession) -> Iterator[None]:
    """Spark lists a store of many folders by a task a folder, up to 10,000; a few tasks a core list the same ones sooner."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), LISTERS * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def _below(df: DataFrame, root: str, before: list[str], depth: int | None) -> DataFrame:
    """Files that no earlier root holds, at most ``depth`` folders below their own."""
    path = plain(F.col("path"))
    seen = reduce(lambda c, b: c | path.startswith(_plain(b).rstrip("/") + "/"), before, F.lit(False))
    out = df.where(~seen)
    if depth is not None:
        out = out.where(F.size(F.split(F.substring(path, F.lit(len(_plain(root).rstrip("/")) + 2), F.length(path)), "/")) <= depth)
    return out


def _each(spark: SparkSession, roots: list[str], schema: str, read, depth: int | None) -> DataFrame:
    roots = resolved(roots)
    # Files are listed when a reader is made.
    with _few_listers(spark):
        parts = [_below(read(root).withColumn("root_seq", F.lit(i)), root, roots[:i], depth) for i, root in enumerate(roots)]
    names = [c.split()[0] for c in schema.split(", ")]
    return reduce(DataFrame.unionByName, (p.select(*names) for p in parts)) if parts else spark.createDataFrame([], schema)


def files(spark: SparkSession, roots: list[str], glob: str, depth: int | None = None) -> DataFrame:
    """Whole files below the roots: root_seq, path, content (text), for stores of one document a file.

    A file reached from several roots counts for the first.
    """
    read = lambda root: _contents(spark, root, glob).select("path", F.col("content").cast("string").alias("content")).coalesce(_readers(spark))
    return _each(spark, roots, "root_seq int, path string, content string", read, depth)


def listed(spark: SparkSession, roots: list[str], glob: str, depth: int | None = None) -> DataFrame:
    """Files below the roots without their contents: root_seq, path, size, modified."""
    read = lambda root: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).coalesce(_readers(spark))
    return _each(spark, roots, "root_seq int, path string, size bigint, modified timestamp", read, depth)


def log_lines(spark: SparkSession, roots: list[str], glob: str = "*.jsonl", depth: int | None = None, many: bool = False) -> DataFrame:
    """Non-empty lines of logs: root_seq, path, split, line_no, line.

    ``split`` is where the stretch of the file begins that one task reads, so a
    file's splits are the segments of a prefix scan. ``line_no`` rises through a file: the offset of the line's split plus its
    place among the task's rows. A split's rows are fewer than its bytes, so it
    never meets the next split's numbers.

    With ``many``, for stores of a file a session, small files are read whole and cut into
    lines, for Spark's reader of lines takes milliseconds to open one; in them bytes
    that are no UTF-8 are replaced. Larger ones are read in splits as ever.
    """
    most = min(SMALL, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE))

    def read(root: str) -> DataFrame:
        block = F.col("_metadata.file_block_start")
        large = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
        large = (large.where(F.col("_metadata.file_size") > most) if many else large).select(F.col(FILE).alias("path"), block.alias("split"), (block + place + 1).alias("line_no"), F.col("value").alias("line")).where(F.trim("line") != "")
        if not many:
            return large
        # As the reader of lines has it: any of three ends, and no mark of the encoding at the beginning.
        text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
        small = _contents(spark, root, glob).where(F.col("bytes") <= most).coalesce(_readers(spark)).select("path", F.posexplode(F.split(text, "\r\n|\r|\n")).alias("pos", "line"))
        small = small.select("path", F.lit(0).cast("long").alias("split"), (F.col("pos") + 1).cast("long").alias("line_no"), "line")
        return large.unionByName(small.where(F.trim("line") != ""))

    return _each(spark, roots, "root_seq int, path string, split bigint, line_no bigint, line string", read, depth)


def _stretch(path: str, start: int, end: int, size: int) -> list[bytes]:
    """The lines that stand between line feeds of which the first begins in the stretch."""
    opened, at = _files(path)
    with opened.open_input_file(at) as raw:
        if end - start >= size:
            return raw.read().removeprefix(MARK).splitlines()
        with io.BufferedReader(raw, 1 << 20) as file:
            if start:
                # From the last byte before on, so that a line beginning at ``start`` is whole.
                file.seek(start - 1)
                start += len(file.readline()) - 1
            if start >= end:
                return []
            data = file.read(end - start)
            return (data if data.endswith(b"\n") else data + file.readline()).removeprefix(b"" if start else MARK).splitlines()


def _texts(found: list[bytes]) -> pa.Array:
    try:
        return pa.array(found, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([line.decode("utf-8", "replace") for line in found], pa.string())


def lines_in(listed: DataFrame) -> DataFrame:
    """Non-empty lines of listed files: ``split``, ``line_no`` and ``line`` as :func:`log_lines` has them take the place of ``size``.

    Files (path, size and columns of the caller's) are opened by the tasks that read
    them, so the driver holds none, however many they are; large ones are read in
    stretches. Bytes that are no UTF-8 are replaced. A path whose size is null could not be
    listed, and fails.
    """
    kept = [f for f in listed.schema if f.name != "size"]
    schema = StructType([*kept, StructField("split", LongType()), StructField("line_no", LongType()), StructField("line", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes, starts = (batch.column(c).to_pylist() for c in ("path", "size", "split"))
            rows: list[int] = []
            counts: list[int] = []
            found: list[bytes] = []

            def held(batch=batch, starts=starts) -> pa.RecordBatch:
                at = pa.array(np.repeat(np.array(rows, np.int64), counts))
                first = np.repeat(np.array([starts[i] for i in rows], np.int64), counts)
                place = np.concatenate([np.arange(1, n + 1) for n in counts])
                return pa.RecordBatch.from_arrays([*(batch.column(f.name).take(at).cast(arrow.field(f.name).type) for f in kept), pa.array(first), pa.array(first + place), _texts(found)], schema=arrow)

            size = 0
            for i, (path, whole, start) in enumerate(zip(paths, sizes, starts, strict=True)):
                if whole is None:
                    raise OSError(f"cannot be listed: {path}")
                here = [line for line in _stretch(path, start, min(whole, start + STRETCH), whole) if line.strip(b" ")]
                if here:
                    rows.append(i)
                    counts.append(len(here))
                    found += here
                    size += sum(map(len, here)) + 200 * len(here)
                if size >= TOGETHER:
                    yield held()
                    rows, counts, found, size = [], [], [], 0
            if rows:
                yield held()

    starts = F.when(F.col("size").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(STRETCH).cast("long")))
    dealt = listed.withColumn("split", F.explode(starts)).repartition(TASKS * listed.sparkSession.sparkContext.defaultParallelism, "path", "split")
    return dealt.mapInArrow(run, schema)


def walked_lines(spark: SparkSession, roots: list[str], glob: str = "*.jsonl", depth: int | None = None) -> DataFrame:
    """As :func:`log_lines`, for stores of very many files or folders: tasks list them and read them, and paths are plain."""
    name = F.element_at(F.split("path", "/"), -1)

    def read(root: str) -> DataFrame:
        files = below(spark, "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root, depth, hidden=False)
        return files.where("folder is null or size is not null").where(F.col("folder").isNull() | name.rlike(fnmatch.translate(glob)))

    return lines_in(_each(spark, roots, "root_seq int, path string, size bigint", read, depth))


def lines(read: DataFrame) -> DataFrame:
    """A row per non-empty line of whole files with its number, from 1."""
    return read.select("root_seq", "path", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line")).where(F.trim("line") != "").select("root_seq", "path", F.lit(0).cast("long").alias("split"), (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def objects(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """Lines that are JSON objects, as VARIANT ``j`` or as the struct ``kind``; junk, scalars, arrays and nulls cost only their line."""
    # A line that parses is an object if it begins like one. Lines come out of a generator, below which no filter
    # on fields is pushed: there the line would be parsed anew for each.
    begun = F.when(F.col("line").rlike("^[ \\t\\r\\n]*[{]"), F.try_parse_json("line"))
    return rows.withColumn("j", F.explode(F.array(get(begun, "$", kind) if kind else begun))).where("j is not null").drop("line")


def get(j: str | Column, path: str, kind: str) -> Column:
    """A field of a VARIANT, null if absent or of another kind."""
    return F.try_variant_get(j if isinstance(j, Column) else F.col(j), path, kind)


def string(j: str | Column, path: str) -> Column:
    """A field that is a JSON string, else null: numbers are not turned into strings."""
    field = get(j, path, "variant")
    return F.when(F.schema_of_variant(field) == "STRING", get(j, path, "string"))


def instant(text: Column) -> Column:
    """An ISO-8601 string as a timestamp; null if it is none."""
    return text.try_cast("timestamp")


def epoch(number: Column) -> Column:
    """Seconds or milliseconds since the epoch as a timestamp: below 1e11 they are seconds."""
    value = number.try_cast("double")
    return F.timestamp_micros(F.when(value < 1e11, value * 1e6).otherwise(value * 1e3).cast("long"))
