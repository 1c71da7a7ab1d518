"""Binary stores: SQLite tables and encrypted, schemaless protobuf.

SQLite files are opened by Python's own library inside tasks, a file a row of
``binaryFile``; the protobuf walk is a table function over blobs.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deepest nesting followed, the most tokens a record can have, and the record's field numbers.
DEPTH, MOST_TOKENS = 14, 50_000_000
UNCACHED, OUTPUT, CACHED, SEEN, THOUGHT, REQUEST = 2, 3, 5, 9, 10, 11
#: Deepest nesting followed for times, their plausible seconds, and their longest message.
TIME_DEPTH, EARLIEST, LATEST, TIME_BYTES = 12, 1_500_000_000, 2_500_000_000, 12
# What a model's name in a blob looks like, and what only looks like one.
MODEL_NAME = r"gemini[-_][0-9A-Za-z][0-9A-Za-z._\-]{0,26}"
NO_MODEL = r"\.(json|md|zip|txt|py|js)$|^gemini-cli"
#: Votes of a name that the store itself gives as its model.
NAMED = 1000
USAGE = "path string, request string, input long, output long, cache_read long"


def sqlite_column(spark: SparkSession, roots: list[str], table: str, column: str, glob: str = "*.db") -> DataFrame:
    """A row per value of a column of the table in every SQLite file below the roots: path, value (binary).

    Files that cannot be read, or lack the table, give a row with a null value
    and ``readable`` false: unreadable is not empty.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(roots).select("path", "content")
    schema = "path string, readable boolean, value binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"path": [], "readable": [], "value": []}
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with tempfile.NamedTemporaryFile(suffix=".db", delete=False) as f:
                    f.write(content)
                try:
                    with sqlite3.connect(f"file:{f.name}?mode=ro&immutable=1", uri=True) as con:
                        values = [v for (v,) in con.execute(f'SELECT "{column}" FROM "{table}"')]
                    found = [(True, v.encode() if isinstance(v, str) else v if isinstance(v, bytes) or v is None else str(v).encode()) for v in values]
                except sqlite3.Error:
                    found = [(False, None)]
                finally:
                    os.unlink(f.name)
                for readable, value in found:
                    rows["path"].append(path)
                    rows["readable"].append(readable)
                    rows["value"].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("path", pa.string()), ("readable", pa.bool_()), ("value", pa.binary())]))

    return read.mapInArrow(run, schema)


def decrypted(content: Column, key: Column) -> Column:
    """AES-256-GCM over nonce, ciphertext and tag; null if it cannot be read."""
    return F.try_aes_decrypt(content, key, F.lit("GCM"))


def _varint(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    value = shift = 0
    while at < end and shift < 64:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7
    return None


def fields(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int | bytes]] | None:
    """(number, wire type, value) of a message, or None unless all bytes are fields: text must not pass as one."""
    end = len(data) if end is None else end
    out: list[tuple[int, int, int | bytes]] = []
    while at < end:
        if (key := _varint(data, at, end)) is None:
            return None
        (tag, at), number, wire = key, key[0] >> 3, key[0] & 7
        if not number:
            return None
        if wire == 0:
            if (got := _varint(data, at, end)) is None:
                return None
            value, at = got
            out.append((number, wire, value))
            continue
        if wire == 2:
            if (got := _varint(data, at, end)) is None:
                return None
            size, at = got
        else:
            size = {1: 8, 5: 4}.get(wire, -1)
        if size < 0 or at + size > end:
            return None
        out.append((number, wire, data[at : at + size]))
        at += size
    return out


def usage_records(data: bytes | None, depth: int = 0) -> Iterator[tuple[str | None, int, int, int]]:
    """(request, input, output, cached) of all messages that have a usage record's structure.

    The structure: output is the sum of its two parts, and all are plausible.
    """
    found = fields(data) if data else None
    if not found or depth > DEPTH:
        return
    numbers = {n: v for n, w, v in found if w == 0}
    out = numbers.get(OUTPUT, 0)
    if out and numbers.get(SEEN, 0) + numbers.get(THOUGHT, 0) == out and max(numbers.values()) < MOST_TOKENS:
        request = next((v.decode(errors="replace") for n, w, v in found if n == REQUEST and w == 2), None)
        yield request, numbers.get(UNCACHED, 0), out, numbers.get(CACHED, 0)
        return
    for _, wire, value in found:
        if wire == 2 and value:
            yield from usage_records(value, depth + 1)


def blob_usage(blobs: DataFrame, path: str, blob: str) -> DataFrame:
    """Usage records of blobs, one a request: records without a request id are told apart by their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *r) for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in usage_records(b)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(("path", "request", "input", "output", "cache_read"), columns, strict=True)}, schema=pa.schema([("path", pa.string()), ("request", pa.string()), ("input", pa.int64()), ("output", pa.int64()), ("cache_read", pa.int64())]))

    found = blobs.select(F.col(path).alias("path"), F.col(blob).alias("blob")).where("blob is not null").mapInArrow(run, USAGE)
    ident = F.coalesce("request", F.concat_ws("-", "input", "output", "cache_read"))
    return found.groupBy("path", ident.alias("request")).agg(*(F.max(c).alias(c) for c in ("input", "output", "cache_read")))


def times(data: bytes | None, depth: int = 0) -> Iterator[int]:
    """Epoch seconds of all messages that have a time stamp's structure: fields 1 and 2 only, short, plausible."""
    found = fields(data) if data else None
    if not found or depth > TIME_DEPTH:
        return
    for _, wire, value in found:
        if wire != 2 or len(value) < 2 or (inner := fields(value)) is None:
            continue
        seconds = next((v for n, w, v in inner if n == 1 and w == 0), 0)
        if EARLIEST < seconds < LATEST and len(value) <= TIME_BYTES and {n for n, _, _ in inner} <= {1, 2}:
            yield seconds
        else:
            yield from times(value, depth + 1)


def blob_times(blobs: DataFrame, path: str, blob: str) -> DataFrame:
    """First and last time stamp of each path's blobs: path, start, end."""
    schema = pa.schema([("path", pa.string()), ("seconds", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, s) for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in set(times(b))]
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in rows], "seconds": [s for _, s in rows]}, schema=schema)

    found = blobs.select(F.col(path).alias("path"), F.col(blob).alias("blob")).where("blob is not null").mapInArrow(run, "path string, seconds long")
    return found.groupBy("path").agg(F.timestamp_seconds(F.min("seconds")).alias("start"), F.timestamp_seconds(F.max("seconds")).alias("end"))


def model_votes(blobs: DataFrame, path: str, blob: str) -> DataFrame:
    """How often each model's name stands in a path's blobs: path, name, votes."""
    names = F.explode(F.regexp_extract_all(F.decode(F.col(blob), "ISO-8859-1"), F.lit(MODEL_NAME), F.lit(0)))
    found = blobs.where(F.col(blob).isNotNull()).select(F.col(path).alias("path"), names.alias("raw")).where(~F.col("raw").rlike(NO_MODEL))
    return found.select("path", F.regexp_replace("raw", "[-._]+$", "").alias("name")).where("name <> ''").groupBy("path", "name").agg(F.count(F.lit(1)).alias("votes"))


def blob_sessions(blobs: DataFrame, files: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """A provider session per file with usage: session_id, start, end, turns, counters, model.

    ``blobs`` has path and blob, ``files`` path and modified, ``named`` path and
    blob of what names the model: of it the longest name, of equals that of most
    votes, outweighs names that only stand in blobs. A file without times begins
    and ends when it was modified: no span is invented.
    """
    usage = blob_usage(blobs, "path", "blob").groupBy("path").agg(F.count(F.lit(1)).alias("turns"), *(F.sum(c).cast("long").alias(c) for c in ("input", "output", "cache_read")))
    votes = model_votes(blobs, "path", "blob")
    if named is not None:
        told = model_votes(named, "path", "blob").groupBy("path").agg(F.max_by("name", F.struct(F.length("name"), "votes", "name")).alias("name"))
        votes = votes.unionByName(told.withColumn("votes", F.lit(NAMED).cast("long"))).groupBy("path", "name").agg(F.sum("votes").alias("votes"))
    model = votes.groupBy("path").agg(F.min_by("name", F.struct(-F.col("votes"), F.col("name"))).alias("model"))
    met = usage.join(files.select("path", "modified"), "path").join(blob_times(blobs, "path", "blob"), "path", "left").join(model, "path", "left")
    ident = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return met.select(F.lit(0).alias("root_seq"), ident.alias("session_id"), F.coalesce("start", "modified").alias("start"), F.coalesce("end", "modified").alias("end"), "turns", "input", "output", "cache_read", F.lit(0).cast("long").alias("cache_write"), F.coalesce("model", F.lit("antigravity")).alias("model"))


def antigravity(spark: SparkSession, roots: list[str], key: bytes) -> tuple[DataFrame, DataFrame]:
    """Sessions of databases and encrypted files below the roots, and how many files could not be read: never zero usage."""
    read = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(roots)
    opened = read("*.pb").select("path", F.col("modificationTime").alias("modified"), decrypted(F.col("content"), F.lit(key)).alias("blob"))
    stored = sqlite_column(spark, roots, "steps", "metadata")
    names = sqlite_column(spark, roots, "gen_metadata", "data").where("readable").select("path", F.col("value").alias("blob"))
    blobs = opened.where("blob is not null").select("path", "blob").unionByName(stored.where("readable").select("path", F.col("value").alias("blob")))
    files = read("*.{db,pb}").select("path", F.col("modificationTime").alias("modified"))
    unread = opened.where("blob is null").select("path").unionByName(stored.where("not readable").select("path")).distinct()
    return blob_sessions(blobs, files, names), unread.agg(F.count(F.lit(1)).alias("unreadable"))
