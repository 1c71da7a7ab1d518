"""Which transcripts there are below home folders: three kinds of stores, each with its own depth.

Folders are listed level by level as Spark jobs. A file reached twice, by a link
to it or to a folder above it, or from two roots, is one file: the first path, by
root and then by name, counts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.session import kept
from tallymark.sources.lines import lines_in
from tallymark.sources.walk import walk

# Stores below a home folder, and how many folders below each its transcripts may lie.
STORES = [("cowork", "Library/Application Support/Claude/local-agent-mode-sessions", 7), ("codex", ".codex/sessions", 5)]
# The folder of transcripts in a profile, its depth, and how deep profiles lie below a root.
PROFILE, PROFILE_DEPTH, PROFILE_AT = "projects", 6, 4
SOURCE = "claude_code"


def identities(files: DataFrame) -> DataFrame:
    """Files (column ``path``) with ``real``, the path behind all links; of a remote file its own path, for there are none."""
    schema = pa.schema([("path", pa.string()), ("real", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_pydict({"path": paths, "real": [os.path.realpath(p) if p.startswith("/") else p for p in paths]}, schema=schema)

    return files.select("path").mapInArrow(run, "path string, real string")


def _classified(found: DataFrame, root: str) -> DataFrame:
    """source and base (the store's folder) of the files that lie in one, not too deep."""
    rest = F.substring("path", len(root.rstrip("/")) + 2, 1 << 20)
    folders = lambda text: F.size(F.split(text, "/")) - 1
    source, base = F.lit(None).cast("string"), F.lit(None).cast("string")
    before = F.regexp_extract(rest, f"^((?:[^/]+/){{0,{PROFILE_AT}}}?){PROFILE}/", 0)
    below = F.substring(rest, F.length(before) + 1, F.lit(1 << 20))
    fits = (before != "") & (folders(below) <= PROFILE_DEPTH)
    source, base = F.when(fits, SOURCE).otherwise(source), F.when(fits, before).otherwise(base)
    for name, folder, depth in STORES:
        there = rest.startswith(folder + "/")
        fits = folders(F.substring(rest, len(folder) + 2, 1 << 20)) <= depth
        source, base = F.when(there, F.when(fits, name)).otherwise(source), F.when(there, F.lit(folder + "/")).otherwise(base)
    return found.select(source.alias("source"), F.concat(F.lit(root.rstrip("/") + "/"), base).alias("base"), "path", "size").where("source is not null")


def transcripts(spark: SparkSession, roots: list[str], skip: list[str] | None = None) -> DataFrame:
    """Transcripts below the roots, each once: source, root_seq, base, path, real, size."""
    deepest = max(PROFILE_AT + 1 + PROFILE_DEPTH, *(folder.count("/") + 1 + depth for _, folder, depth in STORES))
    parts = None
    for seq, root in enumerate(dict.fromkeys(r.rstrip("/") or "/" for r in roots)):
        logs = walk(spark, root, deepest, skip or ()).where(F.col("size").isNotNull() & F.col("path").endswith(".jsonl"))
        here = _classified(logs, root).withColumn("root_seq", F.lit(seq))
        parts = here if parts is None else parts.unionByName(here)
    if parts is None:
        return spark.createDataFrame([], "source string, root_seq int, base string, path string, real string, size bigint")
    found = kept(parts, "transcripts")
    known = found.join(identities(found).distinct(), "path")
    first = F.min_by(F.struct("source", "root_seq", "base", "path", "size"), F.struct("root_seq", "path"))
    return known.groupBy("real").agg(first.alias("f")).select("f.source", "f.root_seq", "f.base", "f.path", "real", "f.size")


def lines_of(spark: SparkSession, found: DataFrame) -> DataFrame:
    """The lines of found transcripts with their source: source, path, split, line_no, line; tasks read what was found, wherever it lies."""
    return lines_in(found.select("source", "path", "size"))


def outside(profiles: list[str], roots: list[str]) -> list[str]:
    """Profiles under none of the roots, which are not read: to be named, for what was not read is not absent."""
    inside = [os.path.normpath(r) for r in roots]
    under = lambda p, r: p == r or p.startswith(r.rstrip("/") + "/")
    return [p for p in map(os.path.normpath, profiles) if not any(under(p, r) for r in inside)]
