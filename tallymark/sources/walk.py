"""Listing folders that Spark's readers pass over: names that begin with a dot.

Tools keep their stores in such folders. A level of folders is a table, and
tasks list the next level; only beginnings of files are read here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.session import scratch_path

#: Bytes, and names of a folder, that leave a task at once.
TOGETHER = 1 << 24
NAMES = 1 << 16
FOUND = "path string, folder boolean, size long"
_SCHEMA = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64())])


def _files(uri: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    table = lambda rows: pa.RecordBatch.from_pydict(dict(zip(_SCHEMA.names, map(list, zip(*rows, strict=True)) if rows else [[], [], []], strict=True)), schema=_SCHEMA)
    for batch in batches:
        rows: list[tuple] = []
        for path in batch.column("path").to_pylist():
            files, at = _files(path)
            try:
                for info in files.get_file_info(fs.FileSelector(at)):
                    rows.append((path.rstrip("/") + "/" + info.base_name, info.type == fs.FileType.Directory, info.size))
                    if len(rows) >= NAMES:
                        yield table(rows)
                        rows = []
            except (PermissionError, FileNotFoundError):
                rows.append((path, None, None))  # a folder that cannot be listed is not an empty one
        yield table(rows)


def qualified(spark: SparkSession, root: str) -> str:
    """A bare path on the file system that Spark's readers take it from: as it is on a local one, else with its scheme."""
    if not root.startswith("/"):
        return root
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    home = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().toString()
    return root if home.startswith("file:") else home.rstrip("/") + root


def below(spark: SparkSession, root: str, depth: int | None, skip: Sequence[str] = (), hidden: bool = True) -> DataFrame:
    """Files down to ``depth`` folders below the root, or all: path, folder, size; of folders that cannot be listed the last two are null.

    Without ``hidden``, names that Spark's readers pass over are left out. A link to
    nothing is a file without a size.
    """
    at = scratch_path(spark, "walk")
    level = spark.createDataFrame([(qualified(spark, root).rstrip("/") or "/",)], "path string")
    name = F.element_at(F.split("path", "/"), -1)
    passed = (name.startswith("_") & ~name.contains("=")) | name.startswith(".") | name.endswith("._COPYING_")
    shown = F.lit(True) if hidden else F.col("folder").isNull() | ~passed
    for nth in count() if depth is None else range(depth + 1):
        level.mapInArrow(_list, FOUND).where(shown).write.parquet(f"{at}/level={nth}")
        found = spark.read.schema(FOUND).parquet(f"{at}/level={nth}")
        level = found.where("folder").where(~name.isin(*skip) if skip else F.lit(True)).select("path").repartition("path")
        if level.isEmpty():
            break
    return spark.read.schema(FOUND).parquet(at).where("folder is null or not folder")


def walk(spark: SparkSession, root: str, depth: int, skip: Sequence[str] = ()) -> DataFrame:
    """Files down to ``depth`` folders below the root: path, size; of folders that cannot be listed the size is null."""
    return below(spark, root, depth, skip).select("path", "size")


def heads(files: DataFrame, most: int) -> DataFrame:
    """The first ``most`` bytes of each file: path, head; null if it cannot be read."""
    schema = pa.schema([("path", pa.string()), ("head", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths: list[str] = []
            out: list[bytes | None] = []
            held = 0
            for path in batch.column("path").to_pylist():
                try:
                    opened, at = _files(path)
                    with opened.open_input_file(at) as f:
                        out.append(f.read(most))
                except OSError:
                    out.append(None)
                paths.append(path)
                held += len(out[-1] or b"")
                if held >= TOGETHER:
                    yield pa.RecordBatch.from_pydict({"path": paths, "head": out}, schema=schema)
                    paths, out, held = [], [], 0
            if paths:
                yield pa.RecordBatch.from_pydict({"path": paths, "head": out}, schema=schema)

    return files.select("path").mapInArrow(run, "path string, head binary")
