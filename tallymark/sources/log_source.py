"""Logs as a data source of Spark's, ``session_logs``: one reader for batch and stream.

    log_source.register(spark)
    spark.read.format("session_logs").option("stores", True).load(root)
    spark.readStream.format("session_logs").load(root)

A row is a non-empty line: ``root_seq path real source modified split line_no
line``, with the columns of :func:`tallymark.sources.lines.log_lines`, so a
file's splits are the segments of a prefix scan. Files are cut into ranges of
``splitBytes``, small ones share a partition; a line belongs to the range in which
it begins. Filters on path, source and modified decide which files are opened:
a log that was last changed before a time holds nothing later.

Options: ``paths`` (a JSON list) or the path of ``load``; ``stores`` for the
stores of home folders with a depth each, else ``suffix`` (.jsonl) and ``depth``
(folders below a root, 12); ``splitBytes``; ``tasks``, the most that read a batch
(0: one for each split; :func:`read` gives some a core).

A file that several roots or links reach is read once, by its first path (root,
then name). Folders that cannot be listed are passed over. Bytes that are no
UTF-8 are replaced. No root or no file gives no row.

A stream gives whole lines only: one that is still being written waits for its
end. Its offset names each file's bytes read; a file that has become shorter is
new. The driver lists files and holds one entry a file, as for Spark's own
readers, which read faster where only lines are wanted.
"""

from __future__ import annotations

import io
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from tallymark.sources.discover import PROFILE, PROFILE_AT, PROFILE_DEPTH, SOURCE, STORES
from tallymark.sources.walk import TOGETHER, _files, qualified

NAME = "session_logs"
SCHEMA = "root_seq int, path string, real string, source string, modified timestamp, split bigint, line_no bigint, line string"
SPLIT_BYTES = 32 << 20
#: Tasks that read, by core.
READERS = 8
_ARROW = pa.schema([("root_seq", pa.int32()), ("path", pa.string()), ("real", pa.string()), ("source", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("split", pa.int64()), ("line_no", pa.int64()), ("line", pa.string())])


def store_of(rest: str) -> str | None:
    """The kind of store in which a file lies, by its path below a home folder; None if in none, or too deep."""
    for name, folder, depth in STORES:
        if rest.startswith(folder + "/"):
            return name if rest.count("/") - folder.count("/") - 1 <= depth else None
    found = re.match(f"(?:[^/]+/){{0,{PROFILE_AT}}}?{PROFILE}/", rest)
    return SOURCE if found and rest.count("/", found.end()) <= PROFILE_DEPTH else None


@dataclass(frozen=True)
class Log:
    root_seq: int
    path: str
    real: str
    source: str | None
    modified: datetime
    size: int


@dataclass
class Ranges(ds.InputPartition):
    """Stretches of logs that one task reads."""

    ranges: list[tuple[Log, int, int]]


def _below(root: str, depth: int, fits) -> Iterator[tuple[str, str, datetime, int]]:
    """path, real path, time of change and size of the files below a root whose relative paths fit."""
    from pyarrow import fs

    files, at = _files(root)
    real_of = os.path.realpath if root.startswith("/") else lambda path: path
    levels = [(root.rstrip("/"), at.rstrip("/") or "/", (real_of(root),))]
    while levels:
        path, at, above = levels.pop()
        try:
            infos = files.get_file_info(fs.FileSelector(at))
        except OSError:
            continue
        for info in infos:
            name = f"{path}/{info.base_name}"
            rest = name[len(root.rstrip("/")) + 1 :]
            if info.type == fs.FileType.Directory:
                # A link back to a folder above would go on for ever.
                if rest.count("/") < depth and (real := real_of(name)) not in above:
                    levels.append((name, info.path, (*above, real)))
            elif info.type == fs.FileType.File and fits(rest):
                yield name, real_of(name), info.mtime.astimezone(timezone.utc), info.size


class Logs:
    """The logs that the options name."""

    def __init__(self, options: dict):
        self.roots = [r.rstrip("/") or "/" for r in (json.loads(options["paths"]) if "paths" in options else [options["path"]] if "path" in options else [])]
        self.stores = str(options.get("stores", "")).lower() == "true"
        self.suffix = options.get("suffix", ".jsonl")
        self.depth = max(PROFILE_AT + 1 + PROFILE_DEPTH, *(f.count("/") + 1 + d for _, f, d in STORES)) if self.stores else int(options.get("depth", 12))
        self.split_bytes = max(1, int(options.get("splitBytes", SPLIT_BYTES)))
        self.tasks = int(options.get("tasks", 0))
        self.tests: list = []

    def listed(self) -> list[Log]:
        """Each log once, by its first path, and only those that pass the filters."""
        fits = lambda rest: rest.endswith(self.suffix) and (not self.stores or store_of(rest) is not None)
        found: dict[str, Log] = {}
        for seq, root in enumerate(self.roots):
            for path, real, modified, size in sorted(_below(root, self.depth, fits)):
                found.setdefault(real, Log(seq, path, real, store_of(path[len(root.rstrip("/")) + 1 :]) if self.stores else None, modified, size))
        return [log for log in found.values() if all(test(log) for test in self.tests)]

    def packed(self, wanted: Iterable[tuple[Log, int, int]]) -> list[Ranges]:
        """Stretches cut at multiples of the split size and put together up to it."""
        out: list[Ranges] = []
        room = 0
        for log, start, end in wanted:
            while start < end:
                upto = min(end, (start // self.split_bytes + 1) * self.split_bytes)
                if upto - start > room:
                    out.append(Ranges([]))
                    room = self.split_bytes
                out[-1].ranges.append((log, start, upto))
                room -= upto - start
                start = upto
        return out

    def dealt(self, parts: list[Ranges]) -> list[Ranges]:
        """The stretches as they are cut, in at most ``tasks`` tasks: one costs a Python worker its start, however little it reads."""
        each = -(-len(parts) // self.tasks) if self.tasks else 1
        return [Ranges([stretch for part in parts[i : i + each] for stretch in part.ranges]) for i in range(0, len(parts), max(1, each))]


def _lines(log: Log, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in the stretch, each with its place in the file."""
    files, at = _files(log.path)
    with files.open_input_file(at) as raw, io.BufferedReader(raw, 1 << 20) as file:
        if start:
            # From the last byte before on, so that a line beginning at ``start`` is whole.
            file.seek(start - 1)
            start += len(file.readline()) - 1
        while start < end and (line := file.readline()):
            yield start, line
            start += len(line)


def _batches(part: Ranges) -> Iterator[pa.RecordBatch]:
    # What a stretch's rows have in common is held once for it.
    runs: list[tuple[Log, int, int]] = []
    places: list[int] = []
    lines: list[bytes] = []
    held = 0
    for log, start, end in part.ranges:
        seen = len(lines)
        for at, line in _lines(log, start, end):
            if line.strip():
                places.append(at + 1)
                lines.append(line.rstrip(b"\r\n"))
                held += len(line) + 200
            if held >= TOGETHER:
                yield _batch([*runs, (log, start, len(lines) - seen)], places, lines)
                runs, places, lines, held, seen = [], [], [], 0, 0
        if len(lines) > seen:
            runs.append((log, start, len(lines) - seen))
    if lines:
        yield _batch(runs, places, lines)


def _batch(runs: list[tuple[Log, int, int]], places: list[int], lines: list[bytes]) -> pa.RecordBatch:
    def common(name: str, value) -> pa.Array:
        kind = _ARROW.field(name).type
        return pa.concat_arrays([pa.repeat(pa.scalar(value(log, start), kind), n) for log, start, n in runs])

    logs = [common(name, lambda log, _, name=name: getattr(log, name)) for name in ("root_seq", "path", "real", "source", "modified")]
    try:
        text = pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
    return pa.RecordBatch.from_arrays([*logs, common("split", lambda _, start: start), pa.array(places, pa.int64()), text], schema=_ARROW)


def _test(given: ds.Filter):
    """A filter as a test of logs; None if it is not about files."""
    if len(getattr(given, "attribute", ())) != 1 or (name := given.attribute[0]) not in ("path", "source", "modified"):
        return None
    value = given.value
    if name == "modified" and isinstance(value, datetime):
        value = value.astimezone(timezone.utc) if value.tzinfo else value.replace(tzinfo=timezone.utc)
        over = {ds.GreaterThan: lambda t: t > value, ds.GreaterThanOrEqual: lambda t: t >= value, ds.LessThan: lambda t: t < value, ds.LessThanOrEqual: lambda t: t <= value}.get(type(given))
    elif name != "modified":
        over = {ds.EqualTo: lambda t: t == value, ds.In: lambda t: t in value, ds.StringStartsWith: lambda t: t.startswith(value), ds.StringEndsWith: lambda t: t.endswith(value), ds.StringContains: lambda t: value in t}.get(type(given))
    else:
        over = None
    return over and (lambda log: (got := getattr(log, name)) is not None and over(got))


class LogReader(ds.DataSourceReader):
    def __init__(self, logs: Logs):
        self.logs = logs

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for given in filters:
            if isinstance(given, ds.IsNotNull) and given.attribute in (("path",), ("modified",)):
                continue
            test = _test(given) if hasattr(given, "value") else None
            if test:
                self.logs.tests.append(test)
            else:
                yield given

    def partitions(self) -> list[Ranges]:
        # Without a file there is one task with nothing to read.
        return self.logs.dealt(self.logs.packed((log, 0, log.size) for log in self.logs.listed())) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return _batches(partition)


class LogStreamReader(ds.DataSourceStreamReader):
    def __init__(self, logs: Logs):
        self.logs = logs
        self.ends: dict[tuple[str, int], int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _end(self, log: Log) -> int:
        """Where the last whole line ends."""
        files, at = _files(log.path)
        end = log.size
        with files.open_input_file(at) as file:
            while end:
                start = max(0, end - (1 << 16))
                file.seek(start)
                if (last := file.read(end - start).rfind(b"\n")) >= 0:
                    return start + last + 1
                end = start
        return 0

    def latestOffset(self) -> dict:
        listed = self.logs.listed()
        self.ends = {(log.real, log.size): self.ends.get((log.real, log.size)) or self._end(log) for log in listed}
        return {real: end for (real, _), end in sorted(self.ends.items()) if end}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        logs = {log.real: log for log in self.logs.listed()}
        wanted = []
        for real, upto in end.items():
            since = start.get(real, 0)
            if real in logs and since != upto:
                wanted.append((logs[real], since if since < upto else 0, upto))
        return self.logs.packed(wanted) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return _batches(partition)

    def commit(self, end: dict) -> None:
        pass


class LogSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(Logs(self.options))

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(Logs(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with its filters."""
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _options(spark: SparkSession, roots: list[str], options: dict) -> dict:
    register(spark)
    return {"paths": json.dumps([qualified(spark, r.removeprefix("file://") if r.startswith("file:///") else r) for r in roots])} | {k: str(v) for k, v in options.items()}


def read(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """The lines of the logs below the roots."""
    return spark.read.format(NAME).options(**_options(spark, roots, {"tasks": READERS * spark.sparkContext.defaultParallelism} | options)).load()


def follow(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """The lines of the logs below the roots as a stream."""
    return spark.readStream.format(NAME).options(**_options(spark, roots, options)).load()
