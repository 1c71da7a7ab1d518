"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a bundle is
a file of frames that ends in a seek table, a skippable frame by the public
seekable format (compressed and decompressed size of each frame, their number
and a magic number), so any Zstandard reader decodes the file and a seeking
reader fetches one frame. An index row maps a record to (bundle, frame, offset
in the frame, length).

Of records with equal payloads that of the largest page_id carries it as a
``response``; the others are ``revisit`` records that refer to it. Only payloads
that repeat are written down and joined, so Spark's skew rule can split one that
very many pages have.

Bundles have names of their own for each task attempt, and the index, written
by Spark after them, names those of the attempts that counted: what a lost
executor leaves behind is never read. The folder must be one that all
executors see (``pyarrow.fs`` opens it: file, s3, gs or hdfs URIs).

Cases: null html is an empty payload, null url an empty header. Rows that
share a payload and its largest page_id are each a response. A row without
page_id has record id 'null', and is a response only if no row with an id has
its payload. An empty table gives an empty index.
"""

from __future__ import annotations

import struct
import uuid
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallymark.llm.store import Scratch, arrow_batch, scratch_path

#: Uncompressed bytes of a frame, and compressed bytes of a bundle, about.
FRAME, BUNDLE = 1 << 20, 128 << 20
#: Uncompressed bytes that a task reads back, about.
DEALT = 8 << 20
#: Fixed values of the seekable format: skippable frame and footer magic numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value: the date of records without one of their own.
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, bundle string, frame int, offset long, length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return b32encode(sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose block is empty."""
    kind = "response" if refers_to is None else "revisit"
    headers = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=_URL_SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    body = b""
    if refers_to is None:
        headers.append("Content-Type: text/html; charset=utf-8")
        body = payload
    else:
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    headers.append(f"Content-Length: {len(body)}")
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


_URL_SAFE = ":/?#[]@!$&'()*+,;=%-._~"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the offset after it."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = data[stop + 4 : stop + 4 + int(headers["Content-Length"])]
    return headers, body, stop + 4 + len(body) + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle; frames are (compressed, decompressed) sizes."""
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    content = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(content)) + content


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """Frame sizes from a bundle's end, which must hold the whole table."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    return [struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (n - k)) for k in range(n)]


class Bundle:
    """A bundle being written: frames go out as they fill up."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.compressor = out, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset that the record gets."""
        if self.held and self.size + len(data) > FRAME:
            self.flush()
        place = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        """End the frame."""
        if self.held:
            packed = self.compressor.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        """End the bundle with its seek table."""
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()


def open_fs(uri: str):
    """The file system and path of a URI; a bare path is a local one."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + uri.removeprefix("file:").lstrip("/"))
    return fs.FileSystem.from_uri(uri)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages as records into bundles below ``folder``; returns the index."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    held = Scratch(pages.sparkSession, "payloads")
    repeated = held.table(rows.groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    met = rows.join(repeated, "digest", "left").select("page_id", "url", "html", F.when(F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best")), F.col("best")).alias("refers_to"))
    arrow = to_arrow_schema(StructType.fromDDL(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_fs(folder)
        files.create_dir(f"{path}/bundles", recursive=True)
        bundle = name = None
        for batch in batches:
            out = []
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(files.open_output_stream(f"{path}/bundles/{name}", compression=None))
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
                frame, offset = bundle.add(data)
                out.append((page_id, name, frame, offset, len(data)))
                if bundle.written >= BUNDLE:
                    bundle.close()
                    bundle = None
            if out:
                yield arrow_batch(arrow, *zip(*out, strict=True))
        if bundle:
            bundle.close()

    met.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    held.drop("repeated")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def frames_of(files, path: str) -> list[tuple[int, int, int]]:
    """Position, compressed and decompressed size of each frame of a bundle."""
    with files.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 9)
        n = struct.unpack("<IBI", f.read(9))[0]
        f.seek(size - 9 - 8 * n)
        table = read_seek_table(f.read())
    at, out = 0, []
    for packed, plain in table:
        out.append((at, packed, plain))
        at += packed
    return out


def fetch(folder: str, bundle: str, frame: int, offset: int, length: int) -> bytes:
    """One record's bytes by its index row: reads the seek table and one frame."""
    import zstandard

    files, path = open_fs(folder)
    at, packed, plain = frames_of(files, f"{path}/bundles/{bundle}")[frame]
    with files.open_input_file(f"{path}/bundles/{bundle}") as f:
        f.seek(at)
        data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)
    return data[offset : offset + length]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the bundles that the index names, read from the bundles: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Frames are dealt out by the bytes in them, not by their rows in the index:
    a task reads about ``DEALT`` bytes, from any bundle. The digest and size of a
    response are computed from the payload read.
    """
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // DEALT
    frames = index.where("offset = 0").select("bundle", "frame").repartition(tasks, "bundle", "frame")
    arrow = to_arrow_schema(StructType.fromDDL(READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, path = open_fs(folder)
        tables: dict[str, list[tuple[int, int, int]]] = {}
        for batch in batches:
            for name, frame in zip(batch.column("bundle").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                where = f"{path}/bundles/{name}"
                if name not in tables:
                    tables[name] = frames_of(files, where)
                at, packed, plain = tables[name][frame]
                with files.open_input_file(where) as f:
                    f.seek(at)
                    data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)
                rows, at = [], 0
                while at < len(data):
                    headers, body, at = parse(data, at)
                    rows.append(fields(headers, body))
                yield arrow_batch(arrow, *zip(*rows, strict=True))

    return frames.mapInArrow(run, READ)


def fields(headers: dict[str, str], body: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A row of :data:`READ`; a response whose digest is not its payload's is an error."""

    def page(value: str | None) -> int | None:
        value = (value or "null").removeprefix("<urn:page:").removesuffix(">")
        return None if value == "null" else int(value)

    said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        if digest(body) != said:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
        return page(headers["WARC-Record-ID"]), len(body), said, "response", None
    return page(headers["WARC-Record-ID"]), int(headers["X-Payload-Length"]), said, "revisit", page(headers["WARC-Refers-To"])


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write the pages to bundles in the shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder)
