"""Trees in a column: JSON documents and protobuf messages, walked by table functions.

:func:`register` makes ``json_walk`` and ``protobuf_walk`` callable from SQL, a
lateral join: ``SELECT d.id, w.* FROM docs d, LATERAL json_walk(d.body) w``. The
same classes serve DataFrames by :func:`walked`. A document is one row, walked in
one task; tables of documents are split as any other.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DecimalType, IntegerType, NullType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

# Fixed value: how deep JSON is walked, a string that is JSON itself counting as one step.
DEEPEST = 12


class Number(str):
    """A JSON number as it was written."""


def parsed(text: str | None):
    """A JSON value with its numbers as written, or None if ``text`` is none, or deeper than can be read."""
    try:
        return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_refuse) if text else None
    except (ValueError, RecursionError):
        return None


def _refuse(name: str):
    raise ValueError(name)


def inner(text: str):
    """The object or list that a string holds as JSON; None if it holds none."""
    if isinstance(text, Number) or text.lstrip()[:1] not in ("{", "["):
        return None
    value = parsed(text)
    return value if isinstance(value, (dict, list)) else None


def written(node) -> str:
    """A value as compact JSON, keys in their order."""
    if isinstance(node, Number):
        return str(node)
    if isinstance(node, str):
        return json.dumps(node, ensure_ascii=not node.isprintable() and any("\ud800" <= c <= "\udfff" for c in node))
    if isinstance(node, dict):
        return "{" + ",".join(f"{written(k)}:{written(v)}" for k, v in node.items()) + "}"
    if isinstance(node, list):
        return "[" + ",".join(map(written, node)) + "]"
    return json.dumps(node)


def nodes(node, path: str = "", depth: int = 0) -> Iterator[tuple[str, str | None]]:
    """(path, string) of every value below ``node``; null for one that is no string.

    Keys are joined by dots, a list is one step ``[]``, and a string that is JSON
    itself is walked on below ``(nested)``.
    """
    if depth >= DEEPEST:
        return
    if isinstance(node, dict):
        below = [(f"{path}.{k}" if path else k, v) for k, v in node.items()]
    elif isinstance(node, list):
        below = [(f"{path}[]", v) for v in node]
    else:
        return
    for at, value in below:
        text = value if isinstance(value, str) and not isinstance(value, Number) else None
        yield at, text
        nested = inner(text) if text is not None else None
        yield from nodes(value if nested is None else nested, at if nested is None else f"{at}(nested)", depth + 1)


def sentinel(label: str) -> bool:
    """Whether a label is in brackets, and so names nothing."""
    return label.startswith("[") and label.endswith("]")


def labels_in(node, key: str | None = None) -> Iterator[str]:
    """Project labels: strings at a key ``project``, and names in a list ``projects``, also in JSON within strings."""
    if isinstance(node, str) and not isinstance(node, Number):
        if key == "project" and node and not sentinel(node):
            yield node
        if (nested := inner(node)) is not None:
            yield from labels_in(nested)
    elif isinstance(node, list):
        for value in node:
            yield from labels_in(value)
    elif isinstance(node, dict):
        for k, value in node.items():
            if k == "projects" and isinstance(value, list):
                names = (x.get("name") for x in value if isinstance(x, dict))
                yield from (n for n in names if isinstance(n, str) and not isinstance(n, Number) and n and not sentinel(n))
            yield from labels_in(value, k)


def replaced(node, names: dict[str, str]):
    """The value with every string that is a key of ``names`` replaced; keys of objects stay."""
    if isinstance(node, str) and not isinstance(node, Number):
        if node in names:
            return names[node]
        nested = inner(node)
        if nested is None:
            return node
        changed = replaced(nested, names)
        return node if changed == nested else written(changed)
    if isinstance(node, list):
        return [replaced(v, names) for v in node]
    if isinstance(node, dict):
        return {k: replaced(v, names) for k, v in node.items()}
    return node


def masked(text: str | None, salt: str = "") -> str | None:
    """A document with every project label replaced by its pseudonym; None if it cannot be read, for then nothing is known to be masked."""
    try:
        node = parsed(text)
        if node is None:
            return None if text is None or text.strip() != "null" else "null"
        digest = lambda label: hashlib.sha256((salt + label).encode("utf-8", "replace")).hexdigest()
        return written(replaced(node, {label: f"proj-{digest(label)[:8]}" for label in labels_in(node)}))
    except RecursionError:
        return None


def mask_labels(salt: str = ""):
    """:func:`masked` as a function of a column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, salt))

    return run


def _of_kind(given: AnalyzeArgument, kind: DataType, **columns: DataType) -> AnalyzeResult:
    if not isinstance(given.dataType, (type(kind), NullType)):
        raise TypeError(f"a column of {kind.simpleString()} is needed, not of {given.dataType.simpleString()}")
    return AnalyzeResult(schema=StructType([StructField(n, t) for n, t in columns.items()]))


class JsonWalk:
    """Table function: path and string of every value in a JSON document; none for a text that is no JSON."""

    @staticmethod
    def analyze(document: AnalyzeArgument) -> AnalyzeResult:
        return _of_kind(document, StringType(), path=StringType(), string=StringType())

    def eval(self, document: str | None):
        clean = lambda s: s if s is None else s.encode("utf-8", "replace").decode()
        yield from ((clean(p), clean(s)) for p, s in nodes(parsed(document)))


class ProtobufWalk:
    """Table function: every field of a message without a descriptor: path (numbers), wire type, number or bytes.

    Bytes that are a message themselves, to their last byte, are walked on.
    """

    @staticmethod
    def analyze(message: AnalyzeArgument) -> AnalyzeResult:
        return _of_kind(message, BinaryType(), path=StringType(), wire=IntegerType(), number=DecimalType(20, 0), bytes=BinaryType())

    def eval(self, message: bytes | None):
        yield from self.below(bytes(message), "", 0) if message else ()

    def below(self, message: bytes, path: str, depth: int):
        from decimal import Decimal

        from tallymark.sources import binary

        for number, wire, value in (binary.fields(message) or []) if depth <= binary.DEPTH else []:
            at = f"{path}.{number}" if path else str(number)
            yield (at, wire, Decimal(value), None) if wire == 0 else (at, wire, None, bytes(value))
            if wire == 2 and value:
                yield from self.below(value, at, depth + 1)


FUNCTIONS = {"json_walk": JsonWalk, "protobuf_walk": ProtobufWalk}


#: Values given out at once.
VALUES = 1 << 15
#: Tasks that walk documents, by core.
DEALT = 2


def json_values(rows: DataFrame, ident: str, document: str) -> DataFrame:
    """ident, path and string of every value in each row's document, as ``json_walk`` finds them.

    A lateral join turns one row into one table after the other; here rows come
    and values go in batches, which is many times as fast.
    """
    schema = StructType([StructField(ident, rows.schema[ident].dataType), StructField("path", StringType()), StructField("string", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = JsonWalk()
        for batch in batches:
            names, found = batch.column(ident), ([], [], [])

            def batched() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([names.take(pa.array(found[0], pa.int64())), pa.array(found[1], pa.string()), pa.array(found[2], pa.string())], names=schema.names)
                for column in found:
                    column.clear()
                return out

            for i, text in enumerate(batch.column(document).to_pylist()):
                for path, string in walk.eval(text):
                    found[0].append(i)
                    found[1].append(path)
                    found[2].append(string)
                    if len(found[0]) >= VALUES:
                        yield batched()
            yield batched()

    return dealt(rows.select(ident, document)).mapInArrow(run, schema)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over the cores: walking documents costs far more than moving them, and a file may be one task."""
    return rows.repartition(DEALT * rows.sparkSession.sparkContext.defaultParallelism)


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL."""
    for name, kind in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(kind, useArrow=True))


def walked(rows: DataFrame, column: str, name: str = "json_walk") -> DataFrame:
    """Each row with each row that the table function makes of its ``column``."""
    return rows.lateralJoin(F.udtf(FUNCTIONS[name], useArrow=True)(F.col(column).outer()))
