"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered to one string and encoded once, with offsets.
The loss mask of its tokens comes from intersecting two sorted lists of spans,
the trained turns and the tokens, by binary search; no turn is encoded apart
from its neighbours, so token boundaries are those of the rendered text.

Template, a turn: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a newline.
The three control strings are single tokens and texts start and end at them,
so the spans under the mask are exactly the trained texts. Inside roles and
texts ``<|`` is escaped to ``<\\|`` (and ``<\\|`` to ``<\\\\|``, and so on), which is
undone by dropping one backslash: no text can forge a control string.

Cases: a null text or role is empty. Turns of equal number are ordered by role,
then text. Repeated rows are repeated turns. Rows without conversation id form
one conversation of null id. An empty table gives an empty result. Columns
other than the four named are ignored. One conversation is one training
example and is held by one task; its size is that of its output row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallymark.llm.store import arrow_batch

#: Fixed values of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = [START, SEP, END]
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

_BARE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEP) + r"(.*?)" + re.escape(END) + "\n", re.S)

SCHEMA = "conv_id long, n_turns long, formatted string, tokens array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"


def escape(text: str | None) -> str:
    """The text with every possible control string made harmless."""
    return _BARE.sub(r"<\\\1|", text or "")


def unescape(text: str) -> str:
    """Undo :func:`escape`."""
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str | None, str | None]], trained: frozenset[str]) -> tuple[str, np.ndarray]:
    """The conversation as one string, and the spans of the trained texts in it."""
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens overlap a span; both lists are sorted and spans are disjoint."""
    if not len(spans) or not len(starts):
        return np.zeros(len(starts), dtype=bool)
    nth = np.searchsorted(spans[:, 0], ends, side="left") - 1
    return (nth >= 0) & (starts < spans[np.maximum(nth, 0), 1]) & (ends > starts)


def masked_spans(starts: list[int], ends: list[int], mask: list[bool]) -> list[tuple[int, int]]:
    """The stretches of text that masked tokens cover; neighbours that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b, trained in zip(starts, ends, mask, strict=True):
        if not trained:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@cache
def tokenizer(path: str):
    """The tokenizer of a file, knowing the control strings, with untrimmed offsets."""
    from tokenizers import AddedToken, Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for part in ("pre_tokenizer", "post_processor"):
        if (spec.get(part) or {}).get("type") == "ByteLevel":
            spec[part]["trim_offsets"] = False
    made = Tokenizer.from_str(json.dumps(spec))
    made.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in CONTROLS])
    return made


def format_conversations(conversations: DataFrame, tokenizer_path: str = TOKENIZER, trained_roles: tuple[str, ...] = ("assistant",), batch: int = 64) -> DataFrame:
    """A row per conversation: rendered text, token ids, their offsets and loss mask.

    ``conversations`` has conv_id, turn, role and text, a row per turn. Offsets
    count code points of ``formatted``. ``loss_mask`` is true for tokens of the
    texts of ``trained_roles``.
    """
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    trained = frozenset(trained_roles)
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                talks = part.column("turns").to_pylist()
                rendered = [render([(t["role"], t["text"]) for t in talk], trained) for talk in talks]
                ids, starts, ends, masks = [], [], [], []
                for enc, (_, spans) in zip(encoder.encode_batch([t for t, _ in rendered], add_special_tokens=False), rendered, strict=True):
                    offsets = np.array(enc.offsets, dtype=np.int32).reshape(-1, 2)
                    ids.append(enc.ids)
                    starts.append(offsets[:, 0])
                    ends.append(offsets[:, 1])
                    masks.append(mask_tokens(offsets[:, 0], offsets[:, 1], spans))
                yield arrow_batch(schema, part.column("conv_id"), [len(t) for t in talks], [t for t, _ in rendered], ids, starts, ends, masks)

    return turns.mapInArrow(run, SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Digest columns, read back from the output of :func:`format_conversations`."""

    schema = to_arrow_schema(StructType.fromDDL(DIGEST_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            columns = (part.column(c).to_pylist() for c in ("formatted", "token_start", "token_end", "loss_mask"))
            for text, starts, ends, mask in zip(*columns, strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in masked_spans(starts, ends, mask))
                said = "".join(f"{role}\n{words}\n" for role, words in turns)
                rows.append((len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            yield arrow_batch(schema, part.column("conv_id"), *zip(*rows, strict=True)) if rows else arrow_batch(schema, *[[]] * 6)

    return formatted.select("conv_id", "formatted", "token_start", "token_end", "loss_mask").mapInArrow(run, DIGEST_SCHEMA)
