"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Benchmark items are looked for in every text as sequences of words, up to a
share of word edits. The CGK random walk reads a window and copies the word it
stands at to each of 3n outputs, going on by one word or staying as a random
function of step and word says; close sequences walk together, so edit
distance becomes Hamming distance. Item-sized windows and items are embedded
with the same walks; each of several tables samples a few output coordinates
to a key, and windows that share a key with an item are candidates. Repeating
walks and tables reaches the target recall (tests measure it). Candidates are
verified exactly, by bit-parallel approximate search of the item around the
window.

Windows start where the edit bound says that a match must have an anchor: d
edits of n words leave a run of (n - d) // (d + 1) words, so a window without
any such run of an item (at most three words of it are used) cannot match, and
no window is lost by leaving it out. All texts and all words are read.

The items are broadcast: of more than ``MOST_CHARS`` characters, blocks of about
that size are indexed, sent and searched one after the other, so the driver and
the tasks hold one block at a time.

Cases: a null or wordless text or item matches nothing. Items of fewer than
five words allow no edit. Rows of one id are one document, also those of none,
and items of one id one item: the closest match counts. Cleaning judges every
row by itself, with or without an id. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallymark.llm.store import Scratch, arrow_batch
from tallymark.llm.words import mix, words, words_of

SHARE = 0.2
#: Walks, tables a walk, coordinates a table.
WALKS, TABLES, SAMPLED = 8, 16, 3
MOST_CHARS = 20_000_000
ANCHOR = 3
#: Bits of the table that rules out most anchors, and windows embedded at once.
SIEVE, TOGETHER = 20, 4096
HITS = "doc_id long, item_id long, distance int, n_words int, start int, end int"


def allowed(n: int, share: float) -> int:
    """Most word edits of an item of n words."""
    return int(n * share + 1e-9)


def anchor_size(n: int, share: float) -> int:
    """Words in a row that any match of an item of n words has unchanged."""
    d = allowed(n, share)
    return max(1, min(ANCHOR, (n - d) // (d + 1)))


def runs(hashes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q words from each place on."""
    n = max(0, hashes.size - q + 1)
    out = np.full(n, q, dtype=np.uint64)
    for j in range(q):
        out = (out + hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def cgk(flat: np.ndarray, begin: np.ndarray, have: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """Embeddings, a column each, of windows ``flat[begin : begin + have]``; 3 * max(sizes) rows.

    Past its last word a window reads zeros. ``sizes`` are falling; a window's
    first 3 * size rows are its embedding.
    """
    steps = 3 * int(sizes.max(initial=0))
    out = np.zeros((steps, begin.size), dtype=np.uint64)
    odd = mix(np.arange(1, steps + 1, dtype=np.uint64) + np.uint64(walk << 32)) | np.uint64(1)
    at = np.zeros(begin.size, dtype=np.int64)
    last = flat.size - 1
    for j in range(steps):
        active = int(np.searchsorted(-3 * sizes, -j, side="left"))
        here = at[:active]
        word = np.where(here < have[:active], flat[np.minimum(begin[:active] + here, last)], np.uint64(0))
        out[j, :active] = word
        at[:active] += ((word * odd[j]) >> np.uint64(63)).astype(np.int64)
    return out


def sampled_keys(flat: np.ndarray, begin: np.ndarray, have: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """LSH keys of the windows, WALKS * TABLES rows; a key holds walk, table and size."""
    order = np.argsort(-sizes, kind="stable")
    begin, have, sizes = begin[order], have[order], sizes[order]
    draws = (mix(np.arange(1, WALKS * TABLES * SAMPLED + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    keys = np.empty((WALKS * TABLES, begin.size), dtype=np.uint64)
    for walk in range(WALKS):
        rows = cgk(flat, begin, have, sizes, walk)
        columns = np.arange(begin.size)
        for table in range(TABLES):
            nth = walk * TABLES + table
            key = sizes.astype(np.uint64) + np.uint64(nth << 32)
            for draw in draws[nth * SAMPLED : (nth + 1) * SAMPLED]:
                key = mix(key + rows[(draw * 3 * sizes).astype(np.int64), columns])
            keys[nth] = key
    back = np.empty_like(keys)
    back[:, order] = keys
    return back


@dataclass(frozen=True)
class Items:
    """The items of a block, their anchors by length and their LSH keys."""

    ids: list
    hashes: list[np.ndarray]
    anchors: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # q, sieve, sorted run hashes, item, offset
    keys: np.ndarray
    owners: np.ndarray
    share: float


def prepare(rows: list[tuple[int, str]], share: float) -> Items:
    """Index the items of a block."""
    found = [(i, h) for i, text in rows if (h := words(text)[2]).size]
    ids, hashes = [i for i, _ in found], [h for _, h in found]
    sizes = np.array([h.size for h in hashes], dtype=np.int64)
    anchors = []
    for q in range(1, ANCHOR + 1):
        of = [(r, k) for k, h in enumerate(hashes) if anchor_size(h.size, share) == q for r in [runs(h, q)]]
        if not of:
            continue
        values = np.concatenate([r for r, _ in of])
        item = np.concatenate([np.full(r.size, k) for r, k in of])
        offset = np.concatenate([np.arange(r.size) for r, _ in of])
        order = np.argsort(values, kind="stable")
        sieve = np.zeros(1 << SIEVE, dtype=bool)
        sieve[(values >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
        sieve[(values & np.uint64((1 << SIEVE) - 1)).astype(np.int64)] = True
        anchors.append((q, sieve, values[order], item[order], offset[order]))
    if not hashes:
        return Items([], [], [], np.empty(0, np.uint64), np.empty(0, np.int64), share)
    flat = np.concatenate(hashes)
    begin = np.cumsum(sizes) - sizes
    keys = sampled_keys(flat, begin, sizes, sizes)
    owners = np.broadcast_to(np.arange(sizes.size), keys.shape).ravel()
    order = np.argsort(keys.ravel(), kind="stable")
    return Items(ids, hashes, anchors, keys.ravel()[order], owners[order], share)


def spread(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted value all places of it in sorted ``values``: (which wanted, place)."""
    low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
    many = high - low
    which = np.repeat(np.arange(wanted.size), many)
    return which, np.arange(which.size) - np.repeat(np.cumsum(many) - many, many) + low[which]


def windows(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the item-sized windows that have an anchor; ``owner`` is each word's text."""
    starts, sizes = [], []
    lengths = np.array([h.size for h in items.hashes], dtype=np.int64)
    for q, sieve, values, item, offset in items.anchors:
        run = runs(flat, q)
        at = np.flatnonzero(sieve[(run & np.uint64((1 << SIEVE) - 1)).astype(np.int64)])
        at = at[sieve[(run[at] >> np.uint64(64 - SIEVE)).astype(np.int64)] & (owner[at] == owner[at + q - 1])]
        which, place = spread(values, run[at])
        where = at[which]
        starts.append(np.maximum(where - offset[place], begin[owner[where]]))
        sizes.append(lengths[item[place]])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.stack((np.concatenate(starts), np.concatenate(sizes))), axis=1)
    return pairs[0], pairs[1]


def search(item: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Least edits between the item and any stretch of the region, at most ``most``: (edits, start, end).

    Of equally close stretches the one that ends first, and of those the shortest.
    """
    # An edit takes away one of the item's words at most.
    here = set(region.tolist())
    if sum(w in here for w in item.tolist()) < item.size - most:
        return None
    end, edits = _ends(item, region)
    if edits > most:
        return None
    back, _ = _ends(item[::-1], region[:end][::-1], edits)
    return edits, end - back, end


def _ends(item: np.ndarray, region: np.ndarray, stop: int = -1) -> tuple[int, int]:
    """Where the closest stretch ends, and its edits; ends at once on ``stop`` edits."""
    peq: dict[int, int] = {}
    for j, value in enumerate(item.tolist()):
        peq[value] = peq.get(value, 0) | (1 << j)
    n = item.size
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, edits = full, 0, n
    best, at = n, 0
    for i, value in enumerate(region.tolist(), 1):
        eq = peq.get(value, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            edits += 1
        elif mh & top:
            edits -= 1
        xv = eq | mv
        ph, mh = (ph << 1) & full, (mh << 1) & full
        if stop >= 0:
            ph |= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if edits < best:
            best, at = edits, i
            if best == stop:
                break
    return at, best


def find(texts: list[str | None], items: Items) -> list[tuple[int, int, int, int, int, int]]:
    """Hits as (text, item, edits, item's words, start, end), the closest of each text and item."""
    read = list(words_of(texts))
    counts = np.array([h.size for _, _, h in read], dtype=np.int64)
    end = np.cumsum(counts)
    begin = end - counts
    if not items.ids or not counts.sum():
        return []
    flat = np.concatenate([h for _, _, h in read])
    owner = np.repeat(np.arange(counts.size), counts)
    starts, sizes = windows(flat, begin, end, owner, items)
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    seen: set[tuple[int, int]] = set()
    for k in range(0, starts.size, TOGETHER):
        at, size = starts[k : k + TOGETHER], sizes[k : k + TOGETHER]
        keys = sampled_keys(flat, at, np.minimum(size, end[owner[at]] - at), size)
        which, place = spread(items.keys, keys.ravel())
        for window, item in np.unique(np.stack((which % at.size, items.owners[place])), axis=1).T.tolist():
            start, doc = int(at[window]), int(owner[at[window]])
            if (start, item) in seen:
                continue
            seen.add((start, item))
            wanted = items.hashes[item]
            d = allowed(wanted.size, items.share)
            low, high = max(begin[doc], start - 2 * d), min(end[doc], start + wanted.size + 2 * d)
            if hit := search(wanted, flat[low:high], d):
                edits, a, b = hit
                new = (edits, wanted.size, int(low - begin[doc] + a), int(low - begin[doc] + b))
                if (doc, item) not in best or (new[0], new[2]) < (best[doc, item][0], best[doc, item][2]):
                    best[doc, item] = new
    out = []
    for (doc, item), (edits, n, a, b) in best.items():
        out.append((doc, item, edits, n, int(read[doc][0][a]), int(read[doc][1][b - 1])))
    return out


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items in as many blocks as their characters need, a block to be broadcast at a time."""
    wanted = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = 1 + chars // MOST_CHARS
    return [wanted.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block) for block in range(blocks)]


def send(items: DataFrame, share: float) -> Broadcast:
    """A block's items, indexed and broadcast."""
    return items.sparkSession.sparkContext.broadcast(prepare([(r["item_id"], r["text"]) for r in items.collect()], share))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """A row per document and item found in it: edits, the item's words, and the span in the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    arrow = to_arrow_schema(StructType.fromDDL(HITS))
    held = Scratch(docs.sparkSession, "hits")
    parts = []
    for nth, items in enumerate(item_blocks(benchmark)):
        sent = send(items, share)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                hits = [(ids[doc], sent.value.ids[item], *rest) for doc, item, *rest in find(batch.column("text").to_pylist(), sent.value)]
                yield arrow_batch(arrow, *(zip(*hits, strict=True) if hits else [[]] * 6))

        parts.append(held.table(rows.mapInArrow(run, HITS), f"block{nth}"))
        sent.destroy()
    best = F.min(F.struct("distance", "start", "n_words", "end")).alias("h")
    return reduce(DataFrame.union, parts).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "h.distance", "h.n_words", "h.start", "h.end")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows in whose text no item is found, each judged by itself; columns as given."""
    held = Scratch(docs.sparkSession, "clean")
    blocks = item_blocks(benchmark)
    for nth, items in enumerate(blocks):
        sent = send(items, share)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = {doc for doc, *_ in find(batch.column("text").to_pylist(), sent.value)}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if nth < len(blocks) - 1:
            docs = held.table(docs, f"block{nth}")
            sent.destroy()
    return docs
