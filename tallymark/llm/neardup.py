"""Near-duplicates by Order MinHash, verified by banded alignment.

A document's k-mers are its five-word shingles, each labelled with how many
equal ones stand before it. Each hash function takes the ``l`` labelled k-mers
of least hash and keeps them in text order, so two sketches agree only if the
same k-mers occur in the same order: the chance follows edit similarity, not
set overlap. ``rows`` sketches together make a bucket key, ``bands`` keys a
document. Candidates are verified by aligning their words within the band that
the threshold allows: similarity is M / (n + m - M) for M words matched in
order, 0.8 by default, which is one word in nine changed on either side.

Recall: a change breaks the five k-mers around it, so at similarity 0.8 with
changes spread evenly two texts share 0.38 of their k-mers and a bucket with
probability 0.75; at 0.85 it is 0.97, at 0.9 over 0.999 (tests measure it).
Changes that stand together break fewer k-mers.

How it stays whole and spread out:

* texts of equal words are one node before anything else, by a partial
  aggregation on their digest; copies are never paired;
* buckets of equal members are one bucket;
* every node is first aligned with one other, the least head of its buckets;
  what is linked becomes one component. Then, in every bucket, each node is
  aligned with the bucket's head unless they are connected by now: a number
  linear in the bucket's size;
* in buckets that still hold several components, the nodes outside the largest
  one meet all others of like length in blocks of bounded size. First only
  their bags meet, counts of words by 128 hash buckets, which bound how many
  words two texts share: a node that can reach the threshold with no other
  component's goes. Every outside node's largest
  bucket is done first; what met there does not meet again. For those that stay texts are fetched; a task counts the
  words that they share, aligns the pairs that can reach the threshold and skips
  those already connected: links inside a component change no class;
* what buckets hold and what stands for them is written before they are joined,
  so Spark's skew rule can split a bucket that is in very many documents.

Cases: a null text is in a class of its own. Texts without a word are equal
only if the same string. A row without id has a null class. Rows with one id
are versions of one document and share its class. An empty table gives an
empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallymark.llm.store import Scratch, arrow_batch
from tallymark.llm.words import mix, occurrence_labelled, shingles, words, words_of

K, SIMILARITY = 5, 0.8
#: Chance to share a bucket where a share s of k-mers is in both: 1 - (1 - s**(L * ROWS))**BANDS.
L, ROWS, BANDS = 2, 2, 64
#: Nodes of a bucket that one task compares with as many others.
BLOCK = 256
#: Buckets of a bag, and the count that stands for it and more.
BAG, FULL = 128, 65535
#: Hash values held at once while a text is sketched.
HELD = 1 << 20


def order_minhash(labelled: np.ndarray, functions: int, l: int = L) -> np.ndarray:  # noqa: E741
    """A sketch value for each hash function: its ``l`` least k-mers in text order."""
    seeds = mix(np.arange(1, functions + 1, dtype=np.uint64))
    xors, factors = (seeds >> np.uint64(32)).astype(np.uint32), seeds.astype(np.uint32) | np.uint32(1)
    low = labelled.astype(np.uint32)
    out = np.empty(functions, dtype=np.uint64)
    step = max(1, HELD // max(1, labelled.size))
    for at in range(0, functions, step):
        hashed = (low[None, :] ^ xors[at : at + step, None]) * factors[at : at + step, None]
        chosen = []
        for _ in range(min(l, labelled.size)):
            least = hashed.argmin(1)
            chosen.append(least)
            hashed[np.arange(least.size), least] = np.iinfo(np.uint32).max
        value = np.zeros(hashed.shape[0], dtype=np.uint64)
        for place in np.sort(np.array(chosen), axis=0):
            value = mix(value + labelled[place])
        out[at : at + step] = value
    return out


def bucket_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Keys of the bands of one or more sketches; the band's number is part of its key."""
    bands = sketch.reshape(*sketch.shape[:-1], -1, rows)
    key = np.zeros(bands.shape[:-1], dtype=np.uint64) + np.arange(bands.shape[-2], dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[..., j])
    return key.view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """M / (n + m - M) for the most words M matched in order; 0 if below ``least``.

    Bit-parallel longest common subsequence. Matches further from the diagonal
    than the threshold's own distance allows are outside the band.
    """
    n, m = a.size, b.size
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    same = a[: min(n, m)] == b[: min(n, m)]
    head = min(n, m) if same.all() else int(same.argmin())
    same = a[n - min(n, m) + head :][::-1] == b[m - min(n, m) + head :][::-1]
    tail = same.size if same.all() else int(same.argmin())
    a, b = a[head : n - tail], b[head : m - tail]
    matched = head + tail
    if a.size and b.size:
        need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9)) - matched
        if min(a.size, b.size) < need:
            return 0.0
        band = a.size + b.size - 2 * max(need, 0)
        places: dict[int, int] = {}
        for j, value in enumerate(b.tolist()):
            places[value] = places.get(value, 0) | 1 << j
        full = (1 << b.size) - 1
        row, inside = full, (1 << (2 * band + 1)) - 1
        for i, value in enumerate(a.tolist()):
            hits = places.get(value, 0)
            if hits and band < b.size:
                hits &= inside << i - band if i >= band else inside >> band - i
            if hits:
                met = row & hits
                row = ((row + met) | (row - met)) & full
        matched += b.size - row.bit_count()
    similarity = matched / (n + m - matched)
    return similarity if similarity >= least else 0.0


NODES = "id long, node binary, size int, bag binary, keys array<long>"
PAIR = "a long, b long"
#: A block: a bucket, a class of length, and the numbers of its outside and of all its nodes.
BLOCKED = ["key", "class", "o", "a"]
STAYED = "key long, class int, o int, a int, id long, label long, outside boolean"


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest, number of words, bag and bucket keys of each document with an id."""
    arrow = to_arrow_schema(StructType.fromDDL(NODES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, bags, found = [], [], [], np.zeros((batch.num_rows, ROWS * BANDS), dtype=np.uint64)
            bodies = batch.column("text").to_pylist()
            for i, (body, (_, _, hashes)) in enumerate(zip(bodies, words_of(bodies), strict=True)):
                labelled = occurrence_labelled(shingles(hashes, K))
                nodes.append(None if body is None else blake2b(hashes.tobytes() or b"\0" + body.encode(), digest_size=16).digest())
                sizes.append(hashes.size)
                bags.append(bag(hashes))
                if labelled.size:
                    found[i] = order_minhash(labelled, ROWS * BANDS)
            keys = [row if size else [] for row, size in zip(bucket_keys(found), sizes, strict=True)]
            yield arrow_batch(arrow, batch.column("id"), nodes, sizes, bags, keys)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    return rows.mapInArrow(run, NODES)


def bag(hashes: np.ndarray) -> bytes:
    """How many of a text's words fall into each bucket."""
    return np.minimum(np.bincount((hashes % np.uint64(BAG)).astype(np.int64), minlength=BAG), FULL).astype("<u2").tobytes()


def may_link(rows: list[tuple[int, int, bool, int, bytes, list[int]]], least: float) -> list[tuple[int, int, bool]]:
    """Of a block's nodes, (id, component, outside, size, bag, met), those whose bags allow a link to another component.

    Nodes that have a bucket of ``met`` in common have been compared in it.
    """
    nodes: dict[int, list] = {}
    for i, label, outside, *rest in rows:
        nodes.setdefault(i, [label, False, *rest])[1] |= outside
    ids = sorted(nodes)
    labels, outside = np.array([nodes[i][0] for i in ids]), np.array([nodes[i][1] for i in ids])
    sizes = np.array([nodes[i][2] for i in ids], dtype=np.int64)
    bags = np.frombuffer(b"".join(nodes[i][3] for i in ids), dtype="<u2").reshape(-1, BAG)
    full = (bags == FULL).any(1)
    known = {key: k for k, key in enumerate(sorted({key for i in ids for key in nodes[i][4]}))}
    met = np.zeros((len(ids), len(known)), dtype=bool)
    for k, i in enumerate(ids):
        met[k, [known[key] for key in nodes[i][4]]] = True
    stay = np.zeros(len(ids), dtype=bool)
    for x in np.flatnonzero(outside):
        shared = np.minimum(bags, bags[x]).sum(1, dtype=np.int64)
        # A full bucket holds no bound.
        shared = np.minimum(np.where(full | full[x], sizes, shared), np.minimum(sizes, sizes[x]))
        near = (shared >= least * (sizes + sizes[x] - shared) - 1e-9) & (labels != labels[x]) & ~met[:, met[x]].any(1)
        stay |= near
        stay[x] |= near.any()
    return [(ids[k], int(labels[k]), bool(outside[k])) for k in np.flatnonzero(stay)]


def by_block(rows: DataFrame, columns: list[str], each: Callable[[list[tuple]], list[tuple]], schema: str, keep: bool) -> DataFrame:
    """What ``each`` makes of the rows of a block, told by BLOCKED; ``keep`` puts the block before it."""
    met = rows.select(*BLOCKED, *columns).repartition(*BLOCKED).sortWithinPartitions(*BLOCKED)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        at: tuple = ()

        def done() -> list[tuple]:
            return [(*(at if keep else ()), *r) for r in each(group)] if group else []

        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*BLOCKED, *columns)), strict=True):
                if row[: len(BLOCKED)] != at:
                    out += done()
                    group, at = [], row[: len(BLOCKED)]
                group.append(row[len(BLOCKED) :])
            if out:
                yield arrow_batch(arrow, *zip(*out, strict=True))
        if out := done():
            yield arrow_batch(arrow, *zip(*out, strict=True))

    return met.mapInArrow(run, schema)


def links(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """Those of the pairs whose texts are similar, by banded alignment.

    ``bodies`` has id and text. Each text goes out to the pairs that ask for it,
    and a pair's two texts meet in one row.
    """
    asked = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    met = bodies.hint("merge").join(asked, "id").groupBy("a", "b").agg(F.max(F.when(F.col("id") == F.col("a"), F.col("text"))).alias("left"), F.max(F.when(F.col("id") == F.col("b"), F.col("text"))).alias("right"))
    arrow = to_arrow_schema(StructType.fromDDL(PAIR))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [aligned_similarity(words(left or "")[2], words(right or "")[2], least) > 0 for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).cast(arrow)

    return met.mapInArrow(run, PAIR)


def compare_block(rows: list[tuple[int, int, bool, str]], least: float) -> list[tuple[int, int]]:
    """Links between nodes of a block: rows are (id, component, outside, text); outside nodes meet all.

    A pair's shared words bound its similarity from above, so only pairs that
    can reach ``least`` are aligned, the likeliest first, and none that earlier
    links of the block have connected.
    """
    nodes: dict[int, tuple[int, bool, str]] = {}
    for i, label, outside, text in rows:
        nodes[i] = (label, outside or (i in nodes and nodes[i][1]), text)
    ids = sorted(nodes)
    found = [words(nodes[i][2])[2] for i in ids]
    sizes = np.array([w.size for w in found])
    values, inverse = np.unique(np.concatenate([occurrence_labelled(w) for w in found]), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    parent = {label: label for label, _, _ in nodes.values()}

    def root(label: int) -> int:
        while parent[label] != label:
            parent[label] = parent[parent[label]]
            label = parent[label]
        return label

    near = []
    for x, i in enumerate(ids):
        if not nodes[i][1] or not sizes[x]:
            continue
        mark = np.zeros(values.size, dtype=np.int64)
        mark[inverse[begin[x] : begin[x] + sizes[x]]] = 1
        shared = np.add.reduceat(np.append(mark[inverse], 0), begin) * (sizes > 0)
        bound = shared / (sizes + sizes[x] - shared)
        for y in np.flatnonzero(bound >= least).tolist():
            if y != x and not (nodes[ids[y]][1] and y < x):
                near.append((-float(bound[y]), x, y))
    links = []
    for _, x, y in sorted(near):
        a, b = root(nodes[ids[x]][0]), root(nodes[ids[y]][0])
        if a != b and aligned_similarity(found[x], found[y], least) > 0:
            parent[max(a, b)] = min(a, b)
            links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
    return links


def mixed_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes of buckets that hold several components: key, id, size, label, main (the largest component), n."""
    labelled = buckets.select("key", "id", "size").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    return labelled.join(mixed, "key")


def across(held: Scratch, mixed: DataFrame, bags: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """Links between components that share a bucket: all that are not implied by others found.

    Texts whose lengths differ by more than the threshold allows are not alike,
    so nodes go by class of length and meet those of their own and the next class.
    """
    # A pair's logarithms differ by ``width`` at most. A class is twice as wide; who is near its end is in the next one too.
    width = -float(np.log(least))
    place = F.log(F.col("size").cast("double")) / (2 * width)
    own = F.floor(place).cast("int")
    inside = mixed.join(bags, "id").withColumn("class", F.explode(F.when(place - own >= 0.5 - 1e-9, F.array(own, own + 1)).otherwise(F.array(own))))
    inside = held.table(inside.select("key", "class", "id", "label", (F.col("label") != F.col("main")).alias("outside"), "size", "bag", "met"), "inside")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    counts = inside.groupBy("key", "class").agg(blocks(F.count(F.lit(1))).alias("all"), blocks(F.count_if("outside")).alias("out"), F.count_distinct("label").alias("labels"))
    counts = held.table(counts.where("out > 0 and labels > 1").drop("labels"), "counts")
    inside = inside.join(counts, ["key", "class"])
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    # A node outside the main component goes to every block of all nodes, any node to every block of outside ones.
    kept = ["id", "label", "outside", "size", "bag", "met"]
    outside = inside.where("outside").select("key", "class", mine(F.col("out")).alias("o"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("a"), *kept)
    every = inside.withColumn("outside", F.lit(False)).select("key", "class", F.explode(F.sequence(F.lit(0), F.col("out") - 1)).alias("o"), mine(F.col("all")).alias("a"), *kept)
    stayed = held.table(by_block(outside.unionByName(every), kept, lambda rows: may_link(rows, least), STAYED, True), "stayed")
    met = bodies.hint("merge").join(stayed, "id")
    return by_block(met, ["id", "label", "outside", "text"], lambda rows: compare_block(rows, least), PAIR, False)


def components(held: Scratch, edges: DataFrame) -> DataFrame:
    """The least id of each connected component: (id, label), for ids with an edge.

    Labels spread along edges and then skip to their label's label, so the
    number of rounds follows the logarithm of a component's width.
    """
    name = f"components{uuid.uuid4().hex[:8]}"
    both = held.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}/edges")
    labels = held.table(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"), f"{name}/0")
    nth = 0
    while True:
        nth += 1
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "id")
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        lower = held.table(lower.join(up, "label").select("id", "old", F.least("label", "up").alias("label")), f"{name}/{nth}")
        held.drop(f"{name}/{nth - 1}")
        labels = lower.select("id", "label")
        if lower.where("label <> old").isEmpty():
            held.drop(f"{name}/edges")
            return labels


def joined_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components, with their components as ``la`` and ``lb``."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"l{end}"))
    met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return met.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")).where("la <> lb")


def merged_labels(held: Scratch, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components after further links, as :func:`components` gives them; only what the links join is walked anew."""
    between = joined_labels(edges, labels).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    roots = components(held, between)
    lone = roots.join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("label"))
    known = labels.unionByName(lone)
    moved = roots.select(F.col("id").alias("label"), F.col("label").alias("root"))
    return held.table(known.join(moved, "label", "left").select("id", F.coalesce("root", "label").alias("label")), f"merged{uuid.uuid4().hex[:8]}")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """A row per document: its id, its class (the least id of it), and whether it is that id."""
    held = Scratch(docs.sparkSession, "neardup")
    sketched = held.table(sketches(docs, doc_id, text), "sketches")
    nodes = held.table(sketched.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("bag").alias("bag"), F.first("keys").alias("keys")), "nodes")
    slots = nodes.select("id", "size", F.explode("keys").alias("key"))
    # Most keys are one node's: those of several are told by number alone, before anything else is asked of them.
    shared = held.table(slots.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    filled = held.table(slots.join(shared, "key"), "filled")
    heads = filled.groupBy("key", "n").agg(F.min("id").alias("first"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    # Buckets of equal members, by number and two exclusive ors of hashes, are one.
    heads = held.table(heads.groupBy("n", "x", "y", "first").agg(F.min("key").alias("key")).select("key", "first"), "heads")
    buckets = held.table(filled.drop("n").join(heads, "key"), "buckets")
    held.drop("shared", "filled")
    # The texts of all that share a bucket: one shuffle of the corpus, read again by both rounds.
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    bodies = held.table(texts.join(buckets.select("id").distinct().hint("merge"), "id", "left_semi"), "bodies")

    order = lambda df: df.where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    one = held.table(order(buckets.groupBy("id").agg(F.min("first").alias("head"))), "one")
    labels = components(held, held.table(links(one, bodies, least), "links1"))
    star = order(buckets.select("id", F.col("first").alias("head"))).join(one, ["a", "b"], "left_anti")
    star = held.table(joined_labels(star, labels).select("a", "b"), "star")
    labels = merged_labels(held, labels, held.table(links(star, bodies, least), "links2"))
    held.drop("heads", "one", "star", "links1", "links2")
    # The largest mixed bucket of each node outside first: what it links, the others need not compare again.
    rest, bags = buckets, nodes.select("id", "bag", F.array().cast("array<long>").alias("met"))
    for nth in ("first", "rest"):
        mixed = held.table(mixed_buckets(rest, labels), f"{nth}/mixed")
        if nth == "first":
            chosen = held.table(mixed.where("label <> main").groupBy("id").agg(F.max_by("key", F.struct("n", "key")).alias("key")).select("key").distinct(), "chosen")
            rest, mixed = buckets.join(chosen, "key", "left_anti"), mixed.join(chosen, "key", "left_semi")
        round_ = Scratch(docs.sparkSession, "neardup-across")
        labels = merged_labels(held, labels, held.table(across(round_, mixed, bags, bodies, least), f"{nth}/links"))
        round_.drop("inside", "counts", "stayed")
        held.drop(nth)
        met = buckets.join(chosen, "key", "left_semi").groupBy("id").agg(F.collect_list("key").alias("met"))
        bags = nodes.select("id", "bag").join(met, "id", "left").withColumn("met", F.coalesce("met", F.array()))
    held.drop("chosen", "buckets", "bodies")

    classes = nodes.select("node", F.col("id").alias("rep")).join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("node", F.coalesce("label", "rep").alias("class_id"))
    out = sketched.select("id", "node").join(classes, "node", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))
    lost = docs.where(F.col(doc_id).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(lost).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents that stand for their class, and those without an id; columns as given."""
    gone = near_duplicates(docs, least=least).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
