"""Hard negatives, line bitmaps and the filter audit: against brute force, SQL, and odd tables."""

import glob
import hashlib
import itertools
import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.llm import audit, linebits, negatives, queries

NAN, INF = float("nan"), float("inf")
TAKEN = ("id", "label", "vector", "rank", "block", "anchor", "score", "slot", "doc", "th", "pos", "h", "g", "lines", "dropped", "part", "fails", "filter", "key", "good", "toxic", "copy")


def clashing(df):
    """The table with columns named like the operators' own."""
    for name in TAKEN:
        df = df if name in df.columns else df.withColumn(name, F.lit(1))
    return df


@pytest.mark.parametrize("name", ["op11_kronecker_negatives", "op12_line_bitmaps", "op13_filter_audit"])
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(queries.ORACLES[name]).fetchdf()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())) and len(got)


# hard negatives


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.integers(1, 9), st.sampled_from([1, 7, 300, 1 << 15, 1 << 22, 1 << 40, 1 << 70]), st.integers(0, 1 << 30))
def test_products_are_exact(anchors, width, rows, size, seed):
    rng = random.Random(seed)
    some = lambda n: [[rng.randint(-rng.choice([1, size]), size) for _ in range(width)] for _ in range(n)]
    a, c = some(anchors), some(rows)
    kind = object if size > 1 << 50 else np.float64
    got = negatives.products(np.array(a, dtype=kind), np.array(c, dtype=kind))
    held = lambda v: max(-negatives.LONG, min(negatives.LONG, v))
    assert got.tolist() == [[held(sum(p * q for p, q in zip(x, y))) for y in c] for x in a]


def test_several_candidates_share_an_integer():
    # Components of four bits over eight places: five fields of ten bits fit 53.
    rng = np.random.default_rng(1)
    a, c = rng.integers(0, 8, (3, 8)).astype(float), rng.integers(0, 16, (11, 8)).astype(float)
    assert (negatives.products(a, c) == (a @ c.T)).all()


def brute(rows):
    """Rows of (vec_id, label, components): as the query defines it."""
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in ok:
        if i % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, m) for j, m, w in ok if j != i)
        for s, j, m in [x for x in scored if x[2] == lab][:5]:
            inside = [(n, k) for n, k, o in scored if o != lab and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(i, j, rank, k, -s, -n) for rank, (n, k) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows):
    df = clashing(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    out = negatives.mine(df, F.col("vec_id") % 50 == 0, F.col("label"))
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_mining_equals_brute_force_on_odd_rows(spark):
    rng = random.Random(3)
    vector = lambda: [rng.randint(-64, 64) / 64 for _ in range(6)]
    rows = [(i, i % 3, vector()) for i in range(160)]
    rows += [(200, None, vector()), (250, 1, None), (300, 1, [0.5, None, 0.5]), (350, 1, [NAN] * 6), (400, 2, [INF] * 6), (None, 1, vector()), (450, 0, []), (500, 0, [1.0]), (-50, 1, vector() * 2)]
    rows += [(600 + i, i % 2, [0.5] * 6) for i in range(40)] + [(50, 2, rows[50][2])] * 2 + [(7, 1, rows[7][2])]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows[:0]) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []


def test_mining_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, i % 2, [rng.random() for _ in range(4)]) for i in range(0, 900, 5)]
    whole = mined(spark, rows)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "CANDIDATES", 7)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    assert mined(spark, rows) == whole == brute(rows)


def test_one_vector_that_most_rows_share(spark):
    rows = [(i, 0 if i % 50 == 0 else 1 + i % 2, [0.5, 0.25]) for i in range(400)] + [(i, 0, [1.0, 0.5]) for i in range(1000, 1004)]
    got = mined(spark, rows)
    assert got == brute(rows) and {r[3] for r in got} == {1, 2, 3}


# lines


def plain_lines(rows, least=10, keep_first=False):
    """doc_id, n_lines, n_dropped, kept by a dictionary of keys."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in set(rows):
        for n, line in enumerate((t or "").split("\n")):
            held[key(line)].add((i is not None, i, t or "", n))
    common = {k: min(v) for k, v in held.items() if len({(i, t) for _, i, t, _ in v}) >= least and k}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for n, x in enumerate(lines) if key(x) not in common or keep_first and common[key(x)] == (i is not None, i, t or "", n)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ODD = [(1, None), (2, ""), (3, "\n\n"), (4, " Same Line\t\nown four\nSAME line"), (5, "same line"), (5, "same line\nsecond text"), (6, "same line"), (6, "same line"), (None, "same line\nx"), (7, "Ärger\x0b\nstraße\nsame line"), (8, "ärger\nSTRASSE\nÄrger"), (9, "a\r\nb\r\nsame line\r\n"), (10, " same line\nstraße"), (11, "\n".join(f"line {k % 700}" for k in range(30_000)) + "\nsame line")]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("least", [2, 3])
def test_lines_equal_a_dictionary(spark, least, keep_first):
    df = clashing(spark.createDataFrame(ODD, "doc_id long, text string"))
    out = linebits.without_common_lines(df, min_documents=least, keep_first=keep_first)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)
    want = plain_lines(ODD, least, keep_first)
    if keep_first:  # of one id's texts the first is told by hash, so compare what does not hang on it
        got, want = ([r[:2] for r in x if r[0] not in (5,)] for x in (got, want))
    assert got == want
    assert linebits.without_common_lines(df.limit(0)).count() == 0 and linebits.bitmaps(df.limit(0)).count() == 0


def test_first_occurrence_stays(spark):
    rows = [(i, f"own {i}\nshared words\nshared words") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {r.doc_id: r.kept for r in linebits.without_common_lines(df, keep_first=True).collect()}
    assert out[0] == "own 0\nshared words" and all(out[i] == f"own {i}" for i in range(1, 20))
    runs = {r.doc: [tuple(x) for x in r.dropped] for r in linebits.bitmaps(df).collect()}
    assert runs == {i: [(1, 2)] for i in range(20)}


def test_a_line_of_most_documents_is_split(spark):
    rows = [(i, f"common line\nown {i}") for i in range(4000)]
    lines = linebits.lines_of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = lines.repartitionByRange(8, "h", "g", "doc", "th").groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert parts.max() < 2.5 * parts.mean()
        assert linebits.common(lines, 10).select("documents").collect()[0][0] == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_line_bitmaps_run_no_python(spark, sf):
    plan = queries.op12_line_bitmaps(spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# audit


def plain_audit(rows, labels):
    """part, order, step and counts, document by document."""
    words = lambda t: [w for w in "".join("\n" if c in " \t\n\x0b\x0c\r" else c for c in t).split("\n") if w]
    quality, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    least = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            least[t or ""].append(i)
    told = []
    for i, t, lang in rows:
        t, w = t or "", words(t or "")
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > min(least[t]))) if bad}
        told.append((lang or "", fails, i in quality, i in toxic))
    out = []
    for part in {p for p, *_ in told}:
        mine = [x[1:] for x in told if x[0] == part]
        removed_by, steps = Counter(), []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [x for x in mine if f in x[0] and not x[0] & before]
                removed_by[f] += len(gone)
                steps.append((part, "".join(order), k + 1, sum(not x[0] & {*before, f} for x in mine), len(gone), sum(f in x[0] and bool(x[0] & before) for x in mine), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(*s, removed_by[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


AUDITED = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_brute_force_on_odd_rows(spark):
    rng = random.Random(2)
    prose = lambda n, words=4000: " ".join(f"w{rng.randrange(words)}" for _ in range(n))
    same = prose(220)
    rows = [(1, None, None), (2, "", "en"), (3, same, "en"), (4, same, "de"), (4, same, "de"), (None, same, "en"), (None, None, ""), (5, prose(250, 40), "en"), (6, "ABC " * 220, "en"), (7, prose(230) + " $", "de"), (8, prose(60_000), "de"), (9, "ÄÖ " * 300, "en"), (10, " \t\n ", "fr"), (11, prose(210) + " x", "en"), (12, prose(210), "en"), (13, "A" * 5 + prose(205), "en")]
    labels = [(3, 1, 0), (4, 0, 1), (4, 1, None), (None, 1, 1), (6, 1, 1), (12, 1, 0), (99, 1, 1), (7, None, 1)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit.audit(docs, told).select(*AUDITED).collect())
    assert got == plain_audit(rows, labels)
    assert audit.audit(docs.limit(0), told).count() == 0
    assert audit.audit(docs, told.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_audit_adds_up(spark, sf):
    out = queries.op13_filter_audit(spark, sf)
    last = out.where("step = 5").groupBy("part").agg(F.count_distinct("kept").alias("n")).toPandas()
    assert (last["n"] == 1).all()
    whole = out.groupBy("part", "filter_order").agg((F.max("kept") - F.min("kept")).alias("a"), F.sum("removed").alias("b"), F.max_by("removed", -F.col("step")).alias("first"))
    assert whole.where("b - first <> a").count() == 0
    digest = hashlib.sha256(str(sorted(map(tuple, out.select(*AUDITED).collect()))).encode()).hexdigest()
    assert digest == hashlib.sha256(str(sorted(map(tuple, queries.op13_filter_audit(spark, sf).select(*AUDITED).collect()))).encode()).hexdigest()
