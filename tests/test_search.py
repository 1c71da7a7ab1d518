"""Cells, postings and parts: recall against exact search, BM25 and containment against plain Python."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallymark.operators import cells, fleet, search, text_index


def test_cells_find_nine_in_ten_of_clustered_vectors_in_a_tenth_of_them(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    # One cluster holds a third of all rows.
    pick = lambda i: centres[0 if i % 3 == 0 else i % 40]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in pick(i)]) for i in range(3000)] + [(9000, None), (9001, [0.0] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(6)
    queries = df.where("id % 50 = 0 and v is not null and id < 9000").select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    index = cells.build(df, "id", "v", 60)
    assert index.vectors.count() == 3001 and index.vectors.where("cell is null").count() == 0
    found = cells.topk(index, queries, 10, 6)
    exact = search.cosine_topk(df.where("v is not null"), queries, 10, "id", "v")
    assert cells.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert cells.share_read(index, queries.where("query_id % 3 <> 0"), 6).agg(F.avg("share")).first()[0] < 0.2
    # All cells read: the exact answer.
    every = cells.topk(index, queries, 10, index.n_cells)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))


def test_cells_of_few_vectors(spark):
    schema = "id long, v array<double>"
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    for rows, want in (([], []), ([(5, [0.0, 2.0])], [(1, 1, 5, 0.0)]), ([(5, None)], []), ([(3, [1.0, 1.0])] * 2, [(1, 1, 3, 0.707107), (1, 2, 3, 0.707107)])):
        index = cells.build(spark.createDataFrame(rows, schema), "id", "v")
        assert sorted(map(tuple, cells.topk(index, queries, 5, 3).collect())) == want


def test_many_queries_are_matrix_products_with_the_scores_of_one_by_one(spark):
    """no row a pair; scores, ties, nulls, NaN and lengths as pair by pair, in few and in many queries."""
    rng = random.Random(4)
    odd = [None, [], [0.0] * 3, [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, 2.0], [1e-3, 1e300, 2.0]]
    rows = [(i, [round(rng.gauss(0, 1), 1) for _ in range(3)]) for i in range(1500)] + [(5000 - i, [0.5, 0.25, -1.0]) for i in range(1200)] + [(9000 + i, v) for i, v in enumerate(odd)] * 2
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    queries = df.where("id % 20 = 0 or id >= 9000 or v is null").select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    pairs = df.select("id", search.unit(F.col("v")).alias("v")).crossJoin(queries.select("query_id", search.unit(F.col("query")).alias("query")))
    want = search.best_k(pairs.select("query_id", "id", F.round(search.product(F.col("v"), F.col("query")), 6).alias("score")), 7)
    plain = lambda rows: sorted(map(str, map(tuple, rows.collect())))
    got = search.cosine_topk(df, queries, 7, "id", "v")
    assert plain(got) == plain(want)
    few = queries.where("query_id < 400 or query_id >= 9000")
    assert plain(search.cosine_topk(df, few, 7, "id", "v")) == plain(want.where("query_id < 400 or query_id >= 9000"))
    sound = df.where("id < 9000")
    queries = sound.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    index = cells.build(sound, "id", "v", 8)
    found = cells.topk(index, queries, 5, 2)
    for plan in (got, found):
        assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    near = {(r.query_id, r.cell) for r in cells.probes(index, queries, 2).collect()}
    assert len(near) == 2 * queries.count()
    at = {r.id: r.cell for r in index.vectors.collect()}
    assert all((r.query_id, at[r.id]) in near for r in found.collect())


def plain_bm25(docs, query, k):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    counts = {i: Counter(words(t)) for i, t in docs if t is not None and words(t)}
    df, mean = Counter(w for c in counts.values() for w in c), sum(sum(c.values()) for c in counts.values()) / max(1, len(counts))
    scores = {}
    for i, c in counts.items():
        got = [t * math.floor(math.log(1 + (len(counts) - df[w] + 0.5) / (df[w] + 0.5)) * (c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))) * 1e6) for w, t in Counter(words(query)).items() if w in c]
        if got:
            scores[i] = sum(got)
    return sorted(((-s, i) for i, s in scores.items()))[:k]


def test_bm25_equals_plain_python(spark):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)] + ["Über", "naïve"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "?!"), (903, "über-naïve, ÜBER")]
    queries = [(1, "w1 w2 w2 w7"), (2, "über"), (3, "nothing here"), (4, None), (5, "w1")]
    index = text_index.build(spark.createDataFrame(docs, "d long, t string").repartition(4), "d", "t")
    got = text_index.bm25(index, spark.createDataFrame(queries, "query_id long, query string"), 4)
    want = [(q, rank, i, -s) for q, text in queries if text for rank, (s, i) in enumerate(plain_bm25(docs, text, 4), 1)]
    assert sorted(map(tuple, got.collect())) == want
    none = text_index.build(spark.createDataFrame([], "d long, t string"), "d", "t")
    assert text_index.bm25(none, spark.createDataFrame(queries, "query_id long, query string"), 4).count() == 0


def test_bm25_gives_no_pairs_to_a_shuffle(spark):
    """F2: a row a document, scores added up where it is read, also over batches; ties by id in any block of queries."""
    docs = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 30))) for i in range(120)] + [(1000 + i, "same text here") for i in range(80)]
    queries = [(q, f"w{q % 7} w{q % 3} same") for q in range(300)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        index = text_index.build(spark.createDataFrame(docs, "d long, t string").repartition(3), "d", "t")
        assert index.documents.count() == len(docs)
        got = text_index.bm25(index, spark.createDataFrame(queries, "query_id long, query string"), 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == [(q, rank, i, -s) for q, text in queries for rank, (s, i) in enumerate(plain_bm25(docs, text, 4), 1)]


def test_parts_equal_plain_containment(spark):
    rng = random.Random(5)
    piece = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    texts = [piece(rng.randint(0, 30)) for _ in range(40)] + ["ABCD", None, "", "x" * 5000 + "needle"]
    needles = [piece(rng.randint(1, 8)) for _ in range(60)] + ["Needle", "xxxxxxx", "abcd", "", None, "q", "zzzz", "zzzzz"]
    a = spark.createDataFrame([(n,) for n in needles], "n string")
    b = spark.createDataFrame([(t,) for t in texts], "t string")
    missing = sorted(r.n for r in fleet.not_contained(a, "n", b, "t").collect())
    assert missing == sorted(n for n in needles if n and not any(n.lower() in t.lower() for t in texts if t is not None))
    assert sorted(r.n for r in fleet.not_contained(a, "n", b.limit(0), "t").collect()) == sorted(n for n in needles if n)
    assert fleet.not_contained(a.limit(0), "n", b, "t").count() == 0
