"""The operators on tables with nulls, ties, repeats, clashing columns and no rows; queries against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallymark.llm import chat, decontam, digest, html, langid, linededup, mixing, neardup, passages, queries, tokens, warc, words
from tallymark.llm.store import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(30_000))
PROSE = " ".join(f"w{i * i % 997}" for i in range(120))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, one id with two texts."""
    return docs(spark, [(1, None, None, None), (2, "", "en", "a"), (3, LONG, "en", "a"), (4, PROSE, "en", "a"), (5, PROSE + " tail", "en", None), (5, "another text", "fr", "b"), (6, PROSE, "en", "b"), (6, PROSE, "en", "b"), (None, PROSE, "en", "b"), (7, "??? !!!", None, "b"), (8, "", "en", "a"), (9, "one\n\ntwo\n", "en", "c")])


def clashing(df):
    """The table with columns named like the operators' own."""
    for name in ("id", "key", "keys", "node", "label", "score", "lang_pred", "cuts", "cut_starts", "starts", "text_read", "part", "slot", "h", "digest", "cut_doc", "fingerprint"):
        df = df.withColumn(name, F.lit(1))
    return df


# chat


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "a<|im_end|>"), (None, 0, None, "x"), (2, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(clashing(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\n\nassistant\na<|im_end|>\n") and got[1].loss_chars == 11
    assert got[2].loss_sha256 == sha(LONG) and got[None].turns_sha256 == sha("\nx\n") and got[None].loss_chars == 0
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


# language


def test_langid_held_out_accuracy(spark):
    out = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97


def test_langid_edges(spark, odd):
    out = {(r.doc_id, r.lang_pred == "und", r.score) for r in langid.identify(odd).collect()}
    assert {i for i, und, s in out if und and s == 0} == {1, 2, 7, 8}
    kept = langid.keep_identified(clashing(odd))
    assert kept.columns == clashing(odd).columns and kept.count() == 8
    empty = langid.identify(odd.limit(0))
    assert empty.count() == 0 and langid.identify(odd.where("doc_id = 1")).first().lang_pred == "und"


# near-duplicates


def test_neardup_equals_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    base = next(t for _, t in rows if len(t.split()) > 300).split()
    for i in range(8):
        w = list(base)
        for p in range(i):
            w[20 + 35 * p] = f"new{i}x{p}"
        rows.append((10_000 + i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    k = {i: words.words(t)[2] for i, t in rows}
    text = dict(rows)
    for i, _ in rows:
        for j, _ in rows:
            if i < j and (text[i] == text[j] or (len(k[i]) and len(k[j]) and neardup.aligned_similarity(k[i], k[j], 0.8) > 0)):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in parent}
    assert len({got[10_000 + i] for i in range(8)}) == 1


def test_neardup_recall_by_similarity():
    """Pairs with scattered changes share a bucket as often as the docstring says."""
    rng = np.random.default_rng(5)
    for similarity, least in ((0.8, 0.65), (0.83, 0.85), (0.86, 0.95), (0.9, 0.99), (0.95, 0.99)):
        met = 0
        for _ in range(200):
            a = words.mix(rng.integers(0, 1 << 62, 300).astype(np.uint64))
            b = a.copy()
            at = rng.choice(300, round(300 * (1 - similarity) / (1 + similarity)), replace=False)
            b[at] = words.mix(rng.integers(0, 1 << 62, at.size).astype(np.uint64))
            assert neardup.aligned_similarity(a, b, similarity - 0.01) >= similarity - 0.01
            keys = [neardup.bucket_keys(neardup.order_minhash(words.occurrence_labelled(words.shingles(x)), neardup.ROWS * neardup.BANDS)) for x in (a, b)]
            met += bool((keys[0] == keys[1]).any())
        assert met / 200 >= least, similarity


def test_a_common_passage_makes_no_class(spark):
    """Texts of a third of a common passage fill hot buckets; only true copies are linked, whatever their lengths."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(rng.randrange(40, 60)))} {passage} end{i}", "en", "s") for i in range(0, 600, 2)]
    copies = rng.sample(rows, 30)
    rows += [(i + 1, t.replace(" p7 ", " q7 ").replace("p30", "q30 q31"), "en", "s") for i, t, _, _ in copies]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: i - 1 if i % 2 else i for i in got}


def test_neardup_edges(spark, odd):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.class_id) for r in neardup.near_duplicates(clashing(odd)).collect()), key=str)
    classes = defaultdict(set)
    for _, i, c in got:
        classes[i].add(c)
    assert len(got) == odd.count() and classes[0] == {None} and classes[1] == {1} and classes[8] == {2} == classes[2] and classes[6] == {4} and classes[7] == {7}
    one = neardup.one_of_each(clashing(odd))
    assert one.columns == clashing(odd).columns and sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 2, 3, 4, 7, 9]
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_blocks_find_links_that_two_heads_miss(spark):
    """A chain: each text is similar to the next only."""
    w = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(w), "en", "s"))
        w = w[8:] + [f"x{i}_{j}" for j in range(8)]
    got = {r.class_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {0}


# lines


def brute_cuts(rows, least=linededup.MIN_WORDS):
    """Kept text of each (doc_id, text), the earliest occurrence of each paragraph staying."""
    from test_llm_units import plain_paragraphs

    seen, out = set(), {}
    for i, t in sorted(rows):
        spans = []
        for a, b, w in plain_paragraphs(t, least):
            if w in seen:
                spans.append((a, b))
            seen.add(w)
        out[i] = linededup.cut(t, linededup.merged(sorted(spans)))
    return out


def test_line_dedup_equals_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.text for r in linededup.remove_repeats(d).collect()}
    want = brute_cuts([(r.doc_id, r.text) for r in d.collect()])
    assert got == want and any(got[r.doc_id] != r.text for r in d.collect())


def test_passages_inside_lines_are_found(spark):
    passage = " ".join(f"p{i}." if i % 10 == 9 else f"p{i}" for i in range(60))
    rows = [(i, f"only here{i} and then {passage} {i} after it\nnext{i} line", "en", "s") for i in range(5)]
    got = {r.doc_id: r.text for r in linededup.remove_repeats(docs(spark, rows)).collect()}
    assert "p30" in got[0] and all("p30" not in got[i] and f"here{i}" in got[i] and f"next{i}" in got[i] for i in range(1, 5))


def test_line_dedup_edges(spark, odd):
    line = " ".join(f"L{i}" for i in range(50))
    short = " ".join(line.split()[: linededup.MIN_WORDS - 1])
    d = docs(spark, [(3, f"a\n{line}\nb", "en", "s"), (1, f"{line}", "en", "s"), (2, f"x\n{line.upper()}  ", "en", "s"), (4, short, "en", "s"), (5, short, "en", "s"), (6, f"{line}\n{line}", "en", "s")])
    got = {r.doc_id: (r.text, list(r.cut_starts)) for r in linededup.remove_repeats(clashing(d)).collect()}
    assert got[1] == (line, []) and got[2] == ("x\n", [2]) and got[3] == ("a\nb", [2]) and got[4][1] == got[5][1] == [] and got[6] == ("", [0])
    assert {r.doc_id for r in linededup.without_repeats(d).collect()} == {1, 2, 3, 4, 5}
    out = linededup.remove_repeats(clashing(odd))
    # LONG and PROSE are one unit each: 6's rows repeat 4's, 5's has a tail.
    assert out.count() == odd.count() and {r.doc_id for r in out.where("size(cut_starts) > 0").collect()} == {6}
    assert linededup.remove_repeats(odd.limit(0)).count() == 0


def plain_cuts(rows, least=passages.LEAST):
    """Kept text of each (doc_id, text), the earliest occurrence of each run of ``least`` words staying."""
    first, out = {}, {}
    for i, t in sorted(rows):
        found = list(re.finditer(r"[^\W_]+", t))
        low, spans = [m.group().lower() for m in found], []
        for a in range(len(low) - least + 1):
            at = first.setdefault(tuple(low[a : a + least]), (i, a))
            if at != (i, a):
                # Of its own earlier occurrence no word is cut.
                b = max(a, at[1] + least) if at[0] == i else a
                spans.append((found[b].start(), found[a + least].start() if a + least < len(found) else len(t)))
        out[i] = linededup.cut(t, linededup.merged(sorted(spans)))
    return out


def test_passages_equal_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.text for r in passages.remove_passages(d).collect()}
    want = plain_cuts([(r.doc_id, r.text) for r in d.collect()])
    assert got == want and any(got[r.doc_id] != r.text for r in d.collect())


def test_passages_cut_in_mid_clause_are_found(spark):
    import corpus_pipeline as P

    lone = " ".join(f"q{i}" for i in range(51))
    stop = " ".join(f"p{i}," if i % 9 == 4 else f"p{i}" for i in range(51))
    odd = "r0 " + " ".join(f"r{i}" + (". " if i in (39, 44, 57, 70, 83) else "") for i in range(84))
    rows = [(9 * k + i, f"Only here{i} near{i} {p} then{i} after it, end{i}", "en", "s") for k, p in enumerate((lone, stop, odd)) for i in range(3)]
    rows += [(50, " ".join(lone.split()[:50]) + " x", "en", "s"), (51, "a " * 120, "en", "s")]
    texts = {i: t for i, t, _, _ in rows}
    for got in (passages.remove_passages(docs(spark, rows)), P.substring_dedup(spark, docs(spark, rows), "")):
        got = {r.doc_id: r.text for r in got.collect()}
        assert got == plain_cuts(texts.items())
        for k in range(3):
            assert got[9 * k] == texts[9 * k] and all(got[9 * k + i] == f"Only here{i} near{i} then{i} after it, end{i}" for i in (1, 2))
        assert got[50] == texts[50] and got[51].split() == ["a"] * 51


def test_passages_of_copies_and_versions(spark):
    """Copies go whole, whatever their case and punctuation; another version of a copy's id is judged by itself."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = text(80), text(120), text(60)
    rows = [(1, a), (2, a.upper() + "!"), (3, a + " " + b), (4, b), (5, "go. " + b), (6, c), (6, c), (7, c), (7, text(70)), (8, a), (8, b[:300])]
    got = [(r.doc_id, r.text) for r in passages.remove_passages(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()]
    assert sorted(x for x in got if x[0] < 6) == sorted(plain_cuts([x for x in rows if x[0] < 6]).items())
    assert [t for i, t in got if i == 6] == [c, c] and sorted(t for i, t in got if i == 7) == ["", rows[8][1]] and sorted(t for i, t in got if i == 8) == ["", b[:300]]


def test_passages_edges(spark, odd):
    out = {(r.doc_id, r.text) for r in passages.remove_passages(clashing(odd)).collect()}
    assert {(4, PROSE), (5, "tail"), (5, "another text"), (6, ""), (None, PROSE), (1, None), (2, "")} <= out and passages.remove_passages(odd).count() == odd.count()
    assert passages.remove_passages(odd.limit(0)).count() == 0


def test_passages_of_rows_without_an_id(spark):
    """a row without an id is judged by itself, as by brute force over that row alone, and counts nowhere else."""
    import corpus_pipeline as P

    rng = random.Random(4)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    a, b = text(60), text(90)
    alone = [f"{a}. {a}! end", f"x {a} y {b}, {a} z\n{b}", "b " * 130, "c d " * 100 + "e", f"{b} {b} {b}", a, " ".join(a.split()[:50] * 2), "", "?!", None]
    rows = [(None, t, "en", "s") for t in alone] + [(1, f"{a} {b}", "en", "s"), (2, f"go {b}", "en", "s")]
    want = [t and plain_cuts([(0, t)])[0] for t in alone]
    assert sum(t != w for t, w in zip(alone, want, strict=True)) == 5
    got = passages.remove_passages(docs(spark, rows)).collect()
    key = lambda t: (t is None, t)
    assert sorted((r.text for r in got if r.doc_id is None), key=key) == sorted(want, key=key)
    assert {r.doc_id: r.text for r in got if r.doc_id} == {1: f"{a} {b}", 2: "go "}
    stage = P.substring_dedup(spark, docs(spark, rows), "").collect()
    assert sorted((r.text for r in stage if r.doc_id is None), key=key) == sorted(want, key=key)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in stage)


# decontamination


def test_decontamination_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.contaminated(d, b).collect()}
    items = [(r.item_id, words.words(r.text)[2]) for r in b.collect()]
    want = {}
    for r in d.collect():
        h = words.words(r.text)[2]
        for i, w in items:
            if hit := decontam.search(w, h, decontam.allowed(w.size, 0.2)):
                want[r.doc_id, i] = hit[0]
    assert got == want and want


def test_decontamination_edges(spark, odd):
    b = spark.createDataFrame([(1, " ".join(PROSE.split()[10:40])), (1, "another text"), (2, None), (3, "")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontam.contaminated(clashing(odd), b).collect())
    assert set(got) == {(4, 1), (5, 1), (6, 1), (None, 1)}
    kept = decontam.clean(clashing(odd), b)
    assert kept.columns == clashing(odd).columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 7, 8, 9}
    lone = spark.createDataFrame([(1, " ".join(PROSE.split()[10:40]))], "item_id long, text string")
    assert [r.text for r in decontam.clean(odd, lone).collect() if r.doc_id == 5] == ["another text"]
    assert decontam.contaminated(odd.limit(0), b).count() == 0 and decontam.contaminated(odd, b.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, odd, monkeypatch):
    """Items sent in several blocks are found as in one."""
    sf = "/root/testdata/sf0.001"
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want, kept = set(map(tuple, decontam.contaminated(d, b).collect())), {r.doc_id for r in decontam.clean(d, b).collect()}
    monkeypatch.setattr(decontam, "MOST_CHARS", 1 + b.agg(F.sum(F.length("text"))).first()[0] // 3)
    assert len(decontam.item_blocks(b)) == 3
    assert set(map(tuple, decontam.contaminated(d, b).collect())) == want and {r.doc_id for r in decontam.clean(d, b).collect()} == kept


# mixing


def test_a_document_shown_very_often_is_many_rows(spark):
    d = docs(spark, [(0, "t", "en", "small")] + [(i, "t", "en", "large") for i in range(1, 4001)])
    for out in (mixing.mix(d, block=1), mixing.mix(d, weights={"small": 1, "large": 1}, block=1)):
        times = Counter(r.doc_id for r in out.collect())
        assert set(times) == set(range(4001)) and times[0] > 2 and sum(times.values()) == out.agg(F.max("slot")).first()[0] + 1


def test_mixing_edges(spark, odd):
    out = mixing.mix(clashing(odd), block=2, span=3).orderBy("slot", "place").collect()
    first = [r for r in out if r.epoch == 0]
    assert len(first) == odd.count() and {r.source for r in out} == {None, "a", "b", "c"}
    assert [r.slot for r in out[::2]] == list(range(len(out) // 2))
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(odd, block=2).collect()))
    share = {r["source"]: r["count"] ** mixing.SMOOTHING for r in odd.groupBy("source").count().collect()}
    done = Counter()
    for t, r in enumerate(out[::2], 1):
        done[r.source] += 1
        assert all(abs(done[s] - w / sum(share.values()) * t) < 1 for s, w in share.items())
    assert mixing.mix(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, weights={"a": 1})


def test_given_weights_are_kept_over_many_periods(spark):
    d = docs(spark, [(i, "t", "en", "a" if i < 10 else "b") for i in range(13)])
    out = mixing.mix(d, weights={"a": 0.999, "b": 0.001}, block=1).orderBy("slot").collect()
    assert [r.slot for r in out] == list(range(len(out))) and len(out) > 2000 and {r.doc_id for r in out} == set(range(13))
    done = 0
    for t, r in enumerate(out, 1):
        done += r.source == "b"
        assert abs(done - 0.001 * t) < 1


def test_more_sources_than_slots(spark):
    d = docs(spark, [(i, "t", "en", f"s{i % 1100}" if i % 1100 else None) for i in range(1200)])
    out = mixing.mix(d, block=1).collect()
    assert {r.doc_id for r in out} == set(range(1200)) and sorted(r.slot for r in out) == list(range(len(out)))


# WARC


def test_warc_edges(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://c", None), (4, "u", ""), (None, "n", "x"), (None, "n", "lone"), (5, "big", LONG), (6, "é", "ü"), (7, "d", "dup"), (7, "d", "dup")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    index = warc.write(clashing(pages), folder)
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(spark, folder).collect()]
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(1, "revisit", 2, "x"), (2, "response", None, "x"), (3, "revisit", 4, ""), (4, "response", None, ""), (None, "revisit", 2, "x"), (None, "response", None, "lone"), (5, "response", None, LONG), (6, "response", None, "ü"), (7, "response", None, "dup"), (7, "response", None, "dup")]
    assert sorted(map(str, got)) == sorted(str((i, k, r, len(t.encode()), sha(t))) for i, k, r, t in want)
    row = index.where("page_id = 6").first()
    headers, body, _ = warc.parse(warc.fetch(folder, row.bundle, row.frame, row.offset, row.length))
    assert body == "ü".encode() and headers["WARC-Type"] == "response"
    empty = scratch_path(spark, "warc-test")
    assert warc.write(pages.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_frames_are_dealt_out(spark):
    """Reading back is as many tasks as its bytes need; a payload that most pages have is no obstacle."""
    rows = [(i, f"u{i}", "" if i % 3 else hashlib.sha256(str(i).encode()).hexdigest() * 2000) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = scratch_path(spark, "warc-test")
    warc.write(pages, folder)
    out = warc.read(spark, folder)
    assert out.rdd.getNumPartitions() >= 3
    got = {r.page_id: (r.record_type, r.refers_to) for r in out.collect()}
    assert got == {i: ("revisit", 599) if i % 3 and i != 599 else ("response", None) for i in range(600)}


# token counts


def test_rollup_is_idempotent_and_exact(spark, odd):
    counted = tokens.with_token_counts(clashing(odd))
    enc = tokens.encoding(tokens.RANKS)
    counts = tokens.by_tokenizer(counted).cache()
    r = tokens.Rollup(spark, scratch_path(spark, "rollup-test"))
    assert r.totals().count() == 0
    assert r.commit("b1", tokens.inserts(counts)) and not r.commit("b1", tokens.inserts(counts))
    rows = [(x.source, x.lang, x.text or "") for x in odd.collect()]

    def want(rows):
        out = defaultdict(lambda: [0, 0, 0])
        for s, lang, t in rows:
            for name, n in ((tokens.BPE, len(enc.encode_ordinary(t))), (tokens.WORDS, len(t.split()))):
                for k, v in enumerate((1, n, len(t))):
                    out[s, lang, name][k] += v
        return {k: tuple(v) for k, v in out.items()}

    got = lambda: {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens, x.n_chars) for x in r.totals().collect()}
    assert got() == want(rows)
    gone = counts.where("source = 'a'")
    r.commit("b2", tokens.deletes(gone))
    r.commit("b2", tokens.deletes(gone))
    assert got() == want([x for x in rows if x[0] != "a"])
    old = counts.where("source = 'c'")
    r.commit("b3", tokens.revisions(old, old.withColumns({"n_tokens": F.col("n_tokens") + 5})))
    assert got()["c", "en", tokens.WORDS][1] == 2 + 5 and r.batches() == ["b1", "b2", "b3"]
    r.commit("b4", tokens.inserts(counts.limit(0)))
    assert r.committed("b4")
    with pytest.raises(ValueError):
        r.commit("../x", tokens.inserts(counts))


def test_one_of_two_writers_commits(spark, odd, monkeypatch):
    counts = tokens.by_tokenizer(tokens.with_token_counts(odd.withColumn("text_read", F.lit(1))))
    r = tokens.Rollup(spark, scratch_path(spark, "rollup-test"))
    monkeypatch.setattr(tokens.Rollup, "committed", lambda self, batch_id: False)
    assert r.commit("b", tokens.inserts(counts)) and not r.commit("b", tokens.deletes(counts))
    assert r.totals().agg(F.sum("n_docs")).first()[0] == 2 * odd.count() and r.batches() == ["b"]
    none = tokens.Rollup(spark, scratch_path(spark, "rollup-test"))
    none.commit("b", tokens.inserts(tokens.by_tokenizer(tokens.with_token_counts(odd.limit(0)))))
    assert none.totals().count() == 0 and none.batches() == ["b"]


def test_op5_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    enc = tokens.encoding(tokens.RANKS)
    toxic, quality = {}, {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        toxic[r.doc_id], quality[r.doc_id] = r.toxic, r.quality
    want = defaultdict(lambda: [0, 0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if toxic.get(r.doc_id) == 1:
            continue
        t = re.sub(r"\s+", " ", r.text).strip(" ") if quality.get(r.doc_id) == 0 else r.text
        for name, n in ((tokens.BPE, len(enc.encode_ordinary(t))), (tokens.WORDS, len(t.split()))):
            for k, v in enumerate((1, n, len(t))):
                want[r.source, r.lang, name][k] += v
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens, r.n_chars] for r in queries.op5_token_rollup(spark, sf).collect()}
    assert got == dict(want)


# fingerprints


def test_edited_digests_equal_brute_force(spark, odd):
    for d in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), clashing(odd), odd.where("doc_id = 4 and source = 'a'")):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in d.collect()))
        want = []
        for k, (known, i, t) in enumerate(rows):
            nxt = rows[(k + 1) % len(rows)][2]
            e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
            f = digest.fingerprint
            want.append((i if known else None, len(t), hashlib.sha256(e.encode()).hexdigest(), f(t), f(e), digest.likeness(f(t), f(e)), digest.likeness(f(t), f(nxt))))
        assert sorted(map(str, map(tuple, digest.edited_digests(d).collect()))) == sorted(map(str, want))
    assert digest.edited_digests(odd.limit(0)).count() == 0 and digest.fingerprints(odd).count() == odd.count()


# pages


def test_main_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html.fit(pages)
    got = {r.page_id: r.text for r in html.main_text(clashing(pages), model).collect()}
    for r in pages.collect():
        assert got[r.page_id] == "\n\n".join(b.text for b in html.blocks(r.html) if any(t == "article" for t, _ in b.chain))
    other = """<body><div id="masthead"><h2>The Site</h2></div><div class="cookie-banner"><p>We use cookies, and you must accept them now.</p></div>
    <div class="post"><h1>Title here</h1><p>A first paragraph that says something, and then some more.</p><div class="ad-box"><p>Buy this thing today. It is very good.</p></div><p>A second paragraph that goes on for a while.</p></div>
    <div class="comments"><p>I liked this a lot. Thank you for writing all of it.</p></div><form><label>Search</label></form><footer>(c) The Site</footer></body>"""
    text = html.extract(other, model)
    assert text == "Title here\n\nA first paragraph that says something, and then some more.\n\nA second paragraph that goes on for a while."


@pytest.mark.parametrize("trained", [True, False], ids=["trained on pages", "trained without a page"])
def test_main_text_of_held_out_layouts(trained):
    """Fourteen layouts without article or main, whose makers the extractor has not seen."""
    import layouts

    given = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    model = html.train(html.labelled_pages(given if trained else []))
    articles = []
    for page in pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()[300:330]:
        found = [b.text for b in html.blocks(page) if any(t == "article" for t, _ in b.chain)]
        articles.append((found[0], found[1:9]))
    scores = defaultdict(list)
    for nth, page, want in layouts.made(articles):
        scores[nth].append(layouts.token_f1(html.extract(page, model), want))
    assert len(scores) == 14 and np.mean([x for v in scores.values() for x in v]) > 0.97
    assert sum(np.mean(v) > 0.95 for v in scores.values()) >= 12


def test_markup_that_tells(spark):
    """Titles in an article's header belong to it; what encloses the article does not matter."""
    page = html.blocks('<body class="sidebar"><main class="two-column right"><header>The Site</header><p>One.</p><div class="comments"><p>Two.</p></div></main><nav>Three</nav></body>')
    assert html.labelled_by_structure(page) == [0, 1, 0, 0]
    page = html.blocks("<header>The Site</header><article><header><h1>Title</h1></header><p>One.</p><footer>By me</footer></article>")
    assert html.labelled_by_structure(page) == [0, 1, 1, 0]
    assert html.labelled_by_structure(html.blocks("<div><p>One.</p></div>")) is None


def test_a_table_without_labelled_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<nav><a>Home</a></nav><div class='post'><p>The council met on Tuesday, and it was agreed that the bridge should be built.</p></div>")], "page_id long, url string, html string")
    assert html.main_text(pages).first().text == "The council met on Tuesday, and it was agreed that the bridge should be built."


def test_main_text_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "n", "<p>x"), (3, "u", "<article><p>" + LONG + "</article>"), (3, "u", "<article><p>" + LONG + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.main_text(clashing(df)).collect()
    assert len(got) == 5 and [r.n_chars for r in got if r.page_id in (1, 2)] == [0, 0] and [r.n_chars for r in got if r.page_id == 3] == [len(LONG)] * 2
    assert html.main_text(df.limit(0)).count() == 0


# pipeline


def test_pipeline_stages_against_brute_force(spark):
    """Every stage, and the whole, against plain Python that shares nothing with the operators."""
    import corpus_pipeline as P
    import plain

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    items = [plain.word_list(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in d.collect()}
    texts = {i: r.text for i, r in rows.items()}
    assert len(texts) == d.count()

    told = plain.languages([(r.text, r.lang) for r in rows.values()], texts.values())
    want = {"language_id": {i: t for (i, t), (lang, score) in zip(texts.items(), told, strict=True) if lang != "und" and score >= 0.5}}
    label = plain.classes(sorted(want["language_id"].items()))
    want["near_dedup"] = {i: t for i, t in want["language_id"].items() if label[i] == i}
    cut = plain_cuts(want["near_dedup"].items())
    want["substring_dedup"] = {i: t for i, t in cut.items() if t == texts[i] or t.strip()}
    want["decontamination"] = {i: t for i, t in want["substring_dedup"].items() if not any(plain.contains(x, plain.word_list(t)) for x in items)}
    assert all(len(a) > len(b) for a, b in ((want["language_id"], want["near_dedup"]), (want["substring_dedup"], want["decontamination"])))

    at = d
    for name, stage in P.STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, at, sf).write.parquet(path)
        at = spark.read.parquet(path)
        assert at.columns == d.columns
        got = {r.doc_id: r for r in at.collect()}
        assert {i: r.text for i, r in got.items()} == want[name], name
        assert all((r.lang, r.source) == (rows[i].lang, rows[i].source) and r.n_chars == len(r.text) for i, r in got.items())
    kept = [(i, rows[i].source) for i in want["decontamination"]]
    weight = {s: n**mixing.SMOOTHING for s, n in Counter(s for _, s in kept).items()}
    final = sorted((r.slot, r.place, r.doc_id, r.source, r.block, r.epoch) for r in P.run(spark, sf).collect())
    assert final == sorted(plain.stream(kept, weight, mixing.BLOCK))


def test_pipeline_edges(spark, odd):
    """Nulls, repeated rows, versions, clashing names, empty tables: each stage gives what its docstring says."""
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    table = clashing(odd)
    ids = lambda df: sorted(r.doc_id or 0 for r in df.collect())
    got = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns
        got[name] = ids(out)
    assert got["language_id"] == [0, 3, 4, 5, 5, 6, 6, 9] and got["near_dedup"] == [0, 1, 2, 3, 4, 7, 9]
    assert got["substring_dedup"] == [0, 1, 2, 3, 4, 5, 5, 7, 8, 9] and got["decontamination"] == ids(table)
    shown = [r for r in P.mix_sources(spark, table, sf).collect() if r.epoch == 0]
    assert sorted(r.doc_id or 0 for r in shown) == ids(table)
    assert all(stage(spark, table.limit(0), sf).count() == 0 for _, stage in P.STAGES)


def test_languages_equal_plain_naive_bayes(spark):
    import plain

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.out) for r in d.select("*", langid.held_out().alias("out")).collect()]
    want = dict(zip((r[0] for r in rows), plain.languages([(t, lang) for _, t, lang, out in rows if not out], [r[1] for r in rows]), strict=True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-6 for i in got)


def test_digests_equal_plain_counting(spark):
    import plain

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [None, "", "a", "ab", "abc", "ü" * 50]
    assert [digest.fingerprint(t) for t in texts] == [plain.quartile_digest(t) for t in texts]


def test_windows_without_an_anchor_hold_no_match(spark, monkeypatch):
    """Looking at all item-sized windows finds no more than looking at those that the bound allows."""
    sf = "/root/testdata/sf0.001"
    items = decontam.prepare([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 0.2)
    texts = sorted((r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=len)
    texts = [t for t in texts if decontam.find([t], items)][:8] + texts[40:60:4]
    few = {hit[:3] for hit in decontam.find(texts, items)}

    def every(flat, begin, end, owner, items):
        lengths = sorted({h.size for h in items.hashes})
        return np.tile(np.arange(flat.size), len(lengths)), np.repeat(np.array(lengths), flat.size)

    monkeypatch.setattr(decontam, "windows", every)
    assert {hit[:3] for hit in decontam.find(texts, items)} == few and few
