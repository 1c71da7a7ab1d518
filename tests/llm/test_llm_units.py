"""Edge cases and brute force for the parts that need no Spark."""

import random
import re
from itertools import islice

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymark.llm import chat, decontam, digest, html, langid, linededup, mixing, neardup, warc, words


@given(st.text(alphabet="<|\\im_end>a\n", max_size=40))
def test_escape_is_reversible_and_hides_controls(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and "<|" not in escaped


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", None]), st.one_of(st.none(), st.text(alphabet="<|im_start>é \n😀", max_size=20))), max_size=5))
def test_chat_round_trip(turns):
    text, spans = chat.render(turns, frozenset(["assistant"]))
    assert chat.parse(text) == [(r or "", t or "") for r, t in turns]
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t or "" for r, t in turns if r == "assistant"]
    enc = chat.tokenizer(chat.TOKENIZER).encode(text, add_special_tokens=False)
    off = np.array(enc.offsets).reshape(-1, 2)
    mask = chat.mask_tokens(off[:, 0], off[:, 1], spans)
    said = [chat.unescape(text[a:b]) for a, b in chat.masked_spans(off[:, 0], off[:, 1], mask)]
    assert said == [t for r, t in turns if r == "assistant" and t]


def test_words_match_a_plain_pattern():
    text = "Ünï-code’s TEXT, x1 𠀀𠀁 __a\n\tİb " + "z" * 5000
    starts, ends, hashes = words.words(text)
    assert [(a, b) for a, b in zip(starts, ends)] == [m.span() for m in re.finditer(r"[^\W_]+", text)]
    assert words.words("TEXT")[2][0] == words.words("text")[2][0] == hashes[3]
    many = list(words.words_of(["a b", None, "", "b " * 40_000, "c"]))
    assert [len(h) for _, _, h in many] == [2, 0, 0, 40_000, 1] and many[0][2][1] == many[3][2][5]


def test_langid_pieces_do_not_change_sums(monkeypatch):
    text = "Voilà, un long texte! 123 " * 500
    whole = np.sort(np.concatenate([b for b, _ in langid.gram_parts([text, None, "?!", "ab"], 16)]))
    monkeypatch.setattr(langid, "PIECE", 97)
    assert (whole == np.sort(np.concatenate([b for b, _ in langid.gram_parts([text, None, "?!", "ab"], 16)]))).all()


def test_langid_equals_plain_naive_bayes():
    rng = np.random.default_rng(0)
    model = langid.Model(("a", "b"), np.log(rng.random((1 << 10, 2))), np.log([0.3, 0.7]))
    texts = ["hello world", "x", None, "...", "Ärger über"]
    names, scores = langid.score(model, texts)
    for text, name, score in zip(texts, names, scores):
        sums = model.prior.copy()
        for buckets, _ in langid.gram_parts([text], 10):
            for b in buckets:
                sums = sums + model.matrix[b]
        if not text or not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0)
        else:
            p = np.exp(sums - sums.max())
            assert name == model.languages[sums.argmax()] and score == pytest.approx((p / p.sum()).max())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_equals_plain_dynamic_programming():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randint(0, 9) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randint(0, 1)] = [rng.randint(0, 9)] * rng.randint(0, 1)
        m = lcs(a, b)
        want = m / (len(a) + len(b) - m) if b else 0.0
        got = neardup.aligned_similarity(np.array(a), np.array(b, dtype=int), 0.6)
        assert got == pytest.approx(want if want >= 0.6 else 0.0)


def test_order_minhash_follows_order_not_sets():
    base = words.mix(np.arange(200, dtype=np.uint64))
    moved = np.concatenate((base[100:], base[:100]))
    edited = base.copy()
    edited[50] = 7
    agree = lambda x: (neardup.order_minhash(base, 200) == neardup.order_minhash(x, 200)).mean()
    assert agree(edited) > 0.95 and agree(moved) < 0.8
    assert neardup.order_minhash(base[:1], 5).size == 5


def edits(item, text):
    """Least edits of the item against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_search_equals_plain_dynamic_programming():
    rng = random.Random(5)
    for _ in range(300):
        item = np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 12))], dtype=np.uint64)
        text = np.array([rng.randint(0, 5) for _ in range(rng.randint(0, 30))], dtype=np.uint64)
        want = edits(item.tolist(), text.tolist())
        got = decontam.search(item, text, 3)
        assert (got is None) == (want > 3)
        if got:
            assert got[0] == want == edits(item.tolist(), text[got[1] : got[2]].tolist())


def test_decontamination_recall_at_the_bound():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 70)))) for i in range(60)]
    index = decontam.prepare(items, 0.2)
    found = total = 0
    for i, text in items:
        for _ in range(5):
            w = text.split()
            for _ in range(decontam.allowed(len(w), 0.2)):
                p = rng.randrange(len(w))
                rng.choice([lambda: w.__setitem__(p, "zz"), lambda: w.pop(p) if len(w) > 1 else None, lambda: w.insert(p, "qq")])()
            doc = " ".join(rng.choices(vocab, k=100) + w + rng.choices(vocab, k=100))
            total += 1
            found += any(index.ids[h[1]] == i for h in decontam.find([doc], index))
    assert found / total >= 0.99


def test_decontamination_edges():
    index = decontam.prepare([(1, "one two three"), (2, ""), (3, "...")], 0.2)
    assert decontam.find(["ONE, two; three!", None, "", "one two four"], index) == [(0, 0, 0, 3, 0, 15)]
    assert decontam.find(["a b c"], decontam.prepare([], 0.2)) == []


def plain_paragraphs(text, least):
    """Paragraphs by a plain reading: (start, end, words)."""
    found = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text)]
    begins = [i for i in range(len(found)) if i == 0 or re.search(r"[^ '’-]", text[found[i - 1][1] : found[i][0]])]
    out = []
    for i in begins:
        for j in [*begins, len(found)]:
            if j - i >= least:
                out.append((found[i][0], found[j][0] if j < len(found) else len(text), tuple(w for _, _, w in found[i:j])))
                break
    return out


def test_paragraphs_equal_a_plain_reading():
    rng = random.Random(4)
    digests = {}
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "Cc", "é"]) + rng.choice([" ", " ", ", ", ". ", "! ", "\n", " – "]) for _ in range(rng.randint(0, 60))) + rng.choice(["", "end", "...x"])
        want = plain_paragraphs(text, 5)
        starts, ends, digest_ = linededup.paragraphs(text, *words.words(text), 5)
        assert [(a, b) for a, b, _ in want] == list(zip(starts, ends))
        for (_, _, w), d in zip(want, digest_.tolist()):
            assert digests.setdefault(w, d) == d
    assert len(set(digests.values())) == len(digests)


def test_cuts():
    assert linededup.merged([(0, 3), (2, 5), (5, 6), (8, 9)]) == [(0, 6), (8, 9)]
    assert linededup.cut("abcdefghij", [(0, 2), (4, 6)]) == "cdghij" and linededup.cut("ab", []) == "ab"


def test_spans_join_to_one_walk():
    rng = random.Random(3)
    kinds = [lambda: rng.randint(1, 5), lambda: rng.random() ** 6 + 1e-7, lambda: 1, lambda: 10 ** rng.randint(0, 4)]
    for trial in range(120):
        weights = mixing.whole([kinds[trial % 4]() for _ in range(rng.randint(1, 12))])
        blocks = [max(1, min(40, 2_000 * w // sum(weights))) for w in weights]
        one, span = list(islice(mixing.dealt(weights, blocks), 2_000)), rng.choice([1, 3, 7, 50])
        low, out = [-1] * len(weights), []
        for at in range(0, 2_000, span):
            done = mixing.begun(weights, at, low)
            assert sum(done) == at
            out += mixing.dealt(weights, blocks, done, at, at + span)
            low = list(map(max, low, mixing.lows(weights, at, at + span)))
        assert out[:2_000] == one
    with pytest.raises(ValueError):
        mixing.whole([0])


def test_unlike_sources_stay_within_a_block_of_their_weights():
    weights = mixing.whole([n**mixing.SMOOTHING for n in (10**6, 10**4, 100, 1)])
    total, done = sum(weights), [0] * 4
    # Twenty times as many slots as the rarest but one source needs for a block.
    for t, (k, _) in enumerate(islice(mixing.dealt(weights, [1 << 40] * 4), 20 * total // weights[2]), 1):
        done[k] += 1
        assert all(abs(n * total - w * t) < total for n, w in zip(done, weights))


def test_dealt_lag_is_below_one_block_of_the_weights():
    rng = random.Random(1)
    cases = [[0.999, 0.001], [0.3] + [0.7 / 19] * 19, [1.0] * 1500] + [[rng.random() ** 3 + 1e-6 for _ in range(rng.randint(1, 30))] for _ in range(10)]
    for weights in cases:
        total, done = sum(map(mixing.Fraction, weights)), [0] * len(weights)
        exact = [float(mixing.Fraction(w) / total) for w in weights]
        slots = 0
        for t, (k, b) in enumerate(mixing.dealt(weights, [6_000] + [0] * (len(weights) - 1)), 1):
            assert b == done[k]
            done[k] += 1
            slots = t
            if len(weights) < 100 or t % 1000 == 0:
                assert all(abs(n - w * t) < 1 + 1e-6 for n, w in zip(done, exact))
            if t == 12_000:
                break
        assert slots >= 6_000


def test_digest():
    assert digest.fingerprint(None) == digest.fingerprint("") == "0" * 66
    text = "the quick brown fox jumps over the lazy dog " * 40
    a, b = digest.fingerprint(text), digest.fingerprint(text[:-200] + "x" * 200)
    assert digest.likeness(a, a) == 1 and 0 <= digest.likeness(a, digest.fingerprint("zzz")) < digest.likeness(a, b) <= 1
    data = text.encode()
    plain = np.zeros(digest.BUCKETS, dtype=int)
    for i in range(len(data) - 2):
        plain[((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 25] += 1
    assert (plain == digest.counts(data)).all()


def test_digest_pieces(monkeypatch):
    data = bytes(range(256)) * 10
    whole = digest.counts(data)
    monkeypatch.setattr(digest, "PIECE", 7)
    assert (whole == digest.counts(data)).all()


def test_warc_record_round_trip():
    for payload, url, refers in ((b"", None, None), ("é\r\n\r\nWARC/1.1".encode(), "http://x/a b\r\n", None), (b"x", "u", 9)):
        data = warc.record(5, url, payload, refers)
        headers, body, end = warc.parse(data + b"rest")
        assert end == len(data) and warc.fields(headers, body)[:3] == (5, len(payload), warc.digest(payload))
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_seekable_bundle(tmp_path):
    import zstandard

    with open(tmp_path / "x", "wb") as f:
        b = warc.Bundle(f)
        places = [b.add(bytes([i]) * 400_000) for i in range(6)]
        b.close()
    assert places[0] == (0, 0) and places[-1][0] >= 2
    data = (tmp_path / "x").read_bytes()
    frames = warc.read_seek_table(data)
    assert sum(d for _, d in frames) == 2_400_000
    whole = b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + c], max_output_size=d) for a, (c, d) in zip(np.cumsum([0] + [c for c, _ in frames]).tolist(), frames))
    assert whole == b"".join(bytes([i]) * 400_000 for i in range(6))


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>
<article><h1>A  title</h1><p><b>First &amp; foremost.<br><p>Second&nbsp;one, <a href="a>b">link</a> and more words here to read.</article>
<script>var x = "</p>";</script><footer>&copy; Someone</footer>"""


def test_blocks_of_badly_nested_pages():
    assert [b.text for b in html.blocks(PAGE)] == ["Home", "News", "A title", "First & foremost.", "Second one, link and more words here to read.", "© Someone"]
    assert html.blocks(None) == html.blocks("") == html.blocks("<!-- never ends") == []
    assert [b.text for b in html.blocks("a < b <p>c &am")] == ["a < b", "c &am"]
    assert [b.text for b in html.blocks("<p>x<b>" * 20_000)] == ["x"] * 20_000


def test_insets_take_no_article_text():
    read = lambda page: [b.text for b in html.blocks(page)]
    for tag in ("svg", "math"):
        assert read(f"<article><p>One<{tag} class='i'/> two<p>Three<{tag}></{tag}></article>") == ["One two", "Three"]
    for tag in sorted(html.INSET):
        assert read(f"<p>One<{tag} id=x>two<p>Three<p>Four") == ["Onetwo", "Three", "Four"]
        assert read(f"<p>One<{tag}>two<p>Three<{tag}>no</{tag}> four<p>Five") == ["Onetwo", "Three four", "Five"]
        assert read(f"<p>One <{tag}>no<{tag}>no</{tag}>no</{tag}> two<script>'</{tag}><{tag}>'</script> three") == ["One two three"]
    assert read("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds") == ["So x=2 holds"]
    assert len(read("<p>x<video>" * 20_000)) == 20_000


def test_crf_learns_and_decodes_like_enumeration():
    rng = random.Random(0)
    pages = [([[f"f{rng.randint(0, 1)}" if rng.random() < 0.1 else f"f{y}", "bias"] for y in ys], ys) for ys in ([0] * rng.randint(1, 4) + [1] * rng.randint(1, 6) + [0] * rng.randint(0, 3) for _ in range(60))]
    model = html.train(pages, epochs=4)
    assert model.weights["f1"] > model.weights["f0"]
    for _ in range(50):
        scores = [rng.uniform(-3, 3) for _ in range(6)]
        best = max(range(64), key=lambda m: sum(s for i, s in enumerate(scores) if m >> i & 1) + sum(model.steps[2 * (m >> i & 1) + (m >> (i + 1) & 1)] for i in range(5)))
        assert model.decode(scores) == [best >> i & 1 for i in range(6)]


def test_marginals_sum_to_enumeration():
    emit, step = np.array([0.3, -1.0, 2.0]), np.array([[0.1, -0.2], [0.4, 0.5]])
    weight = {}
    for m in range(8):
        y = [m >> i & 1 for i in range(3)]
        weight[m] = np.exp(sum(e for e, v in zip(emit, y) if v) + sum(step[y[i], y[i + 1]] for i in range(2)))
    total = sum(weight.values())
    on, pairs = html.marginals(emit, step)
    assert on == pytest.approx([sum(w for m, w in weight.items() if m >> i & 1) / total for i in range(3)])
    assert pairs.sum() == pytest.approx(2)
