"""The corpus operators once more, in plain Python without numpy or Spark: slow, and nothing shared with them."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

M64 = (1 << 64) - 1
WORD = re.compile(r"[^\W_]+")


def word_list(text):
    return [w.lower() for w in WORD.findall(text or "")]


# language


def gram_counts(text, bits):
    """Buckets of the text's 1- to 3-grams of letters."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
    spaced = " ".join("".join(c if c.isalpha() else " " for c in low).split())
    if not spaced:
        return Counter()
    chars = [ord(c) for c in f" {spaced} "]
    out = Counter()
    for i in range(len(chars)):
        h = 0
        for n in (1, 2, 3):
            if i + n > len(chars):
                break
            h = ((h + chars[i + n - 1]) * 0x9E3779B97F4A7C15 + n) & M64
            h ^= h >> 29
            if n > 1 or chars[i] != 32:
                out[((h * 0xBF58476D1CE4E5B9) & M64) >> (64 - bits)] += 1
    return out


def languages(train, texts, bits=16, smoothing=0.5):
    """(language, posterior) of each text by naive Bayes fitted on (text, language) rows."""
    counts, docs = {}, Counter()
    for text, lang in train:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(gram_counts(text, bits))
            docs[lang] += 1
    total = {lang: sum(c.values()) + smoothing * (1 << bits) for lang, c in counts.items()}
    out = []
    for text in texts:
        grams = gram_counts(text, bits)
        if not grams or not docs:
            out.append(("und", 0.0))
            continue
        score = {lang: math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((c[b] + smoothing) / total[lang]) for b, n in grams.items()) for lang, c in sorted(counts.items())}
        best = max(score, key=score.get)
        out.append((best, 1 / sum(math.exp(s - score[best]) for s in score.values())))
    return out


# near-duplicates


def similarity(a, b):
    """M / (n + m - M) for the longest common subsequence of words."""
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / (len(a) + len(b) - row[-1])


def classes(rows, least=0.8):
    """The least id of each row's class of near-duplicates; rows are (id, text)."""
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    words = {i: word_list(t) for i, t in rows}
    bags = {i: Counter(w) for i, w in words.items()}
    text = dict(rows)
    for i, _ in rows:
        for j, _ in rows:
            if i >= j or text[i] is None or text[j] is None or root(i) == root(j):
                continue
            a, b = words[i], words[j]
            shared = (bags[i] & bags[j]).total()
            same = a == b and (a or text[i] == text[j])
            if same or (shared and shared / (len(a) + len(b) - shared) >= least and similarity(a, b) >= least):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


# benchmark


def contains(item, text, share=0.2):
    """Whether some stretch of the text is the item but for that share of word edits."""
    if not item:
        return False
    most = int(len(item) * share + 1e-9)
    if sum((Counter(item) & Counter(text)).values()) < len(item) - most:
        return False
    row = list(range(len(item) + 1))
    for y in text:
        above, row[0] = row[0], 0
        for j, x in enumerate(item, 1):
            above, row[j] = row[j], min(above + (x != y), row[j] + 1, row[j - 1] + 1)
        if row[-1] <= most:
            return True
    return False


# mixing


def stream(docs, weight, block):
    """(slot, place, id, source, block, epoch) by earliest deadline first; docs are (id, source), weight maps sources."""
    total = sum(Fraction(w) for w in weight.values())
    of = {s: Fraction(w) / total for s, w in weight.items()}
    order = {s: sorted((i for i, x in docs if x == s), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)) for s in weight}
    names = sorted(weight, key=lambda s: (s is not None, s))
    done, out, slot = dict.fromkeys(names, 0), [], 0
    while any(done[s] * block < len(order[s]) for s in names):
        ready = [s for s in names if done[s] / of[s] < slot + 1]
        best = min(ready, key=lambda s: (math.ceil((done[s] + 1) / of[s]), names.index(s)))
        for place in range(block):
            n = done[best] * block + place
            out.append((slot, place, order[best][n % len(order[best])], best, done[best], n // len(order[best])))
        done[best] += 1
        slot += 1
    return out


# fingerprints


def quartile_digest(text):
    """66 hexadecimal digits: a length byte, then two bits for each of 128 buckets of byte triplets."""
    data = (text or "").encode()
    if not data:
        return "0" * 66
    counts = [0] * 128
    for a, b, c in zip(data, data[1:], data[2:]):
        counts[((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 25] += 1
    ranked = sorted(counts)
    marks = [ranked[31], ranked[63], ranked[95]]
    bits = "".join(f"{sum(n > q for q in marks):02b}" for n in counts)
    return f"{min(255, round(8 * math.log2(1 + len(data)))):02x}{int(bits, 2):064x}"
