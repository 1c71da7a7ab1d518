"""Words of a text as numpy arrays: code point spans and 64-bit hashes.

A word is a maximal run of letters and digits, compared without regard to
case. Spans are code point offsets in the text as given, so nothing that is
found by hash loses its place. Work and memory are linear in one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Code points with a table entry; the ideographs beyond are word characters.
TABLE = 0x20000
BEYOND = 0x40000
POWERS = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word characters, letters, lower case, and powers for polynomial hashes."""
    chars = [chr(i) for i in range(TABLE)]
    word = np.array([c.isalnum() for c in chars])
    letter = np.array([c.isalpha() for c in chars])
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], dtype=np.uint32)
    powers = np.cumprod(np.full(POWERS, 0x100000001B3, dtype=np.uint64), dtype=np.uint64)
    return word, letter, lower, powers


def code_points(text: str) -> np.ndarray:
    """The text's code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def lowered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points, and which are word characters and letters."""
    word, letter, lower, _ = tables()
    near = np.minimum(codes, TABLE - 1)
    low, is_word, is_letter = lower[near], word[near], letter[near]
    if codes.size and codes.max() >= TABLE:
        far = codes >= TABLE
        low = np.where(far, codes, low)
        is_word = np.where(far, codes < BEYOND, is_word)
        is_letter = np.where(far, codes < BEYOND, is_letter)
    return low, is_word, is_letter


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of the text."""
    low, is_word, _ = lowered(code_points(text))
    at = np.flatnonzero(is_word)
    if not at.size:
        return at, at, np.empty(0, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    last = np.append(first[1:], at.size) - 1
    inside = np.arange(at.size) - np.repeat(first, last - first + 1)
    terms = (low[at].astype(np.uint64) + np.uint64(1)) * tables()[3][inside % POWERS]
    return at[first], at[last] + 1, mix(np.add.reduceat(terms, first))


def words_of(texts: list[str | None], together: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`words` of each text; short texts are read together, nulls have no words."""
    held: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1]) + 1
        if size >= together or i == len(texts) - 1:
            starts, ends, hashes = words("\n".join(held))
            offsets = np.cumsum([0] + [len(t) + 1 for t in held])
            cuts = np.searchsorted(starts, offsets)
            for at, a, b in zip(offsets.tolist(), cuts.tolist(), cuts[1:].tolist()):
                yield starts[a:b] - at, ends[a:b] - at, hashes[a:b]
            held, size = [], 0


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of each run of k words; of all words together if there are fewer."""
    if not hashes.size:
        return hashes
    k = min(k, hashes.size)
    n = hashes.size - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = (out + hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1)
    return mix(out)


def occurrence_labelled(values: np.ndarray) -> np.ndarray:
    """Each value mixed with how many equal ones stand before it."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if ranked.size else np.empty(0, dtype=bool)
    place = np.arange(ranked.size)
    nth = np.empty(ranked.size, dtype=np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return mix(values + nth * np.uint64(0x9E3779B97F4A7C15))
