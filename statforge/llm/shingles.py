"""Word shingles of whole texts as 64-bit hashes, worked out for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import utf8_column

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(powers[0]) <= n:
        for i, b in enumerate((BASE, INVERSE)):
            full = np.full(n + 1, U(b))
            full[0] = 1
            powers[i] = np.multiply.accumulate(full)
    return powers


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z lower-cased, and the
    index of each text's first word (one more at the end)."""
    flat, offsets = utf8_column(column)
    docs = len(offsets) - 1
    text = np.full(len(flat) + docs + 1, 32, np.uint8)
    text[1 + np.arange(len(flat)) + np.repeat(np.arange(docs), np.diff(offsets))] = LOWER[flat]
    space = SPACE[text]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    if len(ends) < len(starts):
        ends = np.append(ends, len(text))
    power, inverse = power_tables(len(text))
    sums = np.zeros(len(text) + 1, U)
    np.cumsum((text.astype(U) + U(1)) * power[: len(text)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] ^ (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, np.arange(docs + 1) + offsets + 1)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's set of k-word shingles as sorted distinct hashes; a text of fewer words
    is one shingle, a text without words has none."""
    words, first = word_hashes(column)
    m = max(0, len(words) - k + 1)
    h = np.full(m, U(k))
    for i in range(k):
        h = mix((h ^ words[i : i + m]) * U(0x9FB21C651E98DF25))
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            x = np.full(1, U(b - a))
            for w in words[a:b]:
                x = mix((x ^ w) * U(0x9FB21C651E98DF25))
            out.append(x)
        else:
            out.append(np.zeros(0, U))
    return out
