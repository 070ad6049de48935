"""MinHash signatures of word shingles, for whole Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textbytes import Hasher, mix64, runs, word_spans

_ODD = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint32(0xFFFFFFFF)


def coefficients(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive words of a document; a shorter document is one shingle of all its words.

    first: index of each document's first word, and the number of words at the end.  Returns the hashes and each document's first one.
    """
    n = len(words)
    grams = np.zeros(n, np.uint64)
    last = np.repeat(first[1:], np.diff(first))  # index after the document's last word
    at = np.arange(n)
    for j in range(width):
        inside = at + j < last
        grams[inside] = grams[inside] * _ODD + words[(at + j)[inside]]
    starts_whole = at + width <= last
    starts_short = (np.repeat(np.diff(first), np.diff(first)) < width) & (at == np.repeat(first[:-1], np.diff(first)))
    valid = starts_whole | starts_short
    return mix64(grams[valid]), np.concatenate([[0], np.cumsum(valid)])[first]


def signatures(column: pa.Array, k: int, width: int, seed: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(documents x k) uint32 minima, and whether the document has a word at all (else its row holds EMPTY)."""
    a, b = coefficients(k, seed)
    out = np.full((len(column), k), EMPTY, np.uint32)
    filled = np.zeros(len(column), bool)
    for start, after, raw, offsets in runs(column):
        begin, end, first = word_spans(raw, offsets)
        if not len(begin):
            continue
        grams, cut = shingle_hashes(hasher.spans(hasher.prefix(raw), begin, end), first, width)
        high = (grams >> np.uint64(32)).astype(np.uint32)
        some = np.flatnonzero(np.diff(cut) > 0)
        scratch = np.empty_like(high)
        block = np.empty((len(some), k), np.uint32)
        for j in range(k):
            np.multiply(high, a[j], out=scratch)
            np.add(scratch, b[j], out=scratch)
            block[:, j] = np.minimum.reduceat(scratch, cut[some])
        out[start + some] = block
        filled[start + some] = True
    return out, filled
