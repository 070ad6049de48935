"""Vectorised kernels over the UTF-8 bytes of Arrow text columns.

Every Python-side operator of this subpackage works on the byte buffer of a
whole Arrow column at once.  A batch is cut into runs of whole documents of
about ``CHUNK`` bytes so that scratch arrays stay in cache and memory stays
bounded; a document longer than that is a run of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[0x80:] = True

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalising bijection on uint64 (every input bit reaches every output bit)."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def text_column(column: pa.Array, lower: bool) -> pa.Array:
    """A null text counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def runs(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets) for runs of whole documents."""
    if len(column) == 0:
        return
    column = text_column(column, lower)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first, n = 0, len(column)
    while first < n:
        after = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        after = min(max(after, first + 1), n)
        lo, hi = int(offsets[first]), int(offsets[after])
        yield first, after, raw[lo:hi], offsets[first : after + 1] - lo
        first = after


class Hasher:
    """Polynomial hashes of arbitrary byte ranges from one prefix sum."""

    def __init__(self) -> None:
        self._up = np.ones(1, np.uint64)
        self._down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._up) <= n:
            size = 1 << int(n + 1).bit_length()
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, _BASE_INV, np.uint64)
            up[0] = down[0] = 1
            self._up, self._down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        self._grow(len(raw) + 1)
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._up[: len(raw)], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((sums[end] - sums[start]) * self._down[start])


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (one more entry at the end).

    Letters, digits and all bytes outside ASCII make words; no word crosses a document's border.
    """
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    begin[offsets[filled]] = inside[offsets[filled]]
    stop[offsets[filled + 1] - 1] = inside[offsets[filled + 1] - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, offsets)


def lower_words(text: str) -> list[str]:
    """The words of one text, as word_spans sees them (for tests and small fixtures)."""
    raw = np.frombuffer(text_column(pa.array([text]), True)[0].as_py().encode(), np.uint8)
    start, end, _ = word_spans(raw, np.array([0, len(raw)]))
    return [raw[a:b].tobytes().decode() for a, b in zip(start, end)]


class HashTable:
    """Open-addressing lookup of uint64 keys, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray, spread: int = 1) -> None:
        """spread: powers of two of free slots; more for a table that most lookups miss."""
        keys = np.asarray(keys, np.uint64)
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + spread)
        size = 1 << self.bits
        self.slot_key = np.zeros(size, np.uint64)
        self.slot_id = np.full(size, -1, np.int32)
        self.probes = 0
        rest = np.arange(len(keys), dtype=np.int32)
        at = self._home(keys)
        while len(rest):
            self.probes += 1
            slot = at[rest]
            free = self.slot_id[slot] < 0
            slot_f, rest_f = slot[free], rest[free]
            self.slot_id[slot_f] = rest_f  # of several for one slot the last stays
            won = self.slot_id[slot_f] == rest_f
            self.slot_key[slot_f[won]] = keys[rest_f[won]]
            rest = np.concatenate([rest[~free], rest_f[~won]])
            at[rest] = (at[rest] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key in the array given at the start, -1 if it wasn't there."""
        at = self._home(keys)
        found = self.slot_id[at]
        hit = self.slot_key[at] == keys
        out = np.where(hit, found, -1).astype(np.int32)
        rest = np.flatnonzero(~hit & (found >= 0))
        for _ in range(self.probes):
            if not len(rest):
                break
            at_r = (at[rest] + 1) & (len(self.slot_key) - 1)
            at[rest] = at_r
            found_r = self.slot_id[at_r]
            hit_r = (self.slot_key[at_r] == keys[rest]) & (found_r >= 0)
            out[rest[hit_r]] = found_r[hit_r]
            rest = rest[~hit_r & (found_r >= 0)]
        return out
