"""Words of whole Arrow columns of texts, found and hashed with numpy.

A word's 64-bit hash is a polynomial over its bytes: prefix sums over a stretch of bytes give
the hash of every word in it at once, whatever its length. Words count as equal if their
hashes are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are worked on at once.
STRETCH = 1 << 19

#: Separators of the two kinds of words that the contracts name.
NOT_ALNUM = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
WHITE = [0x20, *range(0x09, 0x0E)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chained(*parts: np.ndarray) -> np.ndarray:
    """One hash of several in order: of the words of an n-gram, say."""
    out = mixed(parts[0])
    for part in parts[1:]:
        out = mixed(out * np.uint64(BASE) + part)
    return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data else np.empty(0, np.uint8)
    return raw, at - at[0]


class Words:
    """Finds words: longest runs of bytes of one class that is not 0, within one text."""

    def __init__(self, classes: np.ndarray, lower: bool) -> None:
        self.classes = classes
        self.lower = np.arange(256, dtype=np.uint64)
        if lower:
            self.lower[65:91] += np.uint64(32)
        self.lower += np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    @classmethod
    def between(cls, separators: list[int], lower: bool = True) -> Words:
        classes = np.ones(256, np.uint8)
        classes[separators] = 0
        return cls(classes, lower)

    def spans(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each word, and how many words lie before each text and in all."""
        kind = self.classes[raw]
        border = np.empty(len(raw) + 1, bool)
        border[0] = border[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=border[1:-1])
        border[at] = True
        edges = np.flatnonzero(border)
        starts, ends = edges[:-1], edges[1:]
        inside = kind[starts] != 0 if len(starts) else np.empty(0, bool)
        starts, ends = starts[inside], ends[inside]
        return starts, ends, np.searchsorted(starts, at)

    def _grow(self, size: int) -> None:
        while len(self.powers) < size:
            n = np.uint64(len(self.powers))
            step, back = pow(BASE, int(n), 1 << 64), pow(INVERSE, int(n), 1 << 64)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(step)])
            self.inverses = np.concatenate([self.inverses, self.inverses * np.uint64(back)])

    def hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRETCH, "right")))
            low, high = starts[i], ends[j - 1]
            self._grow(int(high - low) + 1)
            sums = np.empty(high - low + 1, np.uint64)
            sums[0] = 0
            np.cumsum(self.lower[raw[low:high]] * self.powers[:high - low], out=sums[1:])
            a = starts[i:j] - low
            out[i:j] = (sums[ends[i:j] - low] - sums[a]) * self.inverses[a]
            i = j
        return mixed(out)

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes, and how many words lie before each text and in all."""
        raw, at = text_bytes(column)
        starts, ends, bounds = self.spans(raw, at)
        return self.hashes(raw, starts, ends), bounds


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def ngram_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """True at each word at which n words of one text begin."""
    total = int(bounds[-1])
    ok = np.ones(total, bool)
    for back in range(1, n):
        last = bounds[1:] - back
        last = last[(last >= bounds[:-1]) & (last < total)]
        ok[last] = False
    return ok
