"""Words and hashes of whole Arrow batches in numpy.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text; every
other ASCII character separates. WORD_SQL is the same rule as a regular expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CHUNK = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
COEF = _rng.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_pow = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if len(_pow[0]) < n:
        size = max(n, 2 * CHUNK if n > CHUNK else CHUNK)
        grown = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base)
            p[0] = 1
            grown.append(np.multiply.accumulate(p))
        if size > 8 * CHUNK:  # of a very long text: not worth keeping
            return grown[0], grown[1]
        _pow = grown[0], grown[1]
    return _pow


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array and where each text begins, with the end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes, one row at least."""
    _, offsets = raw(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    data: np.ndarray  # bytes of the lower-cased texts
    start: np.ndarray  # byte range of each word
    end: np.ndarray
    doc: np.ndarray  # its row
    first: np.ndarray  # the first word of each row, with the end

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        n = len(self.data)
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start])

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode()


def split_words(texts: pa.Array) -> Words:
    """The words of every text."""
    data, offsets = raw(pc.utf8_lower(texts))
    n = len(data)
    is_word = _IS_WORD[data]
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * COEF[j]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the width values from each position on."""
    if len(x) < width:
        return x[:0]
    best, have = x, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    return best


def spans(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
