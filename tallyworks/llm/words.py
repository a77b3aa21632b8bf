"""Words and their hashes for whole Arrow string columns at once, with numpy.

A text word here is a run of ASCII letters or digits or any non-ASCII bytes,
with A-Z lowered; everything else separates words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte classes: 0 separates words, any other value is the lowered byte.
LOWERED = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 0x80 or (_c.isascii() and _c.isalnum()):
        LOWERED[_b] = ord(_c.lower()) if _b < 0x80 else _b
#: The same table for bytes.translate, with a space for every separator.
TRANSLATE = bytes(int(x) or 0x20 for x in LOWERED)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(n, np.uint64)
    up, down = one * _BASE, one * _INVERSE
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets from 0) for runs of rows of about ``most`` bytes; a null is empty."""
    col = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) of the texts laid end to end in ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    low = LOWERED[data]
    is_word = low != 0
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]  # a text begins here: its first byte starts a word, the one before ends one
    starts[cut] = is_word[cut]
    ends[cut - 1] = is_word[cut - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = _powers(1 << max(16, (n - 1).bit_length()))
    sums = np.cumsum(low.astype(np.uint64) * up[:n])
    total = sums[last] - np.where(first > 0, sums[first - 1], 0)
    hashes = mix(total * down[first] + (last - first).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(first, offsets))


def shingles(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``width`` words; a text of fewer words, but not none, is one shingle."""
    text = np.repeat(np.arange(len(counts)), counts)
    out, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= width:
        h = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            h = h * np.uint64(0x5851F42D4C957F2D) + words[k : k + len(h)]
        ok = text[: len(h)] == text[width - 1 :]
        out, where = mix(h[ok]), text[: len(h)][ok]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begin = np.cumsum(counts) - counts
        h = np.array([_fold(words[begin[t] : begin[t] + counts[t]]) for t in short], np.uint64)
        out, where = np.concatenate([out, h]), np.concatenate([where, short])
        order = np.argsort(where, kind="stable")
        out, where = out[order], where[order]
    return out, where


def _fold(words: np.ndarray) -> int:
    h = len(words)
    for w in words.tolist():
        h = (h * 0x5851F42D4C957F2D + w) & 0xFFFFFFFFFFFFFFFF
    return h
