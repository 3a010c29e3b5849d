"""Word-shingle sets of whole texts, vectorised over Arrow batches.

Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z; a set holds the 64-bit hashes of a
text's distinct shingles of `k` words (a shorter text is one shingle; no words: the empty set).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

K = 5
_CHUNK = 1 << 19  # bytes of text handled at once (a longer text is handled alone)
_BYTES = np.random.default_rng(20).integers(1, 2**64, 256, np.uint64, endpoint=False)
_BYTES[65:91] = _BYTES[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_STEP = np.random.default_rng(21).integers(1, 2**64, 64, np.uint64, endpoint=False) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, size: int = _CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text the index of its first word (and the end)."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    begins[cut] |= inside[cut]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    packed = np.flatnonzero(inside)
    first = np.searchsorted(packed, starts)
    sizes = np.diff(np.append(first, len(packed)))
    power = np.multiply.accumulate(np.full(int(sizes.max()), _BASE))
    terms = _BYTES[data[packed]] * power[np.arange(len(packed)) - np.repeat(first, sizes)]
    return mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64)), bounds


def shingle_sets(column: pa.Array, k: int = K) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row of a string column."""
    for row, data, offsets in text_chunks(column):
        words, bounds = word_hashes(data, offsets)
        padded = np.append(words, np.zeros(k, np.uint64))
        whole = np.full(len(words), np.uint64(k))
        for j in range(k):
            whole += padded[j : j + len(words)] * _STEP[j]
        whole = mix(whole)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b - a >= k:
                yield row + i, np.unique(whole[a : b - k + 1])
            elif b > a:
                n = b - a
                yield row + i, mix(np.array([np.sum(words[a:b] * _STEP[:n], dtype=np.uint64) + np.uint64(n)], np.uint64))
            else:
                yield row + i, np.empty(0, np.uint64)


def set_id(hashes: np.ndarray) -> np.uint64:
    """A hash of a whole set; equal sets have equal ids."""
    return mix(np.array([np.sum(mix(hashes ^ _BASE), dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))[0]
