"""Vectorised word and shingle hashes of Arrow string columns, shared by the operators on word shingles.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after A-Z are lower-cased. Its hash is a 64-bit
polynomial over its bytes, taken from prefix sums, so a batch costs a few passes over its bytes and no Python object per
word. Work proceeds in blocks of about ``BLOCK`` bytes; a longer text is cut at white space, so its memory is that of
its word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_COEF = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _block_words(data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased bytes, and each word's first byte; no word runs over a row start."""
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[row_starts] = True
    edge[n] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    size = 1 << max(16, (n - 1).bit_length())
    up, down = _powers(size)
    terms = _BYTE[data] * up[:n]
    sums = np.cumsum(terms)
    hashes = (sums[ends] - sums[starts] + terms[starts]) * down[starts]
    return mix(hashes ^ ((ends - starts + 1).astype(np.uint64) * _COEF[0])), starts


def _long_row(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, block by block, each block cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not _SPACE[data[end]]:
            step = _SPACE[data[end : end + BLOCK]]
            end = end + int(step.argmax()) if step.any() else min(len(data), end + BLOCK)
        out.append(_block_words(_LOWER[data[at:end]], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets and validity of a string column, without copying its text."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets, ~np.asarray(column.is_null()).astype(bool)


def rows_of_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets of each row's words) block by block; a null text has no words."""
    data, offsets, valid = buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1
        if end <= row:
            words = _long_row(data[offsets[row] : offsets[row + 1]]) if valid[row] else np.zeros(0, np.uint64)
            yield row, words, np.array([0, len(words)])
            row += 1
            continue
        lo, hi = int(offsets[row]), int(offsets[end])
        begins = offsets[row:end] - lo
        if hi > lo:
            hashes, starts = _block_words(_LOWER[data[lo:hi]], begins[begins < hi - lo])
        else:
            hashes, starts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield row, hashes, np.searchsorted(starts, offsets[row : end + 1] - lo)
        row = end


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``k`` words in text order, and their offsets; a shorter row is one shingle as a whole."""
    counts = np.diff(offsets)
    n = len(words)
    coef = _COEF if k <= len(_COEF) else mix(np.arange(1, k + 1, dtype=np.uint64))
    runs = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k if len(runs) else 0):
        runs += coef[j] * words[j : j + len(runs)]
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.zeros(len(number) + 1, np.int64)
    np.cumsum(number, out=out[1:])
    source = np.repeat(offsets[:-1] - out[:-1], number) + np.arange(out[-1])
    short = np.repeat(counts < k, number)
    result = np.zeros(out[-1], np.uint64)
    result[~short] = mix(runs[source[~short]])
    for at in np.flatnonzero(short):  # at most one per short row
        row = int(np.searchsorted(out, at, "right")) - 1
        own = words[offsets[row] : offsets[row + 1]]
        length = np.array([len(own)], np.uint64) * _COEF[5:6]
        result[at] = mix(np.array([(own * coef[: len(own)]).sum(dtype=np.uint64)]) ^ length)[0]
    return result, out


def shingle_rows(column: pa.Array, k: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its shingle hashes in text order) for every row of a string column."""
    for first, words, offsets in rows_of_words(column):
        hashes, bounds = shingle_hashes(words, offsets, k)
        for i in range(len(bounds) - 1):
            yield first + i, hashes[bounds[i] : bounds[i + 1]]
