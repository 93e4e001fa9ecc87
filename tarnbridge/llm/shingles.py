"""Word shingles of whole texts as 64-bit hashes, worked out on Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text worked on at a time; a longer text is taken alone.
CHUNK = 1_000_000

_U = np.uint64
_A, _B, _C, _K = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _A
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


_LETTER = np.arange(256, dtype=np.uint64)
_LETTER[65:91] += _U(32)  # A-Z become a-z
_LETTER = mix(_LETTER * _K)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row ends of some rows at a time."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
        yield at, data[ends[at] : ends[to]], ends[at + 1 : to + 1] - ends[at]
        at = to


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word, in order."""
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    solid = np.flatnonzero(~_BLANK[data])
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    fresh = np.ones(len(solid), bool)
    fresh[1:] = (solid[1:] != solid[:-1] + 1) | (row[solid[1:]] != row[solid[:-1]])
    first = np.flatnonzero(fresh)
    sizes = np.diff(first, append=len(solid))
    place = np.arange(len(solid)) - np.repeat(first, sizes)
    powers = np.full(int(sizes.max()), _K | _U(1), np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(_LETTER[data[solid]] * powers[place], first)
    return row[solid[first]], mix(sums + sizes.astype(np.uint64))


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by both.

    A row with fewer words than a shingle has its whole sequence as one; a row without words none.
    """
    row, word = word_hashes(data, ends)
    n = len(word)
    if not n:
        return row, word
    count = np.bincount(row, minlength=len(ends))
    rows, hashes = [], []
    if n >= words:
        value = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            value = mix(value * _K + word[k : n - words + 1 + k])
        whole = np.flatnonzero(row[: n - words + 1] == row[words - 1 :])
        rows.append(row[whole])
        hashes.append(value[whole])
    first = np.cumsum(count) - count
    for r in np.flatnonzero((count > 0) & (count < words)):
        value = np.full(1, count[r], np.uint64)
        for k in range(count[r]):
            value = mix(value * _K + word[first[r] + k : first[r] + k + 1])
        rows.append(np.array([r]))
        hashes.append(value)
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    distinct = np.ones(len(row), bool)
    distinct[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[distinct], value[distinct]
