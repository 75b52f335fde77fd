"""Vectorised words and shingles of Arrow text columns, as 64-bit hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased; every other byte counts as it
stands. Equal words have equal hashes in every batch, task and run, so hashes can meet in joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time, so that the working arrays stay small whatever the length of a text.
PIECE = 1 << 20
SHINGLE = 5

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that any of their bits can be used."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    values[0x41:0x5B] = values[0x61:0x7B]
    return values


_VALUES = _byte_values()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for pieces of up to ``n`` bytes."""
    size = 1 << max(20, (n + 1).bit_length())
    if size not in _powers:
        steps = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
        for s in steps:
            s[0] = 1
        _powers[size] = tuple(np.cumprod(s, dtype=np.uint64) for s in steps)
    return _powers[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the ``len + 1`` offsets of its values; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-end byte of each word, and the ``len + 1`` word offsets of the texts."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | fresh[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | fresh[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, at)


def word_hashes(raw: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word: a polynomial over its bytes, from prefix sums over pieces cut between words."""
    out = np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):
        begin = first[i]
        j = max(i + 1, int(np.searchsorted(past, begin + PIECE, "right")))
        piece = raw[begin:past[j - 1]]
        powers, inverses = _power_tables(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUES[piece] * powers[: len(piece)], out=sums[1:])
        s, e = first[i:j] - begin, past[i:j] - begin
        out[i:j] = (sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the ``len + 1`` offsets of each text's words."""
    raw, at = utf8(column)
    first, past, of = word_bounds(raw, at)
    return word_hashes(raw, first, past), of


def runs(hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hash of the ``n`` words from each position on, whatever the text; the last ``n - 1`` positions have none."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        total += hashes[k:k + len(total)] * np.uint64((_BASE * (2 * k + 3)) & (2**64 - 1) | 1)
    return mix(total)


def shingle_set(grams: np.ndarray, hashes: np.ndarray, start: int, stop: int, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingles of one text; a text of fewer words has its whole sequence as the one, an empty one none."""
    if stop - start >= n:
        return np.unique(grams[start:stop - n + 1])
    if stop == start:
        return np.zeros(0, np.uint64)
    return mix(runs(hashes[start:stop], stop - start) + np.uint64(stop - start))


def shingle_sets(column: pa.Array, n: int = SHINGLE):
    """The shingle set of each text of the column, in turn."""
    hashes, of = tokens(column)
    grams = runs(hashes, n)
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        yield shingle_set(grams, hashes, a, b, n)
