"""Vectorised words and shingles of a block of texts.

A word is a maximal run of bytes other than space and 0x09-0x0D, compared
after lower-casing A-Z.  Its hash is a polynomial over its bytes modulo 2**64,
finished by a mixer, so that one cumulative sum hashes all words of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed in one go.
SLICE = 1 << 20
_M = 0x9E3779B97F4A7C15 | 1
_U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += _U(32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: tuple[np.ndarray, np.ndarray] | None = None


def _pow() -> tuple[np.ndarray, np.ndarray]:
    global _tables
    if _tables is None:
        _tables = _powers(_M, SLICE), _powers(pow(_M, -1, 1 << 64), SLICE)
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def _giant(word: np.ndarray) -> int:
    """The polynomial of one word longer than a slice."""
    power, total = _pow()[0], 0
    for k in range(0, len(word), SLICE):
        part = _LOWER[word[k : k + SLICE]]
        total += int((part * power[: len(part)]).sum(dtype=np.uint64)) * pow(_M, k, 1 << 64)
    return total % (1 << 64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text by text, and the number of words of each text."""
    n, m = len(data), len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(m, np.int64)
    solid = ~_SPACE[data]
    first = np.empty(n, bool)
    first[0] = False
    first[1:] = solid[:-1]
    begin = offsets[:-1][offsets[:-1] < n]
    first[begin] = False
    np.logical_and(solid, ~first, out=first)
    starts = np.flatnonzero(first)
    last = np.empty(n, bool)
    last[-1] = False
    last[:-1] = solid[1:]
    last[begin[begin > 0] - 1] = False
    np.logical_and(solid, ~last, out=last)
    ends = np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    out = np.empty(len(starts), np.uint64)
    power, inverse = _pow()
    i = 0
    while i < len(starts):
        at = starts[i]
        j = int(np.searchsorted(ends, at + SLICE, "right"))
        if j == i:
            out[i] = _giant(data[at : ends[i]])
            i += 1
            continue
        stop = ends[j - 1]
        sums = np.empty(stop - at + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_LOWER[data[at:stop]] * power[: stop - at], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64)), counts


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words, and how many each text has.

    A text of fewer words has one shingle, of all its words; one without words none.
    """
    n = len(words)
    factors = [_U(mix_int(k + 1) | 1) for k in range(width)]
    ends = np.cumsum(counts)
    full = np.maximum(counts - width + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < width))
    sizes = full.copy()
    sizes[short] = 1
    if n >= width:
        acc = words[: n - width + 1] * factors[0]
        for k in range(1, width):
            acc += words[k : n - width + 1 + k] * factors[k]
        keep = np.repeat(ends - width + 1, counts)[: len(acc)] > np.arange(len(acc))
        acc = mix(acc[keep])
    else:
        acc = np.zeros(0, np.uint64)
    if len(short):
        own = []
        for d in short:
            h = int(counts[d])
            for w in words[ends[d] - counts[d] : ends[d]]:
                h = mix_int(h * 31 + int(w))
            own.append(h)
        acc = np.insert(acc, np.cumsum(full)[short], np.array(own, np.uint64))
    return acc, sizes


def blocks(offsets: np.ndarray, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def counted(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 48-bit keys of each text in order, their counts, and how many each text has.

    One sort does it for up to 65,536 texts, whose number stands above the key.
    """
    which = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    rows = (which << _U(48)) | (keys >> _U(16))
    rows.sort()
    if not len(rows):
        return rows, np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    new = np.empty(len(rows), bool)
    new[0] = True
    np.not_equal(rows[1:], rows[:-1], out=new[1:])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(rows)))
    distinct = rows[at]
    per_text = np.bincount((distinct >> _U(48)).astype(np.int64), minlength=len(sizes))
    return distinct & _U((1 << 48) - 1), tf, per_text
