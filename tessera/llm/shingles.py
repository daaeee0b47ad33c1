"""Word and shingle hashes of whole texts, computed on Arrow buffers.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return, with A-Z in lower case.  A word's hash is a polynomial
in its bytes modulo 2**64, taken for all words at once from running sums; a
shingle's hash combines the hashes of consecutive words.  Texts of any length
are read in pieces that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
FOLD = np.uint64(0xC2B2AE3D27D4EB4F)
SHORT = np.uint64(0x165667B19E3779F9)
K = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A random number for each byte; capitals have those of small letters."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    values[65:91] = values[97:123]
    return values


_VALUE = _byte_values()
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, 0 to n."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            row = np.full(n + 1, base, np.uint64)
            row[0] = 1
            _POWERS[k] = np.cumprod(row)
    return _POWERS[0], _POWERS[1]


def _piece_words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one piece; ``firsts``: offsets where texts start."""
    n = len(data)
    word = ~_SPACE[data]
    brk = np.zeros(n + 1, bool)  # a word can't go on across a text's start
    brk[firsts] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | brk[1:-1]
    end[:-1] &= ~word[1:] | brk[1:-1]
    b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _powers(max(n, PIECE))
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(_VALUE[data] * up[:n], out=run[1:])
    return mix((run[e] - run[b]) * down[b] + (e - b).astype(np.uint64) * FOLD), b


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a column of texts, and for each text where its words start among them (one more: the end)."""
    n = len(column)
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    column = column.fill_null("")
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[off[0] : off[-1]] if values is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    hashes, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data) and not _SPACE[data[to]]:  # up to the next white space
            step = np.flatnonzero(_SPACE[data[to : to + 65536]])
            to = to + int(step[0]) if len(step) else min(to + 65536, len(data))
        inside = off[(off >= at) & (off < to)] - at
        h, b = _piece_words(data[at:to], inside)
        hashes.append(h)
        places.append(b + at)
        at = to
    place = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(place, off, "left")


def shingles_of(w: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of fewer words, one of the whole sequence."""
    n = len(w)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < k:
        total = SHORT * np.uint64(n)
        for x in w:
            total = total * FOLD + x
        return mix(np.array([total], np.uint64))
    total = w[: n - k + 1].copy()
    for j in range(1, k):
        total *= FOLD
        total += w[j : n - k + 1 + j]
    return mix(total)


def shingles(column: pa.Array, k: int = K) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles in order, repeats included."""
    with np.errstate(over="ignore"):
        w, bounds = words(column)
        if len(w) >= k:
            whole = shingles_of(w, k)  # also across texts; those are not taken
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield whole[a : b - k + 1] if b - a >= k else shingles_of(w[a:b], k)


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's long."""
    return pa.array(x.view(np.int64), pa.int64())
