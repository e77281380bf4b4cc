"""Words of many texts at once, as runs of code points, without per-row string calls.

A word is a maximal run of letters, combining marks, digits and apostrophes in
lower case, with the curly apostrophe read as the straight one.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrow import code_points, plain

#: An odd base and its inverse modulo 2**64, for the hashes of words.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it part of a word, and its lower case."""
    part = np.zeros(sys.maxunicode + 1, bool)
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LMN":
            part[point] = True
            small = chr(point).lower()
            if len(small) == 1:
                lower[point] = ord(small)
    part[ord("'")] = part[ord("’")] = True
    lower[ord("’")] = ord("'")
    return part, lower


def word_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points, first and last-plus-one place of each word, and n + 1 offsets of words by row."""
    part, lower = _tables()
    texts = pc.replace_substring(plain(texts), "İ", "i̇")
    points, offsets = code_points(texts)
    inside = part[points]
    # a word never runs across two texts
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    opens[first] = inside[first]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return lower[points], starts, ends, np.searchsorted(starts, offsets)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.full(len(points), BASE)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.full(len(points), INVERSE)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    upto = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power, out=upto[1:])
    return _mix((upto[ends] - upto[starts]) * back[starts])


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Entry i: the hash of the k words from word i on (0 where fewer are left)."""
    total = np.zeros(len(hashes), np.uint64)
    piece, size, done = hashes, 1, 0
    left = k
    while left:
        if left & 1:
            n = len(hashes) - done - size + 1
            if n <= 0:
                return np.zeros(len(hashes), np.uint64)
            fresh = np.zeros(len(hashes), np.uint64)
            fresh[:n] = _mix(total[:n] * BASE + piece[done : done + n])
            total, done = fresh, done + size
        left >>= 1
        if left:
            n = max(0, len(piece) - size)
            wide = np.zeros(len(piece), np.uint64)
            wide[:n] = _mix(piece[:n] * BASE + piece[size : size + n] + np.uint64(size))
            piece, size = wide, size * 2
    return total


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Entry i: ``best`` (np.minimum or np.maximum) of the values i .. i + width - 1, as far as they go."""
    out, size = values, 1
    while size < width:
        step = min(size, width - size)
        wider = out.copy()
        if step < len(out):
            wider[:-step] = best(out[:-step], out[step:])
        out, size = wider, size + step
    return out
